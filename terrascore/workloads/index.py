"""The composite index and its parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.numbers import round_half_up
from terrascore.operators.scaling import group_mean_fill, minmax_scale
from terrascore.plans import composite as plan
from terrascore.plans import roles
from terrascore.session import materialize, shared_folder
from terrascore.sources import tables
from terrascore.workloads import register
from terrascore.workloads.sql import ENTITIES, INDEX, MARKET, SCORED, rnd

SETTINGS = plan.IndexSettings(
    levels={0: 280000, 1: 200000, 2: 320000, 3: 350000},
    default_level=270000,
    year=roles.INDEX_YEAR,
    period=roles.HALF_YEAR,
    climate_years=roles.YEARS,
    climate_bands=[(400, "Мягкий"), (500, "Холодный"), (600, "Очень холодный"), (700, "Арктический")],
    heating_baseline=450.0,
)


def index_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.composite_index(roles.index_roles(spark, sf_dir), SETTINGS)


@register("composite_index", f"{INDEX} SELECT * FROM index_view")
def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_frame(spark, sf_dir)


@register(
    "export_index",
    f"{INDEX} SELECT * EXCLUDE (mobility_km, climate_band, heating_over_baseline) FROM index_view ORDER BY index_rank, entity_id",
)
def export_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.export_index(index_frame(spark, sf_dir))


@register("json_sink", f"{INDEX} SELECT * EXCLUDE (mobility_km, climate_band, heating_over_baseline) FROM index_view")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported index through JSON lines and back."""
    out = plan.export_index(index_frame(spark, sf_dir))
    path = f"{shared_folder(spark)}/terrascore/index-json-{uuid.uuid4().hex}"
    tables.write_json(out, path)
    return spark.read.schema(out.schema).json(path)


@register("csv_sink", f"{INDEX} SELECT * FROM index_view")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view through CSV and back, by a declared schema."""
    out = index_frame(spark, sf_dir)
    path = f"{shared_folder(spark)}/terrascore/index-csv-{uuid.uuid4().hex}"
    tables.write_csv(out, path)
    return tables.read_csv(spark, path, out.schema)


@register("entity_base", f"WITH {ENTITIES} SELECT * FROM entities")
def entity_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.entity_base(roles.settlements(spark, sf_dir), roles.regions(spark, sf_dir), roles.territories(spark, sf_dir))


@register(
    "name_key_join",
    f"""WITH {ENTITIES}, mobility AS (
      SELECT lower(trim('  ' || n_name || ' ')) AS territory_key, avg(CAST(n_nationkey * 3 % 11 AS DOUBLE)) AS mobility_raw
      FROM nation GROUP BY 1)
    SELECT entity_id, territory_key, mobility_raw FROM entities LEFT JOIN mobility USING (territory_key)""",
)
def name_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = materialize(plan.mobility_by_name(roles.mobility(spark, sf_dir), roles.INDEX_YEAR), "mobility")
    return entity_base(spark, sf_dir).join(by_name, "territory_key", "left").select("entity_id", "territory_key", "mobility_raw")


@register(
    "regional_impute",
    f"""WITH {ENTITIES}, {MARKET}
    SELECT entity_id, region_id, {rnd('market_access', 4)} AS market_raw,
      {rnd('coalesce(market_access, avg(market_access) OVER (PARTITION BY region_id))', 4)} AS market_filled
    FROM entities LEFT JOIN market USING (territory_id)""",
)
def regional_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = materialize(roles.market(spark, sf_dir), "market")
    raw = roles.settlements(spark, sf_dir).join(market, "territory_id", "left")
    return group_mean_fill(raw, "region_id", ["market_access"]).select(
        "entity_id",
        "region_id",
        round_half_up(F.col("market_access"), 4).alias("market_raw"),
        round_half_up(F.col("market_access_filled"), 4).alias("market_filled"),
    )


@register(
    "minmax_scale",
    f"""SELECT c_custkey AS entity_id,
      {rnd('(c_acctbal - min(c_acctbal) OVER ()) / nullif(max(c_acctbal) OVER () - min(c_acctbal) OVER (), 0)')} AS balance_scaled,
      {rnd('1 - (c_nationkey - min(c_nationkey) OVER ())::DOUBLE / nullif(max(c_nationkey) OVER () - min(c_nationkey) OVER (), 0)')} AS nation_scaled,
      0.5::DOUBLE AS constant_scaled
    FROM customer""",
)
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.scan(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        (F.col("c_custkey") * 0).cast("double").alias("constant"),
    )
    out = minmax_scale(rows, ["balance", "nation"], inverted=["nation"])
    out = minmax_scale(out, ["constant"], on_constant=0.5)
    cols = ("balance_scaled", "nation_scaled", "constant_scaled")
    return out.select("entity_id", *[round_half_up(F.col(c), 6).alias(c) for c in cols])


_LEVEL = "CASE n_regionkey WHEN 0 THEN 280000 WHEN 1 THEN 200000 WHEN 2 THEN 320000 WHEN 3 THEN 350000 ELSE 270000 END::DOUBLE"


@register("threshold_lookup", f"SELECT n_nationkey, n_regionkey, {_LEVEL} AS level FROM nation")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = plan.threshold_lookup(F.col("n_regionkey"), SETTINGS.levels, SETTINGS.default_level)
    return roles.scan(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", level.alias("level"))


_SPENDING = """SELECT o_custkey AS entity_id, avg(o_totalprice) AS consumption_raw FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-07-01' AND DATE '1996-12-31' GROUP BY 1"""


@register(
    "welfare_ratio",
    f"""WITH {ENTITIES}, spending AS ({_SPENDING}), joined AS (
      SELECT entity_id, consumption_raw, {_LEVEL.replace('n_regionkey', 'region_id')} AS level FROM entities LEFT JOIN spending USING (entity_id))
    SELECT entity_id, {rnd('least(consumption_raw / level, 2.0) / 2.0')} AS ratio,
      {rnd('CASE WHEN consumption_raw IS NOT NULL THEN least(consumption_raw / level, 2.0) / 2.0 END')} AS ratio_or_null FROM joined""",
)
def welfare(spark: SparkSession, sf_dir: str) -> DataFrame:
    spending = plan.consumption_mean(roles.consumption(spark, sf_dir), "entity_id", roles.HALF_YEAR)
    level = plan.threshold_lookup(F.col("region_id"), SETTINGS.levels, SETTINGS.default_level)
    x = F.col("consumption_raw")
    return roles.settlements(spark, sf_dir).join(spending, "entity_id", "left").select(
        "entity_id",
        round_half_up(plan.welfare_ratio(x, level), 6).alias("ratio"),
        round_half_up(plan.welfare_ratio(x, level, null_neutral=True), 6).alias("ratio_or_null"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.component_scores(
        materialize(plan.index_inputs(roles.index_roles(spark, sf_dir), SETTINGS), "index-inputs"), SETTINGS
    )


@register(
    "composite_score",
    f"""{SCORED} SELECT entity_id, {rnd('score', 4)} AS score_01, {rnd('score * 100', 2)} AS score_100, {rnd('score * 10', 2)} AS score_10
    FROM scored""",
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return _scored(spark, sf_dir).select(
        "entity_id",
        round_half_up(s, 4).alias("score_01"),
        round_half_up(s * 100, 2).alias("score_100"),
        round_half_up(s * 10, 2).alias("score_10"),
    )


@register(
    "score_band",
    f"""{SCORED} SELECT entity_id, CASE WHEN rank_score * 10 < 3.0 THEN 'critical' WHEN rank_score * 10 < 4.5 THEN 'low'
      WHEN rank_score * 10 < 6.5 THEN 'middle' ELSE 'high' END AS band FROM ranked""",
)
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = plan.banded(F.col("rank_score") * 10, [(3.0, "critical"), (4.5, "low"), (6.5, "middle")], "high")
    return _scored(spark, sf_dir).select("entity_id", band.alias("band"))


@register(
    "index_rank",
    """SELECT c_custkey AS entity_id, CAST(rank() OVER (ORDER BY round(c_acctbal, 0) DESC) AS BIGINT) AS place FROM customer""",
)
def index_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.round("c_acctbal", 0).alias("score"))
    # without a row count the distributed path runs whatever the size
    return plan.competition_rank(rows, "score", out="place").drop("score")
