"""Series views, seasonal climate, snapshots and change operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.numbers import round_half_up
from terrascore.operators import changes, climate, series
from terrascore.operators.ranking import competition_rank
from terrascore.plans import composite, roles
from terrascore.session import materialize
from terrascore.workloads import register
from terrascore.workloads.sql import CLIMATE, MARKET, rnd

SERIES = """
series AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS territory_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         o_orderpriority AS category, avg(o_totalprice) AS consumption
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
)"""


@register(
    "consumption_avg",
    f"""WITH {SERIES}, means AS (
      SELECT territory_id, avg(consumption) AS m FROM series
      WHERE category = '1-URGENT' AND date BETWEEN DATE '1996-07-01' AND DATE '1996-12-31' GROUP BY 1)
    SELECT c_custkey AS entity_id, {rnd('m', 4)} AS consumption_avg
    FROM customer LEFT JOIN means ON territory_id = CAST(c_nationkey AS VARCHAR)""",
)
def consumption_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = roles.category_series(spark, sf_dir)
    means = materialize(composite.consumption_mean(known, "territory_id", roles.HALF_YEAR, category="1-URGENT"), "means")
    return (
        roles.settlements(spark, sf_dir)
        .join(means, "territory_id", "left")
        .select("entity_id", round_half_up(F.col("consumption_raw"), 4).alias("consumption_avg"))
    )


@register(
    "category_stats",
    f"""WITH {SERIES} SELECT category, count(DISTINCT territory_id) AS territories_count, {rnd('avg(consumption)', 4)} AS avg_consumption,
      {rnd('min(consumption)', 4)} AS min_consumption, {rnd('max(consumption)', 4)} AS max_consumption,
      {rnd('stddev_samp(consumption)', 4)} AS stddev_consumption FROM series GROUP BY 1""",
)
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = series.category_stats(roles.category_series(spark, sf_dir))
    cols = ("avg_consumption", "min_consumption", "max_consumption", "stddev_consumption")
    return stats.withColumns({c: round_half_up(F.col(c), 4) for c in cols})


@register(
    "latest_month",
    f"""WITH {SERIES} SELECT territory_id, date, category, {rnd('consumption', 4)} AS consumption, 'Priority ' || category AS category_description
    FROM series WHERE date = (SELECT max(date) FROM series)""",
)
def latest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.latest_month(roles.category_series(spark, sf_dir), roles.categories(spark, sf_dir))
    return out.withColumn("consumption", round_half_up(F.col("consumption"), 4))


@register(
    "market_rank",
    f"""WITH {MARKET} SELECT territory_id, {rnd('market_access', 4)} AS market_access,
      CAST(rank() OVER (ORDER BY {rnd('market_access', 4)} DESC) AS BIGINT) AS place FROM market WHERE market_access IS NOT NULL""",
)
def market_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = roles.market(spark, sf_dir).filter(F.col("market_access").isNotNull())
    rows = known.select("territory_id", round_half_up(F.col("market_access"), 4).alias("market_access"))
    return competition_rank(rows, "market_access", out="place")


@register(
    "seasonal_climate",
    f"""WITH {CLIMATE} SELECT entity_id, {rnd('temp_mean', 4)} AS temp_mean, {rnd('temp_winter', 4)} AS temp_winter,
      {rnd('temp_summer', 4)} AS temp_summer, {rnd('temp_amplitude', 4)} AS temp_amplitude, {rnd('degree_days', 4)} AS degree_days FROM climate""",
)
def seasonal_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly, yearly = roles.climate_tables(roles.climate_daily(spark, sf_dir, roles.YEARS))
    out = climate.seasonal_climate(monthly, yearly, roles.YEARS)
    cols = ("temp_mean", "temp_winter", "temp_summer", "temp_amplitude", "degree_days")
    return out.select("entity_id", *[round_half_up(F.col(c), 4).alias(c) for c in cols])


@register(
    "heating_degree_days",
    f"""WITH daily AS (
      SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) - 25 AS temperature FROM lineitem GROUP BY 1, 2)
    SELECT entity_id, year(date) AS year, {rnd('sum(greatest(0, 18 - temperature))', 4)} AS degree_days FROM daily GROUP BY 1, 2""",
)
def heating_degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = climate.yearly_degree_days(roles.daily_means(roles.climate_daily(spark, sf_dir)))
    return out.select("entity_id", F.col("year").cast("bigint").alias("year"), round_half_up(F.col("degree_days"), 4).alias("degree_days"))


@register(
    "latest_population",
    f"""WITH yearly AS (SELECT o_custkey AS entity_id, year(o_orderdate) AS year, sum(o_totalprice) AS population FROM orders GROUP BY 1, 2),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY year DESC) AS n FROM yearly)
    SELECT entity_id, year, {rnd('population', 2)} AS population FROM numbered WHERE n = 1""",
)
def latest_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.latest_value(roles.population(spark, sf_dir), "entity_id", "population")
    return out.select("entity_id", F.col("year").cast("bigint").alias("year"), round_half_up(F.col("population"), 2).alias("population"))


@register(
    "territory_crosswalk",
    """WITH mapping AS (SELECT CAST(n_nationkey AS VARCHAR) AS territory_id, 'T-' || lpad(CAST(n_nationkey * 1000 AS VARCHAR), 8, '0') AS code
      FROM nation)
    SELECT c_custkey AS entity_id, CAST(c_nationkey AS VARCHAR) AS territory_id, code, code IS NOT NULL AS matched
    FROM customer LEFT JOIN mapping ON territory_id = CAST(c_nationkey AS VARCHAR)""",
)
def territory_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = roles.scan(spark, sf_dir, "nation")
    mapping = nation.select(
        F.col("n_nationkey").cast("string").alias("territory_id"),
        F.concat(F.lit("T-"), F.lpad((F.col("n_nationkey") * 1000).cast("string"), 8, "0")).alias("code"),
    )
    rows = roles.settlements(spark, sf_dir).select("entity_id", "territory_id")
    return series.crosswalk(rows, mapping, "territory_id", "code").select("entity_id", "territory_id", "code", "matched")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as keyed rows, split in time; one priority becomes a null key."""
    rows = roles.scan(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("category"),
        F.col("o_totalprice").alias("value"),
        F.to_date("o_orderdate").alias("loaded_on"),
        F.col("o_orderkey").alias("order_no"),
    )
    cut = F.lit("1998-01-01").cast("date")
    return rows.filter(F.col("loaded_on") < cut), rows.filter(F.col("loaded_on") >= cut)


_KEYED = """keyed AS (
  SELECT o_custkey AS entity_id, nullif(o_orderpriority, '4-NOT SPECIFIED') AS category, o_totalprice AS value,
         CAST(o_orderdate AS DATE) AS loaded_on, o_orderkey AS order_no FROM orders),
old AS (SELECT entity_id, category, max(value) AS value, min(loaded_on) AS loaded_on FROM keyed WHERE loaded_on < DATE '1998-01-01' GROUP BY 1, 2),
new AS (SELECT entity_id, category, arg_max(value, (loaded_on, order_no)) AS value, max(loaded_on) AS loaded_on
  FROM keyed WHERE loaded_on >= DATE '1998-01-01' GROUP BY 1, 2)"""


@register(
    "upsert_snapshot",
    f"""WITH {_KEYED} SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.category, n.category) AS category,
      coalesce(n.value, o.value) AS value, coalesce(o.loaded_on, n.loaded_on) AS loaded_on,
      CASE WHEN n.entity_id IS NOT NULL AND n.value IS DISTINCT FROM o.value THEN DATE '2002-01-01' END AS updated_on
    FROM old o FULL JOIN new n ON o.entity_id = n.entity_id AND o.category IS NOT DISTINCT FROM n.category""",
)
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    target = before.groupBy("entity_id", "category").agg(
        F.max("value").alias("value"), F.min("loaded_on").alias("loaded_on"), F.lit(None).cast("date").alias("updated_on")
    )
    return changes.upsert_snapshot(
        target,
        after,
        ["entity_id", "category"],
        ["loaded_on", "order_no"],
        keep_first=["loaded_on"],
        touched=("updated_on", F.lit("2002-01-01").cast("date")),
    )


@register(
    "insert_ignore",
    """WITH buyers AS (SELECT DISTINCT o_custkey AS entity_id FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')
    SELECT entity_id, 'buyer' AS origin FROM buyers
    UNION ALL SELECT c_custkey, 'listed' FROM customer WHERE c_custkey NOT IN (SELECT entity_id FROM buyers)""",
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = roles.scan(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    target = early.select(F.col("o_custkey").alias("entity_id")).distinct().withColumn("origin", F.lit("buyer"))
    batch = roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.lit("listed").alias("origin"))
    return changes.insert_ignore(target, batch, ["entity_id"], ["origin"])


@register(
    "audit_diff",
    f"""WITH {_KEYED} SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(o.category, n.category) AS category,
      o.value AS old_value, n.value AS new_value,
      CASE WHEN o.entity_id IS NULL THEN 'INSERT' WHEN n.entity_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation
    FROM old o FULL JOIN new n ON o.entity_id = n.entity_id AND o.category IS NOT DISTINCT FROM n.category
    WHERE o.value IS DISTINCT FROM n.value""",
)
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    keys = ["entity_id", "category"]
    old = before.groupBy(*keys).agg(F.max("value").alias("value"))
    new = changes.last_wins(after, keys, ["loaded_on", "order_no"]).select(*keys, "value")
    return changes.audit_diff(old, new, keys, ["value"])
