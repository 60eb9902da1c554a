"""The indicator matrix and the first index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.numbers import round_half_up
from terrascore.operators import cells, matrix
from terrascore.operators.quantiles import exact_quantiles
from terrascore.plans import indicators as plan
from terrascore.plans import roles
from terrascore.session import materialize
from terrascore.workloads import register
from terrascore.workloads.sql import rnd

CODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SHORT = {c: f"p{c[0]}" for c in CODES}

LONG = """
long AS (
  SELECT c_custkey AS entity_id, code, value FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS code FROM orders)
  LEFT JOIN (SELECT o_custkey, o_orderpriority AS code, arg_min(o_totalprice, (year(o_orderdate), o_orderkey)) AS value
             FROM orders GROUP BY 1, 2) f ON o_custkey = c_custkey AND f.code = code_
)""".replace("o_orderpriority AS code FROM orders)", "o_orderpriority AS code_ FROM orders)").replace("entity_id, code, value FROM customer", "entity_id, code_ AS code, value FROM customer")

IMPUTED = f"""{LONG},
kept AS (SELECT code FROM long GROUP BY 1 HAVING count(*) - count(value) <= 0.5 * count(*)),
imputed AS (
  SELECT entity_id, code, coalesce(value, median(value) OVER (PARTITION BY code)) AS value FROM long WHERE code IN (SELECT code FROM kept)
),
population AS (
  SELECT o_custkey AS entity_id, arg_max(p, y) AS population
  FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS p FROM orders GROUP BY 1, 2) GROUP BY 1
),
strength AS (
  SELECT code, abs(corr(value, population)) AS r FROM imputed JOIN population USING (entity_id) GROUP BY 1
),
factors AS (SELECT code, r, row_number() OVER (ORDER BY r DESC, code) AS place FROM strength ORDER BY r DESC, code LIMIT 3),
normed AS (
  SELECT entity_id, code, coalesce((value - min(value) OVER (PARTITION BY code)) / nullif(max(value) OVER (PARTITION BY code) - min(value) OVER (PARTITION BY code), 0), 0) AS x
  FROM imputed WHERE code IN (SELECT code FROM factors)
),
first_index AS (SELECT entity_id, avg(x) * 10 AS index_v1 FROM normed GROUP BY 1)"""


def _long(spark: SparkSession, sf_dir: str, max_missing: float = 0.5) -> plan.LongMatrix:
    return plan.long_matrix(roles.zones(spark, sf_dir), roles.indicator_facts(spark, sf_dir), max_missing)


@register(
    "indicator_pivot",
    f"WITH {LONG} SELECT entity_id, {', '.join(f'''max(CASE WHEN code = '{c}' THEN value END) AS {s}''' for c, s in SHORT.items())} FROM long GROUP BY 1",
)
def indicator_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot into declared columns."""
    ids = roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    return ids.join(matrix.indicator_pivot(roles.indicator_facts(spark, sf_dir), CODES), "entity_id", "left").withColumnsRenamed(SHORT)


@register(
    "missing_profile",
    f"""WITH {LONG} SELECT code, count(*) - count(value) AS missing, {rnd('(count(*) - count(value)) / count(*)')} AS missing_share
    FROM long GROUP BY 1""",
)
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    out = cells.code_profile(ids, cells.known_cells(ids, roles.indicator_facts(spark, sf_dir))).select("code", "missing", "missing_share")
    return out.withColumn("missing_share", round_half_up(F.col("missing_share"), 6))


@register(
    "drop_sparse_indicators",
    f"""WITH {LONG} SELECT entity_id, code, value FROM long
    WHERE code IN (SELECT code FROM long GROUP BY 1 HAVING count(*) - count(value) <= 0.137 * count(*))""",
)
def drop_sparse_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    known = materialize(cells.known_cells(ids, roles.indicator_facts(spark, sf_dir)), "cells")
    kept = cells.dense(cells.code_profile(ids, known), 0.137).select("code", F.lit(None).cast("double").alias("median"))
    return cells.imputed_cells(ids, known, kept)


@register("median_impute", f"WITH {IMPUTED} SELECT entity_id, code, {rnd('value', 4)} AS value FROM imputed")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    return cells.imputed_cells(long.entities, long.cells, long.codes).withColumn("value", round_half_up(F.col("value"), 4))


@register(
    "correlation_matrix",
    f"""WITH {IMPUTED} SELECT a.code AS code_a, b.code AS code_b, {rnd('corr(a.value, b.value)')} AS r
    FROM imputed a JOIN imputed b USING (entity_id) GROUP BY 1, 2""",
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    return cells.correlations(long.entities, long.cells, long.codes).withColumn("r", round_half_up(F.col("r"), 6))


@register("top_factors", f"WITH {IMPUTED} SELECT place, code, {rnd('r')} AS correlation FROM factors")
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    out = cells.top_codes(long.entities, long.cells, long.codes, "population", 3)
    return out.withColumn("correlation", round_half_up(F.col("correlation"), 6))


@register("index_v1", f"WITH {IMPUTED} SELECT entity_id, {rnd('index_v1')} AS index_v1 FROM first_index")
def index_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    best = cells.top_codes(long.entities, long.cells, long.codes, "population", 3)
    factors = long.codes.join(best.select("code"), "code", "left_semi")
    return cells.mean_scaled(long.entities, long.cells, factors).withColumn("index_v1", round_half_up(F.col("index_v1"), 6))


@register(
    "poad_index",
    f"""WITH {IMPUTED} SELECT entity_id, {rnd('index_v1')} AS index_v1,
      CAST(rank() OVER (ORDER BY round(index_v1, 12) DESC) AS BIGINT) AS place FROM first_index""",
)
def poad_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.first_index(roles.zones(spark, sf_dir), roles.indicator_facts(spark, sf_dir), n_factors=3)
    return out.withColumn("index_v1", round_half_up(F.col("index_v1"), 6))


@register(
    "score_summary",
    f"""SELECT o_orderpriority AS code, count(*) AS n_values, {rnd('avg(o_totalprice)', 4)} AS mean, {rnd('median(o_totalprice)', 4)} AS median,
      min(o_totalprice) AS lowest, max(o_totalprice) AS highest, {rnd('stddev_samp(o_totalprice)', 4)} AS deviation FROM orders GROUP BY 1""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = roles.indicator_facts(spark, sf_dir)
    medians = exact_quantiles(facts, ["code"], "value", {"median": 0.5})
    spread = facts.groupBy("code").agg(
        round_half_up(F.avg("value"), 4).alias("mean"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        round_half_up(F.stddev_samp("value"), 4).alias("deviation"),
    )
    return spread.join(medians.withColumn("median", round_half_up(F.col("median"), 4)), "code")


LINKS = """links AS (
  SELECT DISTINCT o_orderpriority AS code, CASE WHEN o_orderpriority < '3' THEN 'fast' ELSE 'slow' END AS block,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(left(o_orderpriority, 1) AS DOUBLE) / 3 END AS weight FROM orders)"""


@register(
    "esg_weighted_score",
    f"""WITH {LINKS} SELECT o_custkey AS entity_id, block,
      {rnd('sum(o_totalprice * coalesce(weight, 1)) / sum(coalesce(weight, 1))', 6)} AS block_score
    FROM orders JOIN links ON code = o_orderpriority GROUP BY 1, 2""",
)
def esg_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("o_orderpriority")
    links = (
        roles.scan(spark, sf_dir, "orders")
        .select(code.alias("code"))
        .distinct()
        .withColumn("block", F.when(F.col("code") < "3", "fast").otherwise("slow"))
        .withColumn("weight", F.when(F.col("code") != "5-LOW", F.left("code", F.lit(1)).cast("double") / 3))
    )
    out = matrix.block_score(roles.indicator_facts(spark, sf_dir), materialize(links, "links"))
    return out.withColumn("block_score", round_half_up(F.col("block_score"), 6))
