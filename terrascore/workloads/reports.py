"""Report and dashboard products, clusters and the second index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrascore.functions.numbers import banded, round_half_up
from terrascore.functions.text import entity_label, shorten, thousands, type_score, yes_no
from terrascore.operators import distance, matrix, ranking, summaries
from terrascore.plans import dashboard, indicators, roles, second
from terrascore.plans.composite import COMPONENTS
from terrascore.session import materialize
from terrascore.workloads import register
from terrascore.workloads.index import index_frame
from terrascore.workloads.indicators import IMPUTED
from terrascore.workloads.places import PLACES, SHOPS, _hubs, km_sql
from terrascore.workloads.sql import INDEX, rnd

SCORES = [f"{c}_score" for c in COMPONENTS]
BANDS = [(3.0, "critical"), (4.5, "low"), (6.5, "middle")]
_BAND = "CASE WHEN index_10 < 3.0 THEN 'critical' WHEN index_10 < 4.5 THEN 'low' WHEN index_10 < 6.5 THEN 'middle' ELSE 'high' END"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(index_frame(spark, sf_dir), "index")


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in cols})


@register("region_stats", f"{INDEX} SELECT region_name, {rnd('avg(index_score)')} AS mean_score, count(*) AS entities FROM index_view GROUP BY 1")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.region_stats(index_frame(spark, sf_dir), "index_score")
    return _rounded(out, 6, "mean_score").orderBy(F.col("mean_score").desc(), "region_name")


@register(
    "zone_compare",
    f"""{INDEX}, m AS (SELECT count(*) FILTER (is_zone) AS zone_count, count(*) FILTER (NOT is_zone) AS other_count,
      avg(index_10) FILTER (is_zone) AS zm, avg(index_10) FILTER (NOT is_zone) AS om FROM index_view)
    SELECT zone_count, other_count, {rnd('zm')} AS zone_mean, {rnd('om')} AS other_mean, {rnd('abs(zm - om)')} AS difference,
      CASE WHEN zm > om THEN 'zone' ELSE 'other' END AS higher FROM m""",
)
def zone_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.zone_compare(index_frame(spark, sf_dir), "index_10"), 6, "zone_mean", "other_mean", "difference")


@register(
    "kpi_summary",
    f"""{INDEX}, p AS (SELECT o_custkey AS entity_id, arg_max(p, y) AS population FROM
      (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS p FROM orders GROUP BY 1, 2) GROUP BY 1)
    SELECT count(*) AS entities, count(DISTINCT region_name) AS regions, min(index_10) AS min_score, max(index_10) AS max_score,
      {rnd('avg(index_10)')} AS mean_score, {rnd('sum(population)', 2)} AS total_size, count(*) FILTER (is_zone) AS zone_count
    FROM index_view LEFT JOIN p USING (entity_id)""",
)
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = roles.zones(spark, sf_dir).select("entity_id", "population")
    out = summaries.kpi_summary(index_frame(spark, sf_dir).join(sized, "entity_id", "left"), "index_10", "population")
    return _rounded(_rounded(out, 6, "mean_score"), 2, "total_size")


@register(
    "critical_summary",
    f"""{INDEX} SELECT count(*) FILTER (index_10 < 4.0) AS critical, {rnd('count(*) FILTER (index_10 < 4.0) / count(*)')} AS share,
      min(index_10) FILTER (index_10 < 4.0) AS lowest, max(index_10) FILTER (index_10 < 4.0) AS highest,
      coalesce((SELECT string_agg(region_name, ', ' ORDER BY region_name) FROM (SELECT DISTINCT region_name FROM index_view WHERE index_10 < 4.0)), '') AS regions
    FROM index_view""",
)
def critical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.critical_summary(index_frame(spark, sf_dir), "index_10", 4.0), 6, "share")


@register("critical_band", f"{INDEX} SELECT entity_id, region_name, index_10, index_score_100 FROM index_view WHERE index_10 < 4.0 OR index_score_100 < 40")
def critical_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_frame(spark, sf_dir)
    return index.filter((F.col("index_10") < 4.0) | (F.col("index_score_100") < 40)).select(
        "entity_id", "region_name", "index_10", "index_score_100"
    )


@register("band_counts", f"{INDEX} SELECT region_name, is_zone, {_BAND} AS band, count(*) AS entities FROM index_view GROUP BY ALL")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.band_counts(index_frame(spark, sf_dir), banded(F.col("index_10"), BANDS, "high"))


@register(
    "box_stats",
    f"""{INDEX}, q AS (SELECT is_zone, quantile_cont(index_10, 0.25) AS q1, quantile_cont(index_10, 0.5) AS q2, quantile_cont(index_10, 0.75) AS q3
      FROM index_view GROUP BY 1)
    SELECT is_zone, {rnd('q1')} AS q1, {rnd('q2')} AS q2, {rnd('q3')} AS q3,
      min(index_10) FILTER (index_10 >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(index_10) FILTER (index_10 <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
      {rnd('avg(index_10)')} AS mean, {rnd('stddev_samp(index_10)')} AS deviation FROM index_view JOIN q USING (is_zone) GROUP BY is_zone, q.q1, q.q2, q.q3""",
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.box_stats(_index(spark, sf_dir).select("is_zone", "index_10"), "is_zone", "index_10")
    return _rounded(out, 6, "q1", "q2", "q3", "mean", "deviation")


@register(
    "region_rollup",
    """SELECT n_regionkey::VARCHAR AS region_name, c_custkey AS entity_id, round(sum(c_acctbal), 2) AS total_size, count(*) AS entities,
      CASE grouping(n_regionkey) + grouping(c_custkey) WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INTEGER AS level
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_custkey)""",
)
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.settlements(spark, sf_dir).join(
        roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("size")), "entity_id"
    )
    out = summaries.region_rollup(rows.withColumn("region_name", F.col("region_id").cast("string")), "size")
    return _rounded(out, 2, "total_size")


_MEANS = ", ".join(f"{rnd(f'avg({c})')} AS {c}" for c in ["index_10", *SCORES])


@register(
    "component_baselines",
    f"""{INDEX}, regional AS (SELECT region_name, {_MEANS}, count(*) AS entities, avg(index_10) AS lead FROM index_view GROUP BY 1)
    SELECT * EXCLUDE (lead), region_name = (SELECT region_name FROM regional ORDER BY lead DESC, region_name LIMIT 1) AS is_best, 'region' AS scope FROM regional
    UNION ALL SELECT NULL, {_MEANS}, count(*), false, 'all' FROM index_view""",
)
def component_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.component_baselines(_index(spark, sf_dir)), 6, "index_10", *SCORES)


_WEIGHTS = {"quality": 0.35, "market": 0.20, "consumption": 0.15, "access": 0.15, "climate": 0.10, "mobility": 0.05}
_BASE = "base AS (SELECT {group}, avg(index_10) AS b, " + ", ".join(f"avg({c}) AS b_{c}" for c in SCORES) + " FROM index_view GROUP BY {by})"


def _waterfall_sql(entity: str, score: str, total: str, source: str) -> str:
    steps = [f"SELECT {entity}0 AS step, 'baseline' AS label, {rnd('b')} AS value FROM {source}"]
    for i, (c, w) in enumerate(_WEIGHTS.items(), 1):
        moved = rnd(f"{score.format(c=c)} * {w}::DOUBLE * 10 - b * {w}::DOUBLE")
        steps.append(f"SELECT {entity}{i}, '{c}', {moved} FROM {source}")
    steps.append(f"SELECT {entity}7, 'total', {rnd(total)} FROM {source}")
    return f"SELECT * REPLACE (CAST(step AS BIGINT) AS step) FROM ({' UNION ALL '.join(steps)})"


@register(
    "waterfall",
    f"{INDEX}, {_BASE.format(group='region_name', by='1')}, w AS (SELECT * FROM index_view JOIN base USING (region_name)) "
    + _waterfall_sql("entity_id, ", "{c}_score", "index_10", "w"),
)
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.waterfall(_index(spark, sf_dir), "regional"), 6, "value")


@register(
    "waterfall_national",
    f"{INDEX}, {_BASE.format(group='1 AS one', by='1')}, w AS (SELECT * FROM index_view CROSS JOIN base) "
    + _waterfall_sql("entity_id, ", "{c}_score", "index_10", "w"),
)
def waterfall_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.waterfall(_index(spark, sf_dir), "national"), 6, "value")


@register("waterfall_average", f"{INDEX}, {_BASE.format(group='1 AS one', by='1')} " + _waterfall_sql("", "b_{c}_score", "b", "base"))
def waterfall_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.average_waterfall(_index(spark, sf_dir)), 6, "value")


@register(
    "radar",
    f"{INDEX}, {_BASE.format(group='region_name', by='1')}, w AS (SELECT * FROM index_view JOIN base USING (region_name)) "
    + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS component, {c}_score AS value, {rnd(f'b_{c}_score')} AS baseline FROM w" for c in COMPONENTS),
)
def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.radar(_index(spark, sf_dir), "regional"), 6, "baseline")


@register(
    "radar_national",
    f"{INDEX}, every AS (SELECT {', '.join(f'avg({c}) AS b_{c}' for c in SCORES)} FROM index_view), w AS (SELECT * FROM index_view CROSS JOIN every) "
    + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS component, {c}_score AS value, {rnd(f'b_{c}_score')} AS baseline FROM w" for c in COMPONENTS),
)
def radar_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity against the mean of all."""
    return _rounded(dashboard.radar(_index(spark, sf_dir), "national"), 6, "baseline")


@register(
    "radar_best_region",
    f"""{INDEX}, {_BASE.format(group='region_name', by='1')},
    best AS (SELECT * FROM base ORDER BY b DESC, region_name LIMIT 1),
    every AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in SCORES)} FROM index_view) """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS component, {rnd(f'b_{c}_score')} AS value, {rnd(f'{c}_score')} AS baseline FROM best CROSS JOIN every" for c in COMPONENTS
    ),
)
def radar_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.best_region_radar(_index(spark, sf_dir)), 6, "value", "baseline")


@register("filter_index", f"{INDEX} SELECT * FROM index_view WHERE region_name = 'ASIA' AND is_zone")
def filter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.filter_index(index_frame(spark, sf_dir), region="ASIA", zone="yes")


@register(
    "search_entities",
    f"""{INDEX}, labelled AS (SELECT entity_id, index_rank, printf('%s (%s) — index %.2f', entity_name, region_name, index_10) AS label FROM index_view),
    found AS (SELECT * FROM labelled WHERE contains(lower(label), lower('Asia) — INDEX 5.1')))
    SELECT *, entity_id = (SELECT entity_id FROM found ORDER BY index_rank, entity_id LIMIT 1) AS selected FROM found""",
)
def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.search_entities(_index(spark, sf_dir), "Asia) — INDEX 5.1")


@register("sort_table", f"{INDEX} SELECT entity_id, entity_name, degree_days, is_zone FROM index_view ORDER BY degree_days NULLS LAST")
def sort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sort_table(index_frame(spark, sf_dir).select("entity_id", "entity_name", "degree_days", "is_zone"), "degree_days")


@register(
    "display_rows",
    f"{INDEX} SELECT entity_id, is_zone, {', '.join(f'{rnd(f'{c}_score * 100', 4)} AS {c}_score_100' for c in COMPONENTS)} FROM index_view",
)
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dashboard.display_rows(index_frame(spark, sf_dir))
    return _rounded(out, 4, *[f"{c}_score_100" for c in COMPONENTS]).select("entity_id", "is_zone", *[f"{c}_score_100" for c in COMPONENTS])


@register("distinct_regions", "SELECT DISTINCT r_name AS region_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def distinct_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = roles.settlements(spark, sf_dir).select("region_id").distinct()
    return base.join(roles.regions(spark, sf_dir), "region_id").select("region_name").orderBy("region_name")


@register(
    "top_bottom_n",
    f"""{INDEX}, t AS (SELECT entity_id, index_score, 'top' AS list, row_number() OVER (ORDER BY index_score DESC, entity_id) AS place FROM index_view),
    b AS (SELECT entity_id, index_score, 'bottom' AS list, row_number() OVER (ORDER BY index_score, entity_id) AS place FROM index_view)
    SELECT * FROM t WHERE place <= 15 UNION ALL SELECT * FROM b WHERE place <= 15""",
)
def top_bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_bottom_n(_index(spark, sf_dir).select("entity_id", "index_score"), "index_score", "entity_id", 15)


@register(
    "top_table",
    f"""{INDEX}, p AS (SELECT o_custkey AS entity_id, arg_max(p, y) AS population FROM
      (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS p FROM orders GROUP BY 1, 2) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY index_10 DESC, entity_id) AS place,
      CASE WHEN length(entity_name) > 12 THEN substring(entity_name, 1, 12) || '...' ELSE entity_name END AS name,
      format('{{:,}}', CAST({rnd('population', 0)} AS BIGINT)) AS population,
      printf('%.2f', index_10) AS score, CASE WHEN is_zone THEN 'Да' ELSE 'Нет' END AS zone
    FROM index_view LEFT JOIN p USING (entity_id) ORDER BY 1 LIMIT 20""",
)
def top_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.top_n(index_frame(spark, sf_dir), F.col("index_10").desc(), 20, "entity_id")
    sized = top.join(roles.zones(spark, sf_dir).select("entity_id", "population"), "entity_id", "left")
    place = F.row_number().over(Window.orderBy(F.col("index_10").desc(), "entity_id")).cast("bigint")
    return sized.select(
        place.alias("place"),
        shorten(F.col("entity_name"), 12).alias("name"),
        thousands(F.col("population")).alias("population"),
        F.format_string("%.2f", "index_10").alias("score"),
        yes_no(F.col("is_zone")).alias("zone"),
    )


_CONTRAST = " UNION ALL ".join(
    f"SELECT '{c}' AS metric, {rnd(f'avg(t.{c})')} AS top_mean, {rnd(f'avg(b.{c})')} AS bottom_mean, {rnd(f'avg(t.{c}) - avg(b.{c})')} AS difference FROM t, b" for c in SCORES
)


@register(
    "top_bottom_contrast",
    f"""{INDEX}, t AS (SELECT * FROM index_view ORDER BY index_rank, entity_id LIMIT 10),
    b AS (SELECT * FROM index_view ORDER BY index_rank DESC, entity_id DESC LIMIT 10) {_CONTRAST}""",
)
def top_bottom_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.top_bottom_contrast(_index(spark, sf_dir), "index_rank", SCORES)
    return _rounded(out, 6, "top_mean", "bottom_mean", "difference")


@register(
    "component_correlation",
    f"{INDEX} " + " UNION ALL ".join(
        f"SELECT '{a}' AS code_a, '{b}' AS code_b, {rnd(f'corr({a}, {b})', 5)} AS r FROM index_view" for a in SCORES for b in SCORES
    ),
)
def component_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.correlation_matrix(_index(spark, sf_dir).select(*SCORES), SCORES), 5, "r")


@register(
    "quality_counts",
    f"""WITH {PLACES} SELECT count(*) AS entities, count(lat) AS with_coordinates, count(*) FILTER (entity_id % 3 = 0) AS zone_count,
      count(*) FILTER (entity_id % 3 <> 0) AS other_count, (SELECT count(*) FROM orders) AS facts,
      (SELECT count(DISTINCT o_orderpriority) FROM orders) AS indicators,
      (SELECT count(*) FROM orders WHERE o_totalprice < 5000) AS missing_values FROM places""",
)
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = roles.places(spark, sf_dir).withColumn("is_zone", F.col("entity_id") % 3 == 0)
    facts = roles.indicator_facts(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 5000, F.col("value")))
    return summaries.quality_counts(entities, facts)


# -- clusters -----------------------------------------------------------------------

CLUSTERED = """
population AS (SELECT o_custkey AS entity_id, arg_max(p, y) AS population FROM
  (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS p FROM orders GROUP BY 1, 2) GROUP BY 1),
clustered AS (
  SELECT c_custkey AS entity_id, c_name AS entity_name, r_name AS region_name, c_nationkey % 3 = 0 AS is_zone, population,
         CASE WHEN c_custkey = 7 THEN 99 ELSE c_nationkey % 7 END AS cluster_id, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN population ON entity_id = c_custkey)"""

SIZE_BANDS = (500_000.0, 460_000.0, 440_000.0, 400_000.0)
PATTERN = "ASIA|EUROPE"

DESCRIBED = f"""{CLUSTERED},
counts AS (SELECT cluster_id, region_name, count(*) AS n FROM clustered GROUP BY 1, 2),
described AS (
  SELECT cluster_id, count(*) AS entities, avg(population) AS mean_population, avg(CAST(is_zone AS INT)) AS zone_share,
         avg(CAST(regexp_matches(region_name, '{PATTERN}') AS INT)) AS pattern_share,
         (SELECT region_name FROM counts k WHERE k.cluster_id = c.cluster_id ORDER BY n DESC, region_name LIMIT 1) AS modal_region,
         min(entity_name) AS first_name
  FROM clustered c GROUP BY 1),
based AS (
  SELECT cluster_id, CASE WHEN entities = 1 THEN 'Аномалия: ' || first_name
    WHEN mean_population > 500000 THEN CASE WHEN pattern_share > 0.5 THEN 'Нефтегазовые посёлки (ХМАО/ЯНАО)' ELSE 'Крупные ПГТ/города' END
    WHEN mean_population > 460000 THEN CASE WHEN zone_share > 0.5 THEN 'Арктические центры' ELSE 'Средние города/ПГТ' END
    WHEN mean_population > 440000 THEN CASE WHEN zone_share > 0.5 THEN 'Арктические сёла' WHEN pattern_share > 0.5 THEN 'Малые нефтегазовые ПГТ' ELSE 'Стабильные сёла' END
    WHEN mean_population > 400000 THEN CASE WHEN zone_share > 0.5 THEN 'Малые арктические НП' ELSE 'Сельские поселения' END
    ELSE 'Малые изолированные НП' END AS base FROM described),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster_id) - 1 AS again FROM based),
names AS (SELECT cluster_id, base || CASE WHEN again > 0 THEN ' (вар.' || again || ')' ELSE '' END AS cluster_name FROM numbered)"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = F.when(F.col("c_custkey") == 7, 99).otherwise(F.col("c_nationkey") % 7)
    own = roles.scan(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"), cluster.alias("cluster_id"), F.col("c_acctbal").alias("balance")
    )
    return roles.zones(spark, sf_dir).join(own, "entity_id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.cluster_names(summaries.cluster_descriptors(_clustered(spark, sf_dir), PATTERN), SIZE_BANDS)


@register(
    "cluster_stats",
    f"""WITH {CLUSTERED} SELECT cluster_id, count(*) AS entities, {rnd('avg(population)', 4)} AS mean_population, {rnd('sum(population)', 2)} AS total_population,
      count(*) FILTER (is_zone) AS zone_count, {rnd('avg(balance)', 4)} AS mean_balance FROM clustered GROUP BY 1""",
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.cluster_stats(_clustered(spark, sf_dir), ["balance"])
    return _rounded(_rounded(out, 4, "mean_population", "mean_balance"), 2, "total_population")


@register(
    "cluster_descriptors",
    f"""WITH {DESCRIBED} SELECT cluster_id, entities, {rnd('mean_population', 4)} AS mean_population, {rnd('zone_share')} AS zone_share,
      {rnd('pattern_share')} AS pattern_share, modal_region, first_name FROM described""",
)
def cluster_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.cluster_descriptors(_clustered(spark, sf_dir), PATTERN)
    return _rounded(_rounded(out, 4, "mean_population"), 6, "zone_share", "pattern_share")


@register("cluster_names", f"WITH {DESCRIBED} SELECT * FROM names")
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


@register("cluster_label", f"WITH {DESCRIBED} SELECT cluster_id, base AS label FROM based")
def cluster_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.cluster_descriptors(_clustered(spark, sf_dir), PATTERN)
    return found.select("cluster_id", summaries.cluster_label(SIZE_BANDS).alias("label"))


@register(
    "cluster_profiles",
    f"""WITH {DESCRIBED}, m AS (
      SELECT cluster_id, count(*) AS entities, avg(population) AS population, avg(balance) AS balance FROM clustered GROUP BY 1)
    SELECT cluster_id, cluster_name, entities, code, {rnd('value', 4)} AS mean_value
    FROM (SELECT cluster_id, entities, 'population' AS code, population AS value FROM m UNION ALL SELECT cluster_id, entities, 'balance', balance FROM m)
    JOIN names USING (cluster_id) WHERE value IS NOT NULL""",
)
def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.cluster_profiles(_clustered(spark, sf_dir), _names(spark, sf_dir), ["population", "balance"])
    flat = out.select("cluster_id", "cluster_name", "entities", F.explode("mean_values").alias("code", "mean_value"))
    return _rounded(flat, 4, "mean_value")


@register(
    "cluster_metrics",
    f"""WITH {CLUSTERED} SELECT cluster_id, 'population' AS metric, {rnd('avg(population)', 4)} AS value FROM clustered GROUP BY 1
    UNION ALL SELECT cluster_id, 'balance', {rnd('avg(balance) * 10', 4)} FROM clustered GROUP BY 1""",
)
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.cluster_metrics(_clustered(spark, sf_dir), {"population": 1, "balance": 10}), 4, "value")


@register(
    "cluster_examples",
    f"""WITH {CLUSTERED}, n AS (SELECT cluster_id, entity_name, population,
      row_number() OVER (PARTITION BY cluster_id ORDER BY population DESC NULLS LAST, entity_id) AS place FROM clustered)
    SELECT cluster_id, entity_name, {rnd('population', 2)} AS population, place FROM n WHERE place <= 3""",
)
def cluster_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("population").desc_nulls_last(), F.col("entity_id")]
    top = ranking.top_per_group(_clustered(spark, sf_dir), "cluster_id", order, 3)
    return _rounded(top.select("cluster_id", "entity_name", "population", "place"), 2, "population")


# -- second index -------------------------------------------------------------------

TYPES = [(("house", "hold"), 1.0), (("mach",), 0.85), (("auto", "build"), 1.0), (("furn",), 0.7)]
_TYPE = """CASE WHEN lower(c_mktsegment) LIKE '%house%' OR lower(c_mktsegment) LIKE '%hold%' THEN 1.0 WHEN lower(c_mktsegment) LIKE '%mach%' THEN 0.85
  WHEN lower(c_mktsegment) LIKE '%auto%' OR lower(c_mktsegment) LIKE '%build%' THEN 1.0 WHEN lower(c_mktsegment) LIKE '%furn%' THEN 0.7 ELSE 0.6 END::DOUBLE"""

SECOND = f"""{IMPUTED}, {PLACES}, {SHOPS},
near AS (SELECT p.entity_id, min({km_sql('p', 'h')}) AS hub_km FROM shops p CROSS JOIN hubs h GROUP BY 1),
raw_access AS (SELECT entity_id, hub_km, 1 / (1 + hub_km / 500.0) AS a FROM near),
access AS (SELECT entity_id, hub_km, (a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0) AS access_score FROM raw_access),
parts AS (
  SELECT c_custkey AS entity_id, index_v1, access_score, hub_km, {_TYPE} AS type_score,
         CASE WHEN max(index_v1) OVER () = min(index_v1) OVER () THEN 0.5 ELSE (index_v1 - min(index_v1) OVER ()) / (max(index_v1) OVER () - min(index_v1) OVER ()) END AS first_scaled
  FROM customer JOIN first_index ON entity_id = c_custkey LEFT JOIN access ON access.entity_id = c_custkey),
second AS (SELECT *, 0.60 * first_scaled + 0.30 * access_score + 0.10 * type_score AS index_v2 FROM parts),
compared AS (SELECT *, index_v2 - first_scaled AS delta, rank() OVER (ORDER BY round(index_v1, 12) DESC) AS rank_old,
  rank() OVER (ORDER BY round(index_v2, 12) DESC) AS rank_new FROM second)"""


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = roles.zones(spark, sf_dir)
    first = indicators.first_index(entities, roles.indicator_facts(spark, sf_dir), n_factors=3)
    near = materialize(distance.nearest_hub(roles.shops(spark, sf_dir), _hubs(spark, sf_dir)), "nearest-hub")
    access = distance.accessibility(near)
    return second.second_index(entities.select("entity_id", "entity_type"), first, access, rules=TYPES)


@register("infrastructure_score", f"SELECT c_custkey AS entity_id, c_mktsegment AS entity_type, {_TYPE} AS type_score FROM customer")
def infrastructure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("entity_type"))
    return rows.withColumn("type_score", type_score(F.col("entity_type"), TYPES))


@register(
    "attractiveness_v2",
    f"""WITH {SECOND} SELECT entity_id, {rnd('index_v1')} AS index_v1, {rnd('first_scaled')} AS first_scaled, {rnd('access_score')} AS access_score,
      type_score, {rnd('index_v2')} AS index_v2, {rnd('index_v2 * 10')} AS index_v2_10, {rnd('delta')} AS delta,
      CAST(rank_old AS BIGINT) AS rank_old, CAST(rank_new AS BIGINT) AS rank_new, CAST(rank_old - rank_new AS BIGINT) AS rank_change FROM compared""",
)
def attractiveness_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _second(spark, sf_dir)
    cols = ["entity_id", "index_v1", "first_scaled", "access_score", "type_score", "index_v2", "index_v2_10", "delta", "rank_old", "rank_new", "rank_change"]
    return _rounded(out, 6, "index_v1", "first_scaled", "access_score", "index_v2", "index_v2_10", "delta").select(*cols)


@register(
    "rank_change",
    f"""WITH {SECOND}, up AS (SELECT entity_id, {rnd('delta')} AS delta, rank_old - rank_new AS moved FROM compared)
    SELECT * REPLACE (CAST(moved AS BIGINT) AS moved) FROM (
      SELECT *, 'top' AS list, row_number() OVER (ORDER BY delta DESC, entity_id) AS place FROM up
      UNION ALL SELECT *, 'bottom', row_number() OVER (ORDER BY delta, entity_id) FROM up) WHERE place <= 10""",
)
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _rounded(_second(spark, sf_dir), 6, "delta").select("entity_id", "delta", F.col("rank_change").alias("moved"))
    return ranking.top_bottom_n(materialize(moved, "moves"), "delta", "entity_id", 10)


@register(
    "entity_labels",
    f"{INDEX} SELECT entity_id, printf('%s (%s) — index %.2f', entity_name, region_name, index_10) AS label FROM index_view",
)
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = entity_label(F.col("entity_name"), F.col("region_name"), F.col("index_10"))
    return index_frame(spark, sf_dir).select("entity_id", label.alias("label"))
