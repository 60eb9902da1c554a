"""Hubs, distances, accessibility and gravity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.geo import haversine_km
from terrascore.functions.numbers import round_half_up
from terrascore.operators import distance, pairs
from terrascore.plans import access as plan
from terrascore.plans import roles
from terrascore.session import materialize, shared_folder
from terrascore.sources.tables import write_matrix
from terrascore.workloads import register
from terrascore.workloads.sql import rnd

PLACES = """
places AS (
  SELECT s_suppkey AS entity_id, s_name AS entity_name, s_acctbal AS size,
         50.0::DOUBLE + (s_suppkey * 37 % 300) / 10.0::DOUBLE AS lat,
         30.0::DOUBLE + (s_suppkey * 53 % 1500) / 10.0::DOUBLE AS lon
  FROM supplier
),
hubs AS (
  SELECT * FROM places WHERE lat IS NOT NULL AND size >= CASE
    WHEN (SELECT max(size) FROM places WHERE lat IS NOT NULL) >= 9000 THEN 9000
    WHEN (SELECT max(size) FROM places WHERE lat IS NOT NULL) >= 4000 THEN 4000 END
)"""

SHOPS = """
shops AS (
  SELECT c_custkey AS entity_id, 50.0::DOUBLE + (c_custkey * 29 % 290) / 10.0::DOUBLE AS lat,
         30.0::DOUBLE + (c_custkey * 31 % 1490) / 10.0::DOUBLE AS lon FROM customer
)"""


def km_sql(a: str, b: str) -> str:
    chord = (
        f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
        f" * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    )
    return f"round(2 * 6371.0 * atan2(sqrt(least({chord}, 1.0)), sqrt(1 - least({chord}, 1.0))), 6)"


NEAREST = f"""
near AS (
  SELECT p.entity_id, min({km_sql('p', 'h')}) AS hub_km, arg_min(h.entity_id, ({km_sql('p', 'h')}, h.entity_id)) AS hub_id
  FROM places p CROSS JOIN hubs h WHERE p.lat IS NOT NULL GROUP BY 1
),
access AS (
  SELECT p.entity_id, hub_id, hub_km, 1 / (1 + hub_km / 500.0) AS access_raw FROM places p LEFT JOIN near USING (entity_id)
)"""

CASCADE = (9000, 4000)


def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.hub_filter(roles.places(spark, sf_dir).filter(F.col("lat").isNotNull()), "size", CASCADE)


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(distance.positions(roles.places(spark, sf_dir), second=True), "positions")


@register("hub_filter", f"WITH {PLACES} SELECT entity_id, entity_name, size FROM hubs")
def hub_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hubs(spark, sf_dir).select("entity_id", "entity_name", "size")


@register(
    "haversine_km",
    f"""WITH {PLACES}, centre AS (SELECT 66.5::DOUBLE AS lat, 66.5::DOUBLE AS lon)
    SELECT entity_id, {km_sql('places', 'centre')} AS km FROM places CROSS JOIN centre""",
)
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(66.5), F.lit(66.5))
    return roles.places(spark, sf_dir).select("entity_id", F.round(km, 6).alias("km"))


@register(
    "nearest_hub",
    f"""WITH {PLACES}, {SHOPS}
    SELECT p.entity_id, min({km_sql('p', 'h')}) AS hub_km, arg_min(h.entity_id, ({km_sql('p', 'h')}, h.entity_id)) AS hub_id
    FROM shops p CROSS JOIN hubs h GROUP BY 1""",
)
def nearest_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distance.nearest_hub(roles.shops(spark, sf_dir), _hubs(spark, sf_dir))
    return found.select("entity_id", "hub_km", "hub_id")


@register(
    "nearest_hub_grid",
    f"""WITH {PLACES}, {SHOPS}, hubs2 AS (SELECT * FROM places WHERE lat IS NOT NULL)
    SELECT p.entity_id, min({km_sql('p', 'h')}) AS hub_km, arg_min(h.entity_id, ({km_sql('p', 'h')}, h.entity_id)) AS hub_id
    FROM shops p CROSS JOIN hubs2 h GROUP BY 1""",
)
def nearest_hub_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place is a hub here."""
    found = distance.nearest_hub(roles.shops(spark, sf_dir), roles.places(spark, sf_dir))
    return found.select("entity_id", "hub_km", "hub_id")


@register(
    "accessibility",
    f"""WITH {PLACES}, {NEAREST} SELECT entity_id, hub_id, (SELECT entity_name FROM places h WHERE h.entity_id = hub_id) AS hub_name, hub_km, {rnd('access_raw')} AS access_raw,
      {rnd('(access_raw - min(access_raw) OVER ()) / nullif(max(access_raw) OVER () - min(access_raw) OVER (), 0)')} AS access_score FROM access""",
)
def accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.accessibility_index(roles.places(spark, sf_dir), CASCADE)
    return out.withColumns({c: round_half_up(F.col(c), 6) for c in ("access_raw", "access_score")})


@register(
    "accessibility_index",
    f"""WITH {PLACES}, {NEAREST}, scored AS (
      SELECT *, (access_raw - min(access_raw) OVER ()) / nullif(max(access_raw) OVER () - min(access_raw) OVER (), 0) AS s FROM access)
    SELECT count(*) AS places, count(s) AS scored, {rnd('avg(s)')} AS mean_score, {rnd('min(s)')} AS min_score, {rnd('max(s)')} AS max_score,
      {rnd('stddev_samp(s)')} AS std_score, {rnd('avg(hub_km)', 4)} AS mean_km, {rnd('median(hub_km)', 5)} AS median_km, {rnd('median(s)')} AS median_score
    FROM scored""",
)
def accessibility_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrascore.operators.quantiles import exact_quantiles

    out = materialize(plan.accessibility_index(roles.places(spark, sf_dir), CASCADE), "access")
    km = exact_quantiles(out, [], "hub_km", {"m": 0.5}).select("m").scalar()
    score = exact_quantiles(out, [], "access_score", {"m": 0.5}).select("m").scalar()
    s = F.col("access_score")
    totals = out.agg(
        F.count(F.lit(1)).alias("places"),
        F.count(s).alias("scored"),
        round_half_up(F.avg(s), 6).alias("mean_score"),
        round_half_up(F.min(s), 6).alias("min_score"),
        round_half_up(F.max(s), 6).alias("max_score"),
        round_half_up(F.stddev_samp(s), 6).alias("std_score"),
        round_half_up(F.avg("hub_km"), 4).alias("mean_km"),
    )
    return totals.withColumn("median_km", round_half_up(km, 5)).withColumn("median_score", round_half_up(score, 6))


SPOTS = f"""{PLACES},
spots AS (SELECT lat, lon, min(entity_id) AS first_id, count(*) AS n FROM places WHERE lat IS NOT NULL GROUP BY 1, 2),
pairs AS (
  SELECT a.first_id AS id_a, b.first_id AS id_b, a.n * b.n AS n, {km_sql('a', 'b')} AS km
  FROM spots a JOIN spots b ON a.first_id < b.first_id
)"""


NEIGHBOURS = f"""WITH {PLACES} SELECT a.entity_id AS id_a, b.entity_id AS id_b, {km_sql('a', 'b')} AS km
    FROM places a JOIN places b ON a.entity_id < b.entity_id WHERE {km_sql('a', 'b')} <= 400"""


@register("pairwise_distance", NEIGHBOURS)
def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distance.pairwise_distance(roles.places(spark, sf_dir), 400.0)
    return out.withColumn("km", F.round("km", 6))


@register("pair_sink", NEIGHBOURS)
def pair_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours through the pair table and back; ids in the rows stand for positions in a matrix."""
    path = f"{shared_folder(spark)}/terrascore/pairs-{uuid.uuid4().hex}"
    write_matrix(pairwise_distance(spark, sf_dir), path)
    return spark.read.schema("id_a bigint, id_b bigint, km double").parquet(path)


@register(
    "spot_pairs",
    f"""WITH {SHOPS}, spots AS (SELECT lat, lon, min(entity_id) AS first_id, count(*) AS n FROM shops WHERE lat IS NOT NULL GROUP BY 1, 2)
    SELECT a.first_id AS id_a, b.first_id AS id_b, a.n AS n_a, b.n AS n_b, {km_sql('a', 'b')} AS km
    FROM spots a JOIN spots b ON a.first_id < b.first_id WHERE {km_sql('a', 'b')} <= 200""",
)
def spot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.spot_pairs(roles.shops(spark, sf_dir), 200.0).withColumn("km", F.round("km", 6))


@register(
    "spot_members",
    f"""WITH {SHOPS} SELECT entity_id, CASE WHEN lat IS NOT NULL THEN min(entity_id) OVER (PARTITION BY lat, lon) END AS spot_id FROM shops""",
)
def spot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.spot_members(roles.shops(spark, sf_dir))


@register(
    "distance_stats",
    f"""WITH {SPOTS}, every AS (SELECT unnest(range(n)) AS copy, km FROM pairs)
    SELECT count(*) AS pairs, min(km) AS min_km, max(km) AS max_km, {rnd('avg(km)', 5)} AS mean_km, {rnd('median(km)', 5)} AS median_km,
      {rnd('stddev_pop(km)', 5)} AS std_km FROM every""",
)
def distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.distance_stats(_spots(spark, sf_dir))
    return out.withColumns({c: round_half_up(F.col(c), 5) for c in ("mean_km", "median_km", "std_km")})


@register(
    "closest_furthest_pair",
    f"""WITH {PLACES}, pairs AS (
      SELECT a.entity_id AS id_a, b.entity_id AS id_b, {km_sql('a', 'b')} AS km FROM places a JOIN places b ON a.entity_id < b.entity_id
      WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL)
    SELECT 'closest' AS kind, * FROM (SELECT id_a, id_b, km FROM pairs ORDER BY km, id_a, id_b LIMIT 1)
    UNION ALL SELECT 'furthest', * FROM (SELECT id_a, id_b, km FROM pairs ORDER BY km DESC, id_a, id_b LIMIT 1)""",
)
def closest_furthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.closest_furthest_pair(_spots(spark, sf_dir))


@register(
    "market_access",
    f"""WITH {PLACES}, pulls AS (
      SELECT a.entity_id, sum(CASE WHEN {km_sql('a', 'b')} > 0 THEN abs(b.size) / {km_sql('a', 'b')} END) AS pull
      FROM places a JOIN places b ON a.lat IS NOT NULL AND b.lat IS NOT NULL GROUP BY 1)
    SELECT entity_id, {rnd('pull * 1000 / max(pull) OVER ()', 4)} AS market_access FROM places LEFT JOIN pulls USING (entity_id)""",
)
def market_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.places(spark, sf_dir).select("entity_id", "lat", "lon", F.abs("size").alias("size"))
    out = distance.market_access(rows, "size")
    return out.select("entity_id", round_half_up(F.col("market_access"), 4).alias("market_access"))
