"""Distances between places: nearest hub, neighbours, gravity; ``operators/pairs.py`` has the statistics over all pairs.

Places that share coordinates are collapsed to one position with a count, so a
crowded spot costs one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.functions.geo import EARTH_RADIUS_KM, haversine_km
from terrascore.functions.numbers import distance_decay
from terrascore.operators.grid import cell_box, cell_of
from terrascore.operators.joins import lookup_join
from terrascore.operators.pairs import gravity
from terrascore.operators.scaling import minmax_scale
from terrascore.session import materialize

KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180
CELL_HUBS = 16


def positions(
    df: DataFrame, entity: str = "entity_id", lat: str = "lat", lon: str = "lon", mass: str | None = None, second: bool = False
) -> DataFrame:
    """One row per distinct coordinate: ``lat, lon, first_id, n, mass``.

    Rows without coordinates are left out. With ``second`` also the next
    smallest id at the same spot (or null); every task passes on at most two
    ids per spot, however crowded it is.
    """
    placed = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    at = [F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")]
    weight = F.sum(mass) if mass else F.count(F.lit(1)).cast("double")
    spots = placed.groupBy(*at).agg(F.min(entity).alias("first_id"), F.count(F.lit(1)).alias("n"), weight.alias("mass"))
    if not second:
        return spots
    place = F.row_number().over(Window.partitionBy("_la", "_lo").orderBy("_id"))
    firsts = placed.select(at[0].alias("_la"), at[1].alias("_lo"), F.col(entity).alias("_id")).withColumn("_place", place).filter("_place <= 2")
    seconds = firsts.groupBy("_la", "_lo").agg(F.max(F.when(F.col("_place") == 2, F.col("_id"))).alias("second_id"))
    return spots.join(seconds, (F.col("lat") == F.col("_la")) & (F.col("lon") == F.col("_lo")), "left").drop("_la", "_lo")


# -- nearest hub --------------------------------------------------------------------


def hub_filter(df: DataFrame, size: str, cascade: Sequence[float] = (10_000, 5_000)) -> DataFrame:
    """Rows at or above the first threshold of the cascade that any row reaches."""
    reached = None
    for t in cascade:
        reached = (F if reached is None else reached).when(F.count_if(F.col(size) >= t) > 0, F.lit(float(t)))
    chosen = df.agg(reached.alias("chosen")).scalar()
    return df.filter(F.col(size) >= chosen)


def nearest_hub(df: DataFrame, hubs: DataFrame) -> DataFrame:
    """Add ``hub_id, hub_km``: the closest hub, ties to the smallest id.

    Both frames have ``entity_id, lat, lon``; a hub is its own nearest. Without
    any hub the nearest other entity counts. Rows without coordinates get null.
    """
    hub_spots = materialize(
        hubs.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(F.col("lat").cast("double").alias("hub_lat"), F.col("lon").cast("double").alias("hub_lon"))
        .agg(F.min("entity_id").alias("hub_id")),
        "hub-spots",
    )
    if hub_spots.isEmpty():
        return _nearest_other(df)
    spots = materialize(
        df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")),
        "spots",
    )
    found = _nearest_by_cells(spots, hub_spots)
    return lookup_join(df, materialize(found, "nearest"), ["lat", "lon"], "n")


def _fullest_cell(hub_spots: DataFrame, size: float) -> int:
    cells = hub_spots.groupBy(cell_of(F.col("hub_lat"), F.col("hub_lon"), size)).count()
    return cells.agg(F.max("count")).head()[0]


def _nearest_by_cells(spots: DataFrame, hub_spots: DataFrame, others: bool = False) -> DataFrame:
    """Branch and bound over ever finer grid cells.

    At each level a spot cell keeps only the hub cells that can still hold its
    nearest hub; the hubs of the last level are then measured exactly. With
    ``others`` the spots are hubs themselves and none counts as its own.
    """
    sizes = [30.0, 7.5]
    # refine until the fullest cell holds few hubs; below a few centimetres cell numbers no longer fit
    while sizes[-1] > 2e-6 and _fullest_cell(hub_spots, sizes[-1]) > CELL_HUBS:
        sizes.append(sizes[-1] / 4)
    finest = sizes[-1]
    a = spots.select(cell_of(F.col("lat"), F.col("lon"), finest).alias("a")).distinct()
    h = hub_spots.groupBy(cell_of(F.col("hub_lat"), F.col("hub_lon"), finest).alias("h")).agg(F.count(F.lit(1)).alias("held"))
    a_cells = materialize(_pyramid(a, "a", sizes), "spot-cells")
    h_cells = materialize(_pyramid(h, "h", sizes, "held"), "hub-cells")

    # at most 6 x 12 cells of 30 degrees exist, so this start is tiny whatever the data
    coarse = h_cells.groupBy("h0").agg(F.sum("held").alias("held"))
    top = coarse.agg(F.collect_list(F.struct("h0", "held"))).scalar()
    pairs = a_cells.select("a0").distinct().withColumn("_top", top).select("a0", F.inline("_top"))
    pairs = _prune(pairs, sizes[0], 0, others)
    for level in range(1, len(sizes)):
        kids_a = a_cells.select(f"a{level - 1}", f"a{level}").distinct()
        kids_h = h_cells.groupBy(f"h{level - 1}", f"h{level}").agg(F.sum("held").alias("held"))
        grown = pairs.join(kids_a, f"a{level - 1}").join(kids_h, f"h{level - 1}").select(f"a{level}", f"h{level}", "held")
        pairs = _prune(grown, sizes[level], level, others)
    last = len(sizes) - 1
    candidates = pairs.select(F.col(f"a{last}").alias("a"), F.col(f"h{last}").alias("h"))

    # spots meet the hubs of the cells that can hold their nearest one, as rows; a minimum per spot is left
    placed = spots.withColumn("a", cell_of(F.col("lat"), F.col("lon"), finest))
    hubs = hub_spots.withColumn("h", cell_of(F.col("hub_lat"), F.col("hub_lon"), finest))
    met = placed.join(materialize(candidates, "cell-pairs"), "a").join(hubs, "h")
    if others:
        met = met.filter(F.col("hub_id") != F.col("first_id"))
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("hub_lat"), F.col("hub_lon")), 6)
    nearest = met.groupBy("lat", "lon").agg(F.max("n").alias("n"), F.min(F.struct(km.alias("hub_km"), "hub_id")).alias("_b"))
    return nearest.select("lat", "lon", "n", "_b.hub_id", "_b.hub_km")


def _pyramid(cells: DataFrame, name: str, sizes: Sequence[float], *keep: str) -> DataFrame:
    """For each finest cell its enclosing cell at every level."""
    lat, lon, _ = cell_box(F.col(name), sizes[-1])
    above = [cell_of(lat, lon, size).alias(f"{name}{i}") for i, size in enumerate(sizes[:-1])]
    return cells.select(*above, F.col(name).alias(f"{name}{len(sizes) - 1}"), *keep)


def _prune(pairs: DataFrame, size: float, level: int, others: bool) -> DataFrame:
    """Drop hub cells that lie farther away than some hub is sure to be."""
    a, h = f"a{level}", f"h{level}"
    a_lat, a_lon, a_r = cell_box(F.col(a), size)
    h_lat, h_lon, h_r = cell_box(F.col(h), size)
    measured = pairs.withColumn("_d", haversine_km(a_lat, a_lon, h_lat, h_lon)).withColumn("_r", a_r + h_r)
    # a cell's only hub may be the spot itself, which promises nothing about others
    sure = F.col("_d") + F.col("_r")
    promised = F.when((F.col(a) != F.col(h)) | (F.col("held") > 1), sure) if others else sure
    bound = F.min(promised).over(Window.partitionBy(a))
    near = F.col("_bound").isNull() | (F.col("_d") - F.col("_r") <= F.col("_bound"))
    return measured.withColumn("_bound", bound).filter(near).select(a, h)


def _nearest_other(df: DataFrame) -> DataFrame:
    """Nearest other entity for every entity."""
    spots = materialize(positions(df, second=True), "positions")
    alone = spots.filter(F.col("second_id").isNull())
    every = spots.select(F.col("lat").alias("hub_lat"), F.col("lon").alias("hub_lon"), F.col("first_id").alias("hub_id"))
    best = _nearest_by_cells(alone, every, others=True)
    shared = spots.filter(F.col("second_id").isNotNull()).select("lat", "lon", "n", "first_id", "second_id")
    none = F.lit(None).cast("bigint")
    found = best.select("lat", "lon", "n", "hub_id", "hub_km", none.alias("first_id"), none.alias("second_id")).unionByName(
        shared.withColumns({"hub_id": none, "hub_km": F.lit(0.0)})
    )
    joined = lookup_join(df, materialize(found, "nearest"), ["lat", "lon"], "n")
    # at a shared spot the nearest other is the smallest id that is not one's own
    twin = F.when(F.col("entity_id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
    return joined.withColumn("hub_id", F.coalesce("hub_id", twin)).drop("first_id", "second_id")


def accessibility(df: DataFrame, scale_km: float = 500.0) -> DataFrame:
    """Add ``access_raw`` = 1 / (1 + km / scale) and ``access_score``, its min-max scaling."""
    decayed = df.withColumn("access_raw", distance_decay(F.col("hub_km"), scale_km))
    return minmax_scale(decayed, ["access_raw"]).withColumnRenamed("access_raw_scaled", "access_score")


# -- neighbours ---------------------------------------------------------------------


#: Most rows of either side that one key of the neighbour join should hold.
BLOCK_ROWS = 1_000


def pairwise_distance(df: DataFrame, max_km: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_a, id_b, km`` for every two entities at most ``max_km`` apart, also at one spot, smaller id first.

    The pairs of an entity at a spot with n others are n rows; ``spot_pairs`` and ``spot_members`` hold the same in linear space.
    """
    placed = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    spots = placed.select(F.col("entity_id").alias("first_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return _near_pairs(spots, max_km, block_rows)


def spot_pairs(df: DataFrame, max_km: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_a, id_b, n_a, n_b, km`` for every two different spots at most ``max_km`` apart, named by their smallest entity.

    Every entity of one spot is that far from every entity of the other; ``spot_members`` tells who they are.
    """
    spots = materialize(positions(df).select("first_id", "lat", "lon", "n"), "spots")
    pairs = _near_pairs(spots.drop("n"), max_km, block_rows)
    for side in ("a", "b"):
        pairs = pairs.join(spots.select(F.col("first_id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}")), f"id_{side}")
    return pairs.select("id_a", "id_b", "n_a", "n_b", "km")


def spot_members(df: DataFrame) -> DataFrame:
    """``entity_id, spot_id``: the smallest entity at the same spot; null without coordinates."""
    at = {"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")}
    spots = materialize(positions(df).select("lat", "lon", "n", F.col("first_id").alias("spot_id")), "spots")
    return lookup_join(df.select("entity_id", "lat", "lon").withColumns(at), spots, ["lat", "lon"], "n").select("entity_id", "spot_id")


def _near_pairs(spots: DataFrame, max_km: float, block_rows: int) -> DataFrame:
    """``id_a, id_b, km`` of any two rows at most ``max_km`` apart.

    An equality join on grid cells: each row visits the cells its radius touches, so far pairs are never formed. Crowded cells are
    split by ``_blocks``.
    """
    visiting, resident = _blocks(*_cell_sides(spots, max_km), block_rows)
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return (
        visiting.join(resident, ["cell", "part_a", "part_b"])
        .filter(F.col("id_a") < F.col("id_b"))
        .withColumn("km", km)
        .filter(F.col("km") <= max_km)
        .select("id_a", "id_b", "km")
    )


def _cell_sides(spots: DataFrame, max_km: float) -> tuple[DataFrame, DataFrame]:
    """Rows by the cells they visit, and rows by the one cell they lie in."""
    reach = max_km / KM_PER_DEGREE
    size = max(reach, 0.01)
    # whole columns only, so that wrapping past 180 degrees stays aligned
    columns = max(1, math.floor(360 / size))
    width = 360 / columns
    row = F.floor((F.col("lat") + 90) / size)
    lowest, highest = F.floor((F.col("lat") - reach + 90) / size), F.floor((F.col("lat") + reach + 90) / size)
    # widest longitude span a circle of this radius covers; the whole parallel near a pole
    edge = F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians("lat"))
    span = F.when((F.abs("lat") + reach < 89.9) & (edge < 1), F.degrees(F.asin(F.least(edge, F.lit(1.0)))) + 1e-9).otherwise(180.0)
    west, east = F.floor((F.col("lon") - span + 180) / width), F.floor((F.col("lon") + span + 180) / width)
    east = F.least(east, west + columns - 1)
    own_col = F.least(F.floor((F.col("lon") + 180) / width), F.lit(columns - 1))
    touched = F.array_distinct(F.transform(F.sequence("w", "e"), lambda c: F.pmod(c, F.lit(columns))))
    visiting = (
        spots.select(F.col("first_id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), lowest.alias("lo"), highest.alias("hi"), west.alias("w"), east.alias("e"))
        .select("id_a", "lat_a", "lon_a", "w", "e", F.explode(F.sequence("lo", "hi")).alias("cell_row"))
        .select("id_a", "lat_a", "lon_a", "cell_row", F.explode(touched).alias("cell_col"))
    )
    cell = (F.col("cell_row") * columns + F.col("cell_col")).cast("bigint").alias("cell")
    resident = spots.select(F.col("first_id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), row.alias("cell_row"), own_col.alias("cell_col"))
    return visiting.select("id_a", "lat_a", "lon_a", cell), resident.select("id_b", "lat_b", "lon_b", cell)


def _blocks(visiting: DataFrame, resident: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part_a, part_b``: a crowded cell is a table of blocks, each the work of one key.

    The rows of a cell are dealt out by a hash into parts of about ``block_rows`` on either side, and every part of one side meets every
    part of the other. A row is repeated once per ``block_rows`` rows that it is compared with, so what is shuffled stays a small
    part of the comparisons, and no key holds more than about ``block_rows`` squared of them.
    """
    n_a = visiting.groupBy("cell").agg(F.count(F.lit(1)).alias("n_a"))
    n_b = resident.groupBy("cell").agg(F.count(F.lit(1)).alias("n_b"))
    parts = [F.ceil(F.col(n) / block_rows).alias(p) for n, p in (("n_a", "parts_a"), ("n_b", "parts_b"))]
    # cells that only one side has hold no pair
    cells = materialize(n_a.join(n_b, "cell").select("cell", "n_a", "n_b", *parts), "cells")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        weighed = cells.select("cell", F.col(f"n_{own}").alias("n"), "parts_a", "parts_b")
        met = lookup_join(side, weighed, ["cell"], "n").filter(F.col("parts_a").isNotNull())
        place = F.pmod(F.xxhash64(f"id_{own}"), F.col(f"parts_{own}")).alias(f"part_{own}")
        return met.select(*side.columns, place, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"parts_{other}") - 1)).alias(f"part_{other}"))

    return dealt(visiting, "a", "b"), dealt(resident, "b", "a")


# -- gravity --------------------------------------------------------------------------


def market_access(df: DataFrame, size: str, top: float = 1000.0) -> DataFrame:
    """Add ``market_access``: sum over other places of size / km, scaled so the best has ``top``.

    Places at the same spot have no distance and are left out of the sum.
    """
    summed = materialize(gravity(positions(df, mass=size)), "gravity")
    best = summed.agg(F.max("pull")).scalar()
    scored = summed.withColumn("market_access", F.col("pull") * F.lit(top) / F.nullif(best, F.lit(0.0))).drop("pull")
    return lookup_join(df, scored, ["lat", "lon"], "n")
