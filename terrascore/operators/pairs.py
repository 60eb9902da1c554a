"""Statistics over all pairs of positions, without forming all pairs.

Positions lie in a pyramid of grid cells, each level half as wide as the one above. A pair of cells has a least and a greatest distance, so
many questions are settled for all its pairs of positions at once: how many are nearer than a limit (the product of the counts), that none
can be the closest or furthest pair (branch and bound), or what they add to a sum. Only pairs of cells that leave a question open are
opened, into pairs of child cells or, where few positions are left, into pairs of positions. Cell pairs and positions are rows of
equality joins; all arithmetic is built-in column expressions.

Sums of a smooth function of the distance (its moments, gravity) take separated cells by Chebyshev interpolation in both coordinates: the
positions of a cell act through NODES x NODES weighted nodes. Cells count as separated when their centres are at least
SEPARATION times their radii apart, and as far from being antipodes, so the function is analytic within a Bernstein ellipse of
parameter rho > 8 in every coordinate and the error of a pair is below 4 * NODES * rho^(1 - NODES) of its value, some 1e-9.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.geo import EARTH_RADIUS_KM, haversine_km
from terrascore.operators.grid import cell_box, cell_corner, cell_of
from terrascore.session import materialize

NODES = 12
SEPARATION = 2.0
#: Pairs of positions below which a pair of cells is opened at once: about the pairs of their nodes.
OPEN_PAIRS = 1 << 16
COARSEST = 30.0
#: Below a few centimetres cell numbers no longer fit.
FINEST = 2e-6
HALF_TURN_KM = math.pi * EARTH_RADIUS_KM
#: Distances are compared to the millimetre; bounds give way by as much.
SLACK_KM = 2e-6


@dataclass
class CellTree:
    """``points``: every position once per level; ``cells``: counts by level and cell, with the parent cell."""

    points: DataFrame  # level, cell, lat, lon, first_id, n, mass
    cells: DataFrame  # level, cell, parent, spots, n, squares, mid_lat, mid_lon, radius
    sizes: list[float]
    open_pairs: int
    pairs: int  # pairs of entities at different spots
    spots: int


def cell_tree(spots: DataFrame, open_pairs: int = OPEN_PAIRS) -> CellTree:
    """A pyramid down to cells of at most the square root of ``open_pairs`` positions."""
    lat, lon = F.col("lat"), F.col("lon")
    sizes = [COARSEST]
    while sizes[-1] > FINEST:
        fullest = spots.groupBy(cell_of(lat, lon, sizes[-1])).count().agg(F.max("count")).head()[0] or 0
        if fullest * fullest <= open_pairs:
            break
        sizes.append(sizes[-1] / 2)
    levels = [F.struct(F.lit(i).alias("level"), cell_of(lat, lon, s).alias("cell"), (cell_of(lat, lon, sizes[i - 1]) if i else F.lit(-1).cast("bigint")).alias("parent")) for i, s in enumerate(sizes)]
    points = materialize(spots.select("lat", "lon", "first_id", "n", "mass", F.inline(F.array(*levels))), "tree-points")
    counts = points.groupBy("level", "cell", "parent").agg(F.count(F.lit(1)).alias("spots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    mid_lat, mid_lon, radius = cell_box(F.col("cell"), _level_size())
    cells = materialize(counts.withColumns({"mid_lat": mid_lat, "mid_lon": mid_lon, "radius": radius}), "tree-cells")
    top = cells.filter("level = 0").agg(F.sum("n").alias("n"), F.sum("squares").alias("q"), F.sum("spots").alias("spots")).head()
    return CellTree(points, cells, sizes, open_pairs, ((top["n"] or 0) ** 2 - (top["q"] or 0)) // 2, top["spots"] or 0)


#: What a pair of cells takes from each of its sides.
SIDE = ["spots", "n", "squares", "mid_lat", "mid_lon", "radius"]


def _measured(pairs: DataFrame) -> DataFrame:
    """Centre distance ``d`` and joint radius ``r`` of every pair of cells; ``real`` unless it is one cell with one position."""
    d = haversine_km(F.col("mid_lat_a"), F.col("mid_lon_a"), F.col("mid_lat_b"), F.col("mid_lon_b"))
    kept = pairs.withColumns({"d": d, "r": F.col("radius_a") + F.col("radius_b")})
    return kept.withColumn("real", (F.col("a") != F.col("b")) | (F.col("spots_a") > 1)).drop(*[f"{c}_{s}" for c in ("mid_lat", "mid_lon", "radius") for s in "ab"], "squares_b")


def _top_pairs(tree: CellTree) -> DataFrame:
    # at most 6 x 12 cells of 30 degrees exist, so this list is tiny whatever the data
    top = tree.cells.filter("level = 0").select("cell", *SIDE)
    cells = top.agg(F.collect_list(F.struct("cell", *SIDE))).scalar()
    pairs = top.withColumn("_top", cells).select(F.col("cell").alias("a"), *[F.col(c).alias(f"{c}_a") for c in SIDE], F.inline("_top").alias("b", *[f"{c}_b" for c in SIDE]))
    return pairs.filter("a <= b")


def _children(pairs: DataFrame, tree: CellTree, level: int, keep: Sequence[str]) -> DataFrame:
    cells = tree.cells.filter(F.col("level") == level)
    kids = lambda s: cells.select(F.col("parent").alias(f"_{s}"), F.col("cell").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in SIDE])
    grown = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), *keep).join(kids("a"), "_a").join(kids("b"), "_b")
    return grown.filter((F.col("_a") != F.col("_b")) | (F.col("a") <= F.col("b"))).drop("_a", "_b")


@dataclass(frozen=True)
class Question:
    """What to find out about all pairs of positions.

    ``open`` says, from ``d`` and ``r`` of a pair of cells and from what ``known`` aggregates over the pairs of the level, whether the
    question stays open for it; ``whole`` says which of the settled ones are kept, to be counted as a whole.
    """

    open: Callable[[dict], Column]
    known: dict[str, Column] | None = None
    whole: Column | None = None


def descend(tree: CellTree, questions: dict[str, Question]) -> list[DataFrame]:
    """For every level the pairs of cells that are to be opened into positions (``opened``), that leave something open to their children,
    or that are settled and count as a whole; ``was_x`` and ``x`` tell whether question x was open before and after."""
    names = list(questions)
    frames: list[DataFrame] = []
    pairs = _top_pairs(tree).withColumns({name: F.lit(True) for name in names})
    aggregates = {k: v for q in questions.values() for k, v in (q.known or {}).items()}
    for level in range(len(tree.sizes)):
        measured = _measured(pairs)
        if aggregates:
            measured = materialize(measured, f"pairs{level}")
        known = measured.agg(*[v.alias(k) for k, v in aggregates.items()]).head().asDict() if aggregates else {}
        flagged = measured.withColumns({f"was_{name}": F.col(name) for name in names}).withColumns({name: F.col(name) & q.open(known) for name, q in questions.items()})
        some = F.greatest(*[F.col(name) for name in names], F.lit(False))
        last = level == len(tree.sizes) - 1
        opened = some & ((F.col("spots_a") * F.col("spots_b") <= tree.open_pairs) | F.lit(last))
        whole = F.lit(False)
        for name, q in questions.items():
            if q.whole is not None:
                whole = whole | (F.col(f"was_{name}") & ~F.col(name) & q.whole)
        flagged = flagged.withColumns({"level": F.lit(level), "opened": opened, "some": some, "whole": whole})
        flagged = materialize(flagged.filter("some or whole"), f"flagged{level}")
        frames.append(flagged)
        if not last:
            pairs = _children(flagged.filter("some and not opened"), tree, level + 1, names)
    return frames


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def opened_positions(tree: CellTree, frames: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Pairs of positions of all opened cell pairs, each once, with the flags and ``km``."""
    pairs = union([f.filter("opened").select("level", "a", "b", *names) for f in frames])
    side = lambda s: tree.points.select("level", F.col("cell").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "first_id", "n", "mass")])
    met = pairs.join(side("a"), ["level", "a"]).join(side("b"), ["level", "b"]).filter((F.col("a") != F.col("b")) | (F.col("first_id_a") < F.col("first_id_b")))
    km = F.round(haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 6)
    return met.withColumn("km", km)


# -- questions -------------------------------------------------------------------------


def furthest() -> Question:
    """A pair may hold the greatest distance unless another one is sure to hold a greater one."""
    sure = F.max(F.when(F.col("real"), F.col("d") - F.col("r")))
    return Question(lambda known: F.col("d") + F.col("r") + SLACK_KM >= (known["far_sure"] or 0.0), {"far_sure": sure})


def closest() -> Question:
    sure = F.min(F.when(F.col("real"), F.col("d") + F.col("r")))
    return Question(lambda known: F.col("d") - F.col("r") - SLACK_KM <= (HALF_TURN_KM if known["near_sure"] is None else known["near_sure"]), {"near_sure": sure})


def bracketed(low_km: float, high_km: float) -> Question:
    """Distances in [low, high] are measured, those below counted."""
    is_open = (F.col("d") - F.col("r") - SLACK_KM <= high_km) & (F.col("d") + F.col("r") + SLACK_KM >= low_km)
    return Question(lambda known: is_open, whole=F.col("d") + F.col("r") + SLACK_KM < low_km)


def summed_up(open_pairs: int) -> Question:
    """Separated cells with more pairs than a pair of node sets is taken by interpolation, all others are measured."""
    apart = (F.col("d") >= SEPARATION * F.col("r")) & (F.col("d") <= HALF_TURN_KM - SEPARATION * F.col("r"))
    return Question(lambda known: ~apart | (F.col("spots_a") * F.col("spots_b") <= open_pairs), whole=F.lit(True))


# -- separated cells by interpolation ----------------------------------------------


def _basis(u: Column) -> Column:
    """Values of the NODES Lagrange polynomials of the Chebyshev nodes at u."""
    angles = (np.arange(NODES) + 0.5) * math.pi / NODES
    scale = np.where(np.arange(NODES) == 0, 1.0, 2.0) / NODES
    table = np.cos(np.outer(angles, np.arange(NODES))) * scale
    powers = F.transform(F.sequence(F.lit(0), F.lit(NODES - 1)), lambda k: F.cos(k * F.acos(F.greatest(F.least(u, F.lit(1.0)), F.lit(-1.0)))))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table])
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, powers, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v))


def _weights(size: Column) -> Column:
    """Share of each of the NODES x NODES nodes of its cell in a position, latitude first."""
    lat0, lon0 = cell_corner(F.col("cell"), size)
    u, v = 2 * (F.col("lat") - lat0) / size - 1, 2 * (F.col("lon") - lon0) / size - 1
    return F.flatten(F.transform(_basis(u), lambda x: F.transform(_basis(v), lambda y: x * y)))


def _level_size() -> Column:
    return F.lit(COARSEST) / F.pow(F.lit(2.0), F.col("level"))


def sources(tree: CellTree, far: DataFrame, mass: str) -> DataFrame:
    """(level, cell, key, lat, lon, weight) of every cell in the separated pairs: its positions, or its nodes where these are fewer."""
    used = far.select("level", F.col("a").alias("cell"), F.col("spots_a").alias("spots")).unionByName(far.select("level", F.col("b").alias("cell"), F.col("spots_b").alias("spots"))).distinct()
    held = tree.points.join(used, ["level", "cell"])
    few = held.filter(F.col("spots") <= NODES * NODES).select("level", "cell", F.col("first_id").alias("key"), "lat", "lon", F.col(mass).cast("double").alias("weight"), F.lit(False).alias("node"))
    many = held.filter(F.col("spots") > NODES * NODES)
    vector = array_to_vector(F.transform(_weights(_level_size()), lambda w: w * F.col(mass)))
    summed = many.select("level", "cell", vector.alias("_w")).groupBy("level", "cell").agg(vector_to_array(Summarizer.sum(F.col("_w"))).alias("_w"))
    spots = summed.select("level", "cell", F.posexplode("_w").alias("_k", "weight"))
    lat0, lon0 = cell_corner(F.col("cell"), _level_size())
    at = lambda i: (F.cos((i + 0.5) * math.pi / NODES) + 1) / 2 * _level_size()
    nodes = spots.select("level", "cell", F.col("_k").cast("bigint").alias("key"), (lat0 + at(F.floor(F.col("_k") / NODES))).alias("lat"), (lon0 + at(F.col("_k") % NODES)).alias("lon"), "weight", F.lit(True).alias("node"))
    return materialize(few.unionByName(nodes), "far-sources")


def _met(far: DataFrame, parts: DataFrame) -> DataFrame:
    """Separated pairs of cells with the sources of both and their distance."""
    side = lambda s: parts.select("level", F.col("cell").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("key", "lat", "lon", "weight", "node")])
    met = far.select("level", "a", "b").join(side("a"), ["level", "a"]).join(side("b"), ["level", "b"])
    return met.withColumn("km", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))


# -- statistics ----------------------------------------------------------------------


STATS = "pairs bigint, min_km double, max_km double, mean_km double, median_km double, std_km double"


def distance_stats(spots: DataFrame, bins: int = 16_384, open_pairs: int = OPEN_PAIRS) -> DataFrame:
    """Min, max, mean, median and population deviation over all pairs at different spots.

    Extremes by branch and bound, moments by interpolation between separated cells, the median exactly: pairs below a bracket from a
    sample are counted cell by cell, those inside it are measured. A bracket that misses is moved on.
    """
    spark = spots.sparkSession
    tree = cell_tree(spots, open_pairs)
    pairs = tree.pairs
    if not pairs:
        return spark.createDataFrame([], STATS)
    ranks = [(pairs - 1) // 2, pairs // 2]
    low, high = _bracket(tree)
    questions = {"far": furthest(), "near": closest(), "sums": summed_up(open_pairs), "middle": bracketed(low, high)}
    frames = descend(tree, questions)

    w = (F.col("n_a") * F.col("n_b")).cast("double")
    d = F.col("km")
    opened = opened_positions(tree, frames, list(questions))
    when = lambda flag, value: F.when(F.col(flag), value)
    found = opened.agg(F.min(when("near", d)).alias("lo"), F.max(when("far", d)).alias("hi"), F.sum(when("sums", w * d)).alias("s1"), F.sum(when("sums", w * d * d)).alias("s2")).head()
    s1, s2 = found["s1"] or 0.0, found["s2"] or 0.0
    far = union([f.filter("was_sums and not sums").select("level", "a", "b", "spots_a", "spots_b") for f in frames])
    if not far.isEmpty():
        both = F.col("weight_a") * F.col("weight_b")
        more = _met(far, sources(tree, far, "n")).agg(F.sum(both * d).alias("s1"), F.sum(both * d * d).alias("s2")).head()
        s1, s2 = s1 + more["s1"], s2 + more["s2"]
    mean = s1 / pairs
    deviation = math.sqrt(max(s2 / pairs - mean * mean, 0.0))
    middle = _ranked(tree, frames, opened, ranks, low, high, bins)
    return spark.createDataFrame([(pairs, found["lo"], found["hi"], mean, sum(middle) / len(middle), deviation)], STATS)


def _bracket(tree: CellTree, seeds: int = 8, bins: int = 65_536) -> tuple[float, float]:
    """Distances between which the median lies with high probability, from about ``seeds`` random pairs a position.

    Positions that share a bucket of a hash are pairs; there are half as many buckets as positions, a new hash for each seed.
    """
    top = tree.points.filter("level = 0")
    dealt = top.select("lat", "lon", "n", "first_id", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("lat", "lon", "seed"), F.lit(max(1, tree.spots // 2))))
    other = dealt.select("seed", "bucket", *[F.col(c).alias(f"_{c}") for c in ("lat", "lon", "n", "first_id")])
    drawn = dealt.join(other, ["seed", "bucket"]).filter(F.col("first_id") < F.col("_first_id"))
    km, w = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), (F.col("n") * F.col("_n")).cast("double")
    step = HALF_TURN_KM / bins
    rows = sorted(drawn.groupBy(F.floor(km / step).alias("bin")).agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2")).collect())
    if not rows:
        return 0.0, HALF_TURN_KM
    at, share = np.array([r["bin"] for r in rows]), np.cumsum([r["w"] for r in rows])
    margin = 3 * math.sqrt(sum(r["w2"] for r in rows)) / share[-1]
    share = share / share[-1]
    first, last = np.searchsorted(share, 0.5 - margin), min(np.searchsorted(share, 0.5 + margin), len(at) - 1)
    return float(at[first] * step) if 0.5 - margin > 0 else 0.0, float((at[last] + 1) * step) if 0.5 + margin < 1 else HALF_TURN_KM


def _ranked(tree: CellTree, frames: list[DataFrame], opened: DataFrame, ranks: list[int], low: float, high: float, bins: int) -> list[float]:
    """The distances at ``ranks``, counted from zero in ascending order."""
    while True:
        inner = F.when(F.col("a") == F.col("b"), (F.col("n_a") * F.col("n_a") - F.col("squares_a")) / 2).otherwise(F.col("n_a") * F.col("n_b"))
        whole = union([f.filter("was_middle and not middle").filter(F.col("d") + F.col("r") + SLACK_KM < F.lit(low)).select(inner.alias("pairs")) for f in frames])
        apart = opened.filter("middle").select(F.round(F.col("km") * 1e6).cast("bigint").alias("mm"), (F.col("n_a") * F.col("n_b")).alias("w"))
        lo, hi = math.floor(low * 1e6), math.ceil(high * 1e6)
        before = int(whole.agg(F.sum("pairs")).head()[0] or 0)
        inside = materialize(apart.groupBy(F.greatest("mm", F.lit(lo - 1)).alias("mm")).agg(F.sum("w").alias("w")).filter(F.col("mm") <= hi), "middle-pairs")
        counts = inside.agg(F.sum(F.when(F.col("mm") < lo, F.col("w"))).alias("below"), F.sum(F.when(F.col("mm") >= lo, F.col("w"))).alias("inside")).head()
        before += counts["below"] or 0
        end = before + (counts["inside"] or 0)
        if before <= ranks[0] and ranks[-1] < end:
            return _values_at(inside.filter(F.col("mm") >= lo), [r - before for r in ranks], lo, hi, bins)
        # the middle lies beside the bracket, or on both sides of an edge of it
        low, high = (0.0, high) if ranks[0] < before else (low, HALF_TURN_KM)
        frames = descend(tree, {"middle": bracketed(low, high)})
        opened = opened_positions(tree, frames, ["middle"])


def _values_at(rows: DataFrame, ranks: list[int], low: int, high: int, bins: int) -> list[float]:
    """Values at ``ranks`` of (mm, w) between low and high by ever narrower histograms; only these reach the driver."""
    if low == high:
        return [low / 1e6] * len(ranks)
    width = max(1, math.ceil((high - low + 1) / bins))
    counts = rows.filter(F.col("mm").between(low, high)).groupBy(F.floor((F.col("mm") - low) / width).alias("bin")).agg(F.sum("w").alias("w"))
    found, before = [], 0
    for bin_no, w in sorted((r["bin"], r["w"]) for r in counts.collect()):
        inside = [r - before for r in ranks if before <= r < before + w]
        if inside:
            start = low + bin_no * width
            found += _values_at(rows, inside, start, min(high, start + width - 1), bins)
        before += w
    return found


def closest_furthest_pair(spots: DataFrame, open_pairs: int = 256) -> DataFrame:
    """``kind, id_a, id_b, km``: entities at the same spot count as closest, at zero; ties go to the smallest ids."""
    shared = spots.filter(F.col("second_id").isNotNull()).select(
        F.lit(0.0).alias("km"), F.least("first_id", "second_id").alias("id_a"), F.greatest("first_id", "second_id").alias("id_b")
    )
    opened = extreme_pairs(spots, open_pairs)
    ends = (F.least("first_id_a", "first_id_b").alias("id_a"), F.greatest("first_id_a", "first_id_b").alias("id_b"))
    near = opened.filter("near").select("km", *ends).unionByName(shared)
    far = opened.filter("far").select((-F.col("km")).alias("km"), *ends)
    pick = F.min(F.struct("km", "id_a", "id_b")).alias("p")
    both = near.agg(pick).withColumn("kind", F.lit("closest")).unionByName(far.agg(pick).withColumn("kind", F.lit("furthest")))
    return both.filter(F.col("p").isNotNull()).select("kind", "p.id_a", "p.id_b", F.abs("p.km").alias("km"))


def extreme_pairs(spots: DataFrame, open_pairs: int = 256) -> DataFrame:
    """The pairs of positions that have to be measured to know the closest and the furthest one."""
    tree = cell_tree(spots, open_pairs)
    questions = {"far": furthest(), "near": closest()}
    return opened_positions(tree, descend(tree, questions), list(questions))


def gravity(spots: DataFrame, open_pairs: int = OPEN_PAIRS) -> DataFrame:
    """``lat, lon, n, pull``: for every position the sum of mass / km over all others at another spot."""
    tree = cell_tree(spots, open_pairs)
    frames = descend(tree, {"sums": summed_up(open_pairs)})
    opened = opened_positions(tree, frames, []).filter("km > 0")
    pulls = opened.select(F.inline(F.array(
        F.struct(F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon"), (F.col("mass_b") / F.col("km")).alias("pull")),
        F.struct(F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon"), (F.col("mass_a") / F.col("km")).alias("pull")),
    )))
    parts = [pulls]
    far = union([f.filter("was_sums and not sums").select("level", "a", "b", "spots_a", "spots_b") for f in frames])
    if not far.isEmpty():
        known = sources(tree, far, "mass")
        turned = far.select("level", F.col("b").alias("a"), F.col("a").alias("b"))
        field = _met(far.select("level", "a", "b").unionByName(turned), known).groupBy("level", F.col("a").alias("cell"), F.col("key_a").alias("key"), F.col("node_a").alias("node"))
        field = materialize(field.agg(F.sum(F.col("weight_b") / F.col("km")).alias("value")), "far-field")
        direct = field.filter(~F.col("node")).join(tree.points.withColumnRenamed("first_id", "key"), ["level", "cell", "key"])
        parts.append(direct.select("lat", "lon", F.col("value").alias("pull")))
        values = field.filter("node").groupBy("level", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda x: x["value"]).alias("values"))
        spread = tree.points.join(values, ["level", "cell"])
        pull = F.aggregate(F.zip_with(_weights(_level_size()), "values", lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
        parts.append(spread.select("lat", "lon", pull.alias("pull")))
    zero = tree.points.filter("level = 0").select("lat", "lon", F.lit(0.0).alias("pull"))
    summed = union([*parts, zero]).groupBy("lat", "lon").agg(F.sum("pull").alias("pull"))
    return summed.join(tree.points.filter("level = 0").select("lat", "lon", "n"), ["lat", "lon"])
