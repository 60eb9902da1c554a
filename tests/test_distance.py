import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.functions.geo import haversine_km
from terrascore.operators import distance, pairs
from terrascore.session import materialize


def km(a, b):
    la, lo, lb, lob = map(math.radians, (a[0], a[1], b[0], b[1]))
    c = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return round(2 * 6371.0 * math.atan2(math.sqrt(min(c, 1)), math.sqrt(1 - min(c, 1))), 6)


@pytest.fixture(scope="module")
def cloud():
    """Points over the whole globe, a dense clump, shared spots and both sides of 180 degrees."""
    rng = np.random.default_rng(5)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(-89, 89, 150), rng.uniform(-180, 180, 150))]
    pts += [(69.0 + float(a), 33.0 + float(b)) for a, b in rng.uniform(0, 0.01, (150, 2))]
    pts += [(66.0, 179.95), (66.0, -179.9), (89.9, 10.0), (89.9, -170.0)] + [(60.0, 30.0)] * 40
    return {i: p for i, p in enumerate(pts)}


def frame(spark, points, base=0):
    return spark.createDataFrame([(i + base, float(p[0]) if p else None, float(p[1]) if p else None) for i, p in points.items()], "entity_id bigint, lat double, lon double")


def test_haversine_known_value_and_symmetry(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(55.0), F.lit(30.0), F.lit(60.0), F.lit(40.0)).alias("a"),
        haversine_km(F.lit(60.0), F.lit(40.0), F.lit(55.0), F.lit(30.0)).alias("b"),
        haversine_km(F.lit(5.0), F.lit(7.0), F.lit(5.0), F.lit(7.0)).alias("c"),
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d"),
    ).head()
    assert round(row.a, 3) == 814.561 and row.a == pytest.approx(row.b) and row.c == 0.0
    assert row.d == pytest.approx(math.pi * 6371.0)


def test_nearest_hub_matches_brute_force(spark, cloud):
    hubs = {i: p for i, p in cloud.items() if i % 2}
    out = {r.entity_id: r for r in distance.nearest_hub(frame(spark, cloud), frame(spark, hubs)).collect()}
    assert len(out) == len(cloud)
    for i, p in cloud.items():
        best = min((km(p, q), j) for j, q in hubs.items())
        assert (out[i].hub_km, out[i].hub_id) == (pytest.approx(best[0], abs=2e-6), best[1])


def test_nearest_hub_keeps_rows_without_coordinates(spark):
    df = frame(spark, {1: (60.0, 30.0), 2: None, 3: (61.0, 30.0)})
    out = {r.entity_id: r.hub_id for r in distance.nearest_hub(df, df.filter("entity_id = 1")).collect()}
    assert out == {1: 1, 2: None, 3: 1}


def test_without_hubs_the_nearest_other_counts(spark, cloud):
    df = frame(spark, cloud)
    out = {r.entity_id: r for r in distance.nearest_hub(df, df.limit(0)).collect()}
    for i, p in cloud.items():
        best = min((km(p, q), j) for j, q in cloud.items() if j != i)
        assert (out[i].hub_km, out[i].hub_id) == (pytest.approx(best[0], abs=2e-6), best[1])


def test_hub_cascade(spark):
    df = spark.createDataFrame([(1, 12_000.0), (2, 6_000.0), (3, 10.0)], "entity_id int, size double")
    assert [r.entity_id for r in distance.hub_filter(df, "size").collect()] == [1]
    assert [r.entity_id for r in distance.hub_filter(df.filter("size < 10000"), "size").collect()] == [2]
    assert distance.hub_filter(df.filter("size < 100"), "size").count() == 0


@pytest.mark.parametrize("reach", [5.0, 300.0, 2_500.0])
def test_neighbours_match_brute_force(spark, cloud, reach):
    ours = {(r.id_a, r.id_b) for r in distance.pairwise_distance(frame(spark, cloud), reach).collect()}
    ids = sorted(i for i, p in cloud.items() if p)
    assert ours == {(a, b) for a in ids for b in ids if a < b and km(cloud[a], cloud[b]) <= reach}


@pytest.mark.parametrize("reach", [300.0, 2_500.0])
def test_split_cells_lose_and_repeat_nothing(spark, cloud, reach):
    whole = sorted((r.id_a, r.id_b) for r in distance.pairwise_distance(frame(spark, cloud), reach).collect())
    assert sorted((r.id_a, r.id_b) for r in distance.pairwise_distance(frame(spark, cloud), reach, block_rows=3).collect()) == whole


def test_crowded_cell_is_even_work(spark):
    """Half of all rows in one cell: the comparisons spread over the tasks, and no key holds more than a block of them."""
    draw = np.random.default_rng(5)
    points = {i: (draw.uniform(50, 50.4), draw.uniform(30, 30.4)) if i % 2 else (draw.uniform(-60, 60), draw.uniform(-180, 179)) for i in range(2_400)}
    sides = distance._cell_sides(frame(spark, points).withColumnRenamed("entity_id", "first_id"), 100.0)
    assert sides[1].groupBy("cell").count().agg(F.max("count")).head()[0] > 500
    a, b = distance._blocks(*sides, 100)
    keys = ["cell", "part_a", "part_b"]
    work = a.groupBy(*keys).count().withColumnRenamed("count", "a").join(b.groupBy(*keys).count(), keys).withColumn("work", F.col("a") * F.col("count"))
    assert work.agg(F.max("work")).head()[0] < 2 * 100 * 100
    # as the shuffle of the join deals out its keys
    loads = [r["sum(work)"] for r in work.groupBy(F.pmod(F.hash(*keys), F.lit(8))).sum("work").collect()]
    assert max(loads) <= 2 * sum(loads) / 8


def test_spot_pairs_with_members_are_all_pairs(spark, cloud):
    df = frame(spark, cloud)
    spot = {r.entity_id: r.spot_id for r in distance.spot_members(df).collect()}
    assert set(spot) == set(cloud) and all((spot[i] is None) == (p is None) for i, p in cloud.items())
    apart = {(r.id_a, r.id_b): r for r in distance.spot_pairs(df, 300.0).collect()}
    ours = {(i, j) for i in cloud for j in cloud if i < j and cloud[i] and cloud[j] and (spot[i] == spot[j] or tuple(sorted((spot[i], spot[j]))) in apart)}
    assert ours == {(r.id_a, r.id_b) for r in distance.pairwise_distance(df, 300.0).collect()}
    size = {s: sum(t == s for t in spot.values()) for s in spot.values()}
    assert all((r.n_a, r.n_b) == (size[a], size[b]) for (a, b), r in apart.items())


@pytest.mark.parametrize("open_pairs", [100, 1 << 16])
def test_pair_statistics_match_brute_force(spark, cloud, open_pairs):
    spots = materialize(distance.positions(frame(spark, cloud), second=True), "spots")
    apart_by = {(a, b): km(cloud[a], cloud[b]) for a in cloud for b in cloud if a < b}
    apart = np.array([d for d in apart_by.values() if d > 0])
    row = pairs.distance_stats(spots, bins=64, open_pairs=open_pairs).head()
    assert row.pairs == len(apart)
    assert [row.min_km, row.max_km] == pytest.approx([apart.min(), apart.max()], abs=2e-6)
    assert [row.mean_km, row.median_km, row.std_km] == pytest.approx([apart.mean(), np.median(apart), apart.std()], abs=1e-5)
    ends = {r.kind: (r.id_a, r.id_b) for r in pairs.closest_furthest_pair(spots).collect()}
    assert ends["closest"] == min((d, k) for k, d in apart_by.items())[1]
    assert apart_by[ends["furthest"]] == pytest.approx(max(apart_by.values()), abs=2e-6)


def test_interpolation_between_separated_cells(spark):
    """Moments and gravity with most pairs taken from nodes, to more digits than are reported."""
    rng = np.random.default_rng(8)
    at = np.concatenate([np.stack([rng.uniform(20 + k * 12, 29 + k * 12, 400), rng.uniform(k * 60 - 150, k * 60 - 142, 400)], 1) for k in range(5)])
    rows = [(i, float(a), float(b), float(i % 7 + 1)) for i, (a, b) in enumerate(at)]
    df = spark.createDataFrame(rows, "entity_id bigint, lat double, lon double, size double")
    la, lo = np.radians(at[:, 0]), np.radians(at[:, 1])
    c = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    d = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(c, 1)))
    upper = d[np.triu_indices(len(d), 1)]
    spots = materialize(distance.positions(df), "spots")
    tree = pairs.cell_tree(spots, 4096)
    frames = pairs.descend(tree, {"sums": pairs.summed_up(4096)})
    far = pairs.union([f.filter("was_sums and not sums").select("spots_a", "spots_b") for f in frames])
    assert far.agg(F.sum(F.col("spots_a") * F.col("spots_b"))).head()[0] > 0.5 * len(upper)
    row = pairs.distance_stats(spots, open_pairs=4096).head()
    assert row.mean_km == pytest.approx(upper.mean(), abs=2e-8) and row.std_km == pytest.approx(upper.std(), abs=2e-8)
    assert row.median_km == pytest.approx(np.median(upper), abs=2e-6)
    d = np.round(d, 6)
    np.fill_diagonal(d, np.inf)
    pull = (np.array([r[3] for r in rows])[None, :] / d).sum(1)
    out = {(r.lat, r.lon): r.pull for r in pairs.gravity(distance.positions(df, mass="size"), open_pairs=4096).collect()}
    got = np.array([out[(r[1], r[2])] for r in rows])
    assert np.abs(got / pull - 1).max() < 1e-8


def test_extremes_measure_few_pairs(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 4000), rng.uniform(-180, 180, 4000)))], "entity_id bigint, lat double, lon double")
    spots = materialize(distance.positions(df, second=True), "spots")
    assert pairs.extreme_pairs(spots, 16).count() < 4000**1.5


def test_no_python_worker(spark):
    df = spark.range(300).selectExpr("id as entity_id", "cast(id % 17 as double) as lat", "cast(id as double) / 3 as lon", "1.0 as size")
    spots = materialize(distance.positions(df, second=True), "spots")
    tree = pairs.cell_tree(spots, 64)
    frames = pairs.descend(tree, {"sums": pairs.summed_up(64)})
    for frame in (pairs.opened_positions(tree, frames, ["sums"]), pairs.closest_furthest_pair(spots), distance.market_access(df, "size")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_gravity_skips_shared_spots(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 0.0, 0.0, 30.0), (3, 0.0, 1.0, 20.0), (4, None, None, 5.0)], "entity_id bigint, lat double, lon double, size double")
    out = {r.entity_id: r.market_access for r in distance.market_access(df, "size").collect()}
    # the two at the origin feel 20, the other one 40
    assert out[3] == pytest.approx(1000.0) and out[1] == out[2] == pytest.approx(500.0) and out[4] is None
