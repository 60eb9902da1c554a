"""The long-form matrix against numpy over the completed wide one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.operators import cells
from terrascore.plans import indicators

FACTS = "fact_id bigint, entity_id bigint, code string, year int, value double"


@pytest.fixture(scope="module")
def table(spark):
    """60 entities, 12 codes, two thirds of the cells known; the last code is constant, one has no value, one belongs to others only."""
    rng = np.random.default_rng(7)
    wide = rng.normal(1000, 5, (60, 12)).round(2)
    wide[:, 3] = 3 * wide[:, 1] + rng.normal(0, 1, 60)
    wide[:, 11] = 4.0
    wide[rng.random((60, 12)) > 0.67] = np.nan
    rows = [(e * 12 + c, e, f"c{c:02}", 2020, float(wide[e, c])) for e in range(60) for c in range(12) if not np.isnan(wide[e, c])]
    rows += [(9000, 1, "none", 2020, None), (9001, 99, "others", 2020, 5.0), (9002, 1, None, 2020, 5.0)]
    sizes = [(e, None if e % 7 == 0 else float(e * e)) for e in range(60)]
    full = np.where(np.isnan(wide), np.nanmedian(wide, axis=0), wide)
    return spark.createDataFrame(sizes, "entity_id bigint, population double"), spark.createDataFrame(rows, FACTS), wide, full


def test_every_code_is_profiled(table):
    entities, facts, wide, _ = table
    known = cells.known_cells(entities, facts)
    found = {r.code: r.missing for r in cells.code_profile(entities, known).collect()}
    assert found == {f"c{c:02}": int(np.isnan(wide[:, c]).sum()) for c in range(12)} | {"none": 60, "others": 60}


def test_correlations_and_imputed_cells(table):
    entities, facts, _, full = table
    long = indicators.long_matrix(entities, facts)
    filled = {(r.entity_id, r.code): r.value for r in cells.imputed_cells(long.entities, long.cells, long.codes).collect()}
    assert filled == {(e, f"c{c:02}"): pytest.approx(full[e, c]) for e in range(60) for c in range(12)}
    r = {(x.code_a, x.code_b): x.r for x in cells.correlations(long.entities, long.cells, long.codes).collect()}
    expected = np.corrcoef(full[:, :11].T)
    assert len(r) == 144
    for a in range(12):
        for b in range(12):
            found = r[(f"c{a:02}", f"c{b:02}")]
            assert found is None if 11 in (a, b) else found == pytest.approx(expected[a, b], abs=1e-11)


def test_top_codes_and_index(table):
    entities, facts, _, full = table
    long = indicators.long_matrix(entities, facts)
    top = cells.top_codes(long.entities, long.cells, long.codes, "population", 12).orderBy("place").collect()
    some = np.array([e for e in range(60) if e % 7])
    strength = {f"c{c:02}": abs(np.corrcoef(full[some, c], some.astype(float) ** 2)[0, 1]) for c in range(11)}
    assert [r.code for r in top] == [*sorted(strength, key=lambda c: -strength[c]), "c11"] and top[-1].correlation is None
    assert [r.correlation for r in top[:-1]] == [pytest.approx(strength[r.code]) for r in top[:-1]]
    chosen = sorted(int(r.code[1:]) for r in top[:3])
    index = {r.entity_id: r.index_v1 for r in indicators.first_index(entities, facts, n_factors=3).collect()}
    low, high = full.min(axis=0), full.max(axis=0)
    assert index == {e: pytest.approx(10 * np.mean([(full[e, c] - low[c]) / (high[c] - low[c]) for c in chosen])) for e in range(60)}


def test_empty_tables_and_no_dense_code(spark, table):
    entities, facts, _, _ = table
    assert indicators.first_index(entities.limit(0), facts).count() == 0
    bare = indicators.first_index(entities, facts.limit(0)).collect()
    assert len(bare) == 60 and {r.index_v1 for r in bare} == {None}


def test_ten_thousand_codes(spark):
    """As many codes as would be unusable as columns; entity 0 holds every code."""
    hot = spark.range(10_000).select(F.lit(0).cast("bigint").alias("entity_id"), F.col("id").alias("c"))
    others = spark.range(40_000).select((F.col("id") % 200 + 1).alias("entity_id"), (F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("c"))
    facts = hot.union(others).select(
        F.xxhash64("entity_id", "c").alias("fact_id"), "entity_id", F.concat(F.lit("k"), "c").alias("code"), F.lit(2020).alias("year"),
        (F.pmod(F.xxhash64("entity_id", "c"), F.lit(1000)) + F.when(F.col("c") == 77, 10_000 * F.col("entity_id")).otherwise(0)).cast("double").alias("value"),
    )
    facts = facts.union(spark.range(201).select(-F.col("id"), "id", F.lit("k77"), F.lit(2019), (F.col("id") * 1e4).alias("value")))
    entities = spark.range(201).select(F.col("id").alias("entity_id"), F.col("id").cast("double").alias("population"))
    long = indicators.long_matrix(entities, facts, max_missing=1.0)
    assert long.codes.count() == 10_000
    best = cells.top_codes(long.entities, long.cells, long.codes, "population", 5).orderBy("place").head()
    assert best.code == "k77" and best.correlation == pytest.approx(1.0)


def test_repeated_rows_are_never_the_broadcast_side(spark):
    """The codes come out of an aggregate over a large table, which looks larger than the entities do."""
    codes = spark.range(50_000_000).groupBy(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("code")).agg(F.min("id").cast("double").alias("median"))
    grid = cells.with_every_code(spark.range(40).withColumnRenamed("id", "entity_id"), codes)
    assert grid.count() == 120
    assert "Generate" not in grid._jdf.queryExecution().executedPlan().toString()


def test_many_codes_are_joined_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(cells, "BROADCAST_CODES", 2)
    codes = spark.createDataFrame([(f"c{k}", float(k)) for k in range(5)], "code string, median double")
    grid = cells.with_every_code(spark.range(4).withColumnRenamed("id", "entity_id"), codes)
    assert {(r.entity_id, r.code, r.median) for r in grid.collect()} == {(e, f"c{k}", float(k)) for e in range(4) for k in range(5)}
    assert "BroadcastExchange" not in grid._jdf.queryExecution().executedPlan().toString()
