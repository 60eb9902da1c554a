import datetime as dt
from collections import Counter
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrascore.operators import ranking, scaling
from terrascore.operators.joins import lookup_join
from terrascore.operators.quantiles import exact_quantiles


def skewed(spark, n=20_000):
    """A third of all rows share one score, some have none."""
    return spark.range(n).select(
        F.col("id").alias("entity_id"),
        F.when(F.col("id") % 3 == 0, 7.5).when(F.col("id") % 101 == 5, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)) / 100.0).alias("score"),
    )


def test_distributed_rank_equals_plain_rank(spark):
    df = skewed(spark)
    rows = ranking.competition_rank(df, "score").collect()
    scores = sorted((r.score for r in rows if r.score is not None), reverse=True)
    first = {}
    for i, s in enumerate(scores, 1):
        first.setdefault(s, i)
    assert len(rows) == 20_000
    assert all(r["rank"] == (first[r.score] if r.score is not None else None) for r in rows)


def test_rank_of_any_orderable_type(spark):
    cases = {
        "long": [2**53, 2**53 + 1, 2**53 + 1, None, -1],
        "double": [float("nan"), float("inf"), float("-inf"), 1.5, 1.5, None, float("nan")],
        "string": ["b", "a", "ß", "b", None],
        "date": [dt.date(2024, 1, 2), dt.date(2023, 1, 1), None, dt.date(2024, 1, 2)],
        "decimal(20,6)": [Decimal("1.000001"), Decimal("1.000002"), None],
    }
    for kind, values in cases.items():
        df = spark.createDataFrame(list(enumerate(values)), f"id int, s {kind}")
        ours = {r.id: r["rank"] for r in ranking.competition_rank(df, "s").collect()}
        plain = df.filter("s is not null").withColumn("rank", F.rank().over(Window.orderBy(F.col("s").desc())))
        expected = {r.id: r["rank"] for r in plain.collect()} | {i: None for i, v in enumerate(values) if v is None}
        assert ours == expected, kind


def test_rank_does_not_depend_on_partitions(spark):
    df = skewed(spark, 3_000)
    one = {r.entity_id: r["rank"] for r in ranking.competition_rank(df.coalesce(1), "score").collect()}
    many = {r.entity_id: r["rank"] for r in ranking.competition_rank(df.repartition(16), "score").collect()}
    assert one == many


def test_rank_orders_only_ranges_in_one_task(spark):
    plan = ranking.value_ranks(skewed(spark, 100), "score")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "score" in line]
    assert windows and all("_range" in line for line in windows)


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(10_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id") % 7).alias("k"))
    right = left.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in lookup_join(left, right, ["k"], "n", hot_share=2.0).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 10_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_constant_and_empty_scores(spark):
    same = spark.range(10).select("id", F.lit(1.0).alias("s"))
    assert {r["rank"] for r in ranking.competition_rank(same, "s").collect()} == {1}
    none = spark.range(3).select("id", F.lit(None).cast("double").alias("s"))
    assert [r["rank"] for r in ranking.competition_rank(none, "s").collect()] == [None] * 3


def test_lookup_join_keeps_every_row_once(spark):
    left = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 7, None).otherwise(F.col("id") % 400).cast("int").alias("k"))
    right = left.filter("k is not null and k <> 13").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 10)
    out = lookup_join(left, right, ["k"], "n").collect()
    assert len(out) == 5_000 and len({r.id for r in out}) == 5_000
    assert all(r.v == (None if r.k in (None, 13) else r.k * 10) for r in out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(3.25)), min_size=1, max_size=60))
def test_quantiles_match_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    out = exact_quantiles(df, [], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()
    if not known:
        assert out == []
        return
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
        at = (len(known) - 1) * p
        lo, hi = known[int(at)], known[min(int(at) + (at > int(at)), len(known) - 1)]
        assert abs(out[0][name] - (lo + (hi - lo) * (at - int(at)))) < 1e-6


def test_grouped_quantiles_with_a_hot_group(spark):
    df = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 5).cast("string")).alias("g"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 60.0).alias("v"),
    )
    ours = {r.g: (round(r.m, 6), r.n_values) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    plain = {r.g: (round(r.m, 6), r.n) for r in df.groupBy("g").agg(F.median("v").alias("m"), F.count("v").alias("n")).collect()}
    assert ours == plain


def test_minmax_stays_in_range_and_handles_constants(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, None), (2, 4.0, 5.0, 1.0), (3, None, 5.0, 3.0)], "id int, a double, b double, c double")
    rows = {r.id: r for r in scaling.minmax_scale(df, ["a", "b", "c"]).collect()}
    assert (rows[1].a_scaled, rows[2].a_scaled, rows[3].a_scaled) == (0.0, 1.0, None)
    assert {r.b_scaled for r in rows.values()} == {None}
    assert {r.b_scaled for r in scaling.minmax_scale(df, ["b"], on_constant=0.5).collect()} == {0.5}
    assert [r.c_scaled for r in scaling.minmax_scale(df, ["c"], inverted=["c"]).orderBy("id").collect()] == [None, 1.0, 0.0]


def test_minmax_has_no_window_and_no_cross_join(spark):
    plan = scaling.minmax_scale(spark.range(10).withColumn("x", F.col("id") * 1.0), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_group_fill_uses_group_mean_and_null_group(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "b", None), (4, None, 8.0), (5, None, None)], "id int, g string, x double")
    out = {r.id: r.x_filled for r in scaling.group_mean_fill(df, "g", ["x"]).collect()}
    assert out == {1: 2.0, 2: 2.0, 3: None, 4: 8.0, 5: 8.0}


def test_sort_table_puts_nulls_last_and_true_first(spark):
    df = spark.createDataFrame([(1, "яма", True), (2, "ёлка", False), (3, None, None), (4, "арка", True)], "id int, name string, flag boolean")
    assert [r.name for r in ranking.sort_table(df, "name").collect()] == ["арка", "ёлка", "яма", None]
    assert [r.name for r in ranking.sort_table(df, "name", descending=True).collect()] == ["яма", "ёлка", "арка", None]
    assert [r.flag for r in ranking.sort_table(df, "flag").collect()] == [True, True, False, None]
    assert [r.flag for r in ranking.sort_table(df, "flag", descending=True).collect()] == [False, True, True, None]


def test_top_per_group_and_top_bottom(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("s"))
    top = ranking.top_per_group(df, "g", [F.col("s").desc(), F.col("id")], 2)
    assert Counter(r.g for r in top.collect()) == {0: 2, 1: 2, 2: 2}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    both = ranking.top_bottom_n(df, "s", "id", 3).collect()
    assert {r.id for r in both if r.list == "top"} == {99, 98, 97} and {r.id for r in both if r.list == "bottom"} == {0, 1, 2}
