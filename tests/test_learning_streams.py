import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.operators import learning, matrix, summaries
from terrascore.operators.contracts import FieldMapping
from terrascore.plans import indicators, typology
from terrascore.session import materialize
from terrascore.sources.landing import FileRule
from terrascore.streaming import loads


@pytest.fixture(scope="module")
def cloud(spark):
    """Four blobs in six columns, one of them constant."""
    rng = np.random.default_rng(3)
    centres = rng.uniform(-20, 20, (4, 5))
    x = np.vstack([c + rng.normal(0, 1, (60, 5)) for c in centres])
    x = np.hstack([x, np.full((240, 1), 7.0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "entity_id bigint, " + ", ".join(f"c{j} double" for j in range(6)))
    return x, materialize(learning.to_vectors(df, [f"c{j}" for j in range(6)]), "cloud")


def test_components_match_numpy(spark, cloud):
    x, df = cloud
    found = learning.pca_components(df, 3)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = values.argsort()[::-1][:3]
    values_k, v = values[order], vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(3)])
    scores = np.array([r.components for r in found.scores.orderBy("entity_id").collect()])
    assert scores == pytest.approx(z @ v, abs=1e-6)
    assert found.ratios == pytest.approx(values_k / values.sum(), abs=1e-9)
    importance = {r.code: r.importance for r in found.importance([f"c{j}" for j in range(6)]).collect()}
    assert [importance[f"c{j}"] for j in range(6)] == pytest.approx((v**2) @ values_k, abs=1e-6)
    explained = found.explained().orderBy("component").collect()
    assert explained[-1].cumulative == pytest.approx(found.ratios.sum())


def quality(x, labels):
    """Silhouette and Davies-Bouldin by their definitions."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i, l in enumerate(labels):
        own = labels == l
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != l)
        s.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    c = {l: x[labels == l].mean(axis=0) for l in set(labels)}
    w = {l: np.linalg.norm(x[labels == l] - c[l], axis=1).mean() for l in c}
    return np.mean(s), np.mean([max((w[i] + w[j]) / np.linalg.norm(c[i] - c[j]) for j in c if j != i) for i in c])


def test_kmeans_finds_the_blobs_and_quality_is_exact(spark, cloud):
    x, df = cloud
    metrics, model = learning.kmeans_select(df, ks=(3, 4, 5), restarts=2, metric="euclidean")
    rows = {r.k: r for r in metrics.collect()}
    assert [k for k, r in rows.items() if r.is_best] == [4]
    labels = np.array([r.cluster_id for r in model.transform(df).orderBy("entity_id").collect()])
    s, db = quality(x, labels)
    assert rows[4].silhouette == pytest.approx(s) and rows[4].davies_bouldin == pytest.approx(db)
    assert all(len(set(labels[i * 60 : i * 60 + 60])) == 1 for i in range(4))


def test_correlation_and_factors_ignore_constant_columns(spark):
    df = spark.range(50).select(F.col("id").alias("entity_id"), (F.col("id") * 2.0).alias("a"), F.lit(3.0).alias("b"), (-F.col("id") * 1.0).alias("c"), F.when(F.col("id") > 3, F.col("id") * 1.0).alias("population"))
    r = {(x.code_a, x.code_b): x.r for x in matrix.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("a", "c")] == pytest.approx(-1.0) and r[("a", "b")] is None and r[("b", "b")] is None
    top = [(x.place, x.code) for x in matrix.top_factors(df, ["a", "b", "c"], "population", 3).orderBy("place").collect()]
    assert {c for _, c in top[:2]} == {"a", "c"} and top[2] == (3, "b")


def test_pivot_takes_earliest_or_latest(spark):
    facts = spark.createDataFrame([(1, 7, "x", 2020, None), (2, 7, "x", 2021, 5.0), (3, 7, "x", 2021, 6.0), (4, 7, "x", 2022, 9.0), (5, 8, "1.10", 2020, 1.0)], "fact_id bigint, entity_id bigint, code string, year int, value double")
    codes = matrix.indicator_codes(facts)
    assert codes == ["1.10", "x"]
    assert {r.entity_id: r.x for r in matrix.indicator_pivot(facts, codes).collect()} == {7: 5.0, 8: None}
    assert {r.entity_id: r.x for r in matrix.indicator_pivot(facts, codes, "latest").collect()} == {7: 9.0, 8: None}


def test_first_index_without_population_uses_components(spark):
    facts = spark.range(200).select(F.col("id").alias("fact_id"), (F.col("id") % 40).alias("entity_id"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("code"), F.lit(2020).alias("year"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("value"))
    # five codes, each known for a fifth of the entities, so all are too sparse at one half
    entities = spark.range(40).select(F.col("id").alias("entity_id"))
    _, kept = indicators.imputed_matrix(entities, facts)
    assert kept == []
    out = indicators.first_index(entities, facts, n_factors=2, max_missing=0.9)
    assert out.count() == 40 and out.filter("index_v1 < 0 or index_v1 > 10").count() == 0


def test_cluster_labels_and_suffixes(spark):
    rows = [(1, 20_000.0, 0.0, 0.9, 9), (2, 20_000.0, 0.0, 0.1, 9), (3, 8_000.0, 0.9, 0.0, 9), (4, 5_000.0, 0.1, 0.9, 9), (5, 3_000.0, 0.0, 0.0, 9), (6, 100.0, 0.0, 0.0, 9), (7, 50.0, 0.0, 0.0, 9), (8, 1.0, 0.0, 0.0, 1), (9, 60.0, 0.0, 0.0, 4)]
    df = spark.createDataFrame([(a, b, c, d, e, f"n{a}") for a, b, c, d, e in rows], "cluster_id int, mean_population double, zone_share double, pattern_share double, entities int, first_name string")
    names = {r.cluster_id: r.cluster_name for r in summaries.cluster_names(df).collect()}
    assert names == {
        1: "Нефтегазовые посёлки (ХМАО/ЯНАО)",
        2: "Крупные ПГТ/города",
        3: "Арктические центры",
        4: "Малые нефтегазовые ПГТ",
        5: "Сельские поселения",
        6: "Малые изолированные НП",
        7: "Малые изолированные НП (вар.1)",
        8: "Аномалия: n8",
        9: "Малые изолированные НП (вар.2)",
    }


def test_profiles_drop_null_means(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 4.0, None), (2, None, 1.0)], "cluster_id int, a double, b double")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "cluster_id int, cluster_name string")
    out = {r.cluster_id: r.mean_values for r in summaries.cluster_profiles(df, names, ["a", "b"]).collect()}
    assert out == {1: {"a": 3.0}, 2: {"b": 1.0}}


def test_typology_names_every_entity(spark, cloud):
    x, _ = cloud
    wide = spark.createDataFrame([(i, f"e{i}", f"r{i % 3}", i % 2 == 0, float(i), *map(float, r)) for i, r in enumerate(x)], "entity_id bigint, entity_name string, region_name string, is_zone boolean, population double, " + ", ".join(f"c{j} double" for j in range(6)))
    found = typology.typology(wide, [f"c{j}" for j in range(6)], ks=(3, 4), restarts=2, components=3)
    assert found.clusters.count() == 240 and found.clusters.filter("cluster_name is null").count() == 0
    assert found.metrics.count() == 2


# -- streams ------------------------------------------------------------------------

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, folder, number, rows):
    data = spark.sql(f"select * from values {', '.join(rows)} as t(event_id, ts, user_id, event_type, value, props)")
    data.selectExpr("cast(event_id as bigint) event_id", "cast(ts as timestamp_ntz) ts", "cast(user_id as bigint) user_id", "event_type", "cast(value as double) value", "props").coalesce(1).write.parquet(f"{folder}/tmp{number}")
    import glob
    import os
    import shutil

    shutil.copy(glob.glob(f"{folder}/tmp{number}/part-*.parquet")[0], f"{folder}/events{number}.parquet")
    os.utime(f"{folder}/events{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def test_late_repeats_are_dropped_within_the_allowance(spark, tmp_path):
    events(spark, tmp_path, 1, ["(1, '2024-01-01', 1, 'a', 1, '{}')", "(2, '2024-01-02', 1, 'a', 1, '{}')"])
    events(spark, tmp_path, 2, ["(1, '2024-01-02', 1, 'a', 1, '{}')", "(3, '2024-01-20', 1, 'a', 1, '{}')"])
    events(spark, tmp_path, 3, ["(4, '2024-01-21', 1, 'a', 1, '{}')", "(1, '2024-01-02', 1, 'a', 1, '{}')"])
    events(spark, tmp_path, 4, ["(2, '2024-01-22', 1, 'a', 1, '{}')"])
    mapping = FieldMapping("p", "events", dedupe_keys=("event_id",), late_arrivals_days=3)
    stream = loads.read_stream(spark, str(tmp_path), "events", files_per_batch=1)
    out = loads.run_to_table(loads.stream_dedupe(stream, mapping).select("event_id"), "late")
    # the second 2 comes long after the first one's allowance, so it counts as new
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 2, 3, 4]


def test_streamed_load_equals_the_batch_and_replays_change_nothing(spark, tmp_path):
    schema = "id bigint, source_name string, file_name string, file_path string, report_type string, report_period string, payload string, content string, loaded_at timestamp"
    rule = [FileRule("sales", "sales*", skip_rows=0)]

    def landing_file(n, rows):
        data = [(i, "s", f"sales_{m}_2024.csv", None, None, None, None, c, None) for i, m, c in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")

    landing_file(1, [(1, "May", "Country,Units\nA,1\nB,2\n"), (2, "June", "Country,Units\nA,5\n")])
    landing_file(2, [(1, "May", "Country,Units\nA,7\n")])
    for progress in ("p1", "p2"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        loads.start_curated_load(stream, rule, f"{tmp_path}/sales", f"{tmp_path}/revenue", f"{tmp_path}/{progress}").awaitTermination()
        rows = {(r.l0_id, r.country, r.report_period): r.units for r in spark.read.schema(loads.SALES_SCHEMA).parquet(f"{tmp_path}/sales").collect()}
        assert rows.keys() == {(1, "A", "2024-05"), (1, "B", "2024-05"), (2, "A", "2024-06")}
        assert rows[(1, "B", "2024-05")] == 2.0 and rows[(2, "A", "2024-06")] == 5.0 and rows[(1, "A", "2024-05")] == 7.0


def test_numeric_columns_leave_out_metadata(spark):
    df = spark.sql("select 1 as entity_id, 'x' as name, 1.5D as a, cast(2 as decimal(5,1)) as b, true as flag")
    assert matrix.numeric_columns(df, ["entity_id"]) == ["a", "b"]
