"""The exact silhouette by pairs of blocks, nearest centres, and rows dealt out by their number."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from terrascore.operators import learning
from terrascore.session import spread


def by_hand(x, label):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, k in enumerate(label):
        own = (label == k).sum()
        a = gaps[i][label == k].sum() / (own - 1) if own > 1 else 0.0
        b = min(gaps[i][label == j].mean() for j in set(label) - {k})
        out.append((b - a) / max(a, b) if own > 1 and max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("rows", [7, 8192])
def test_exact_silhouette_by_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(learning, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (90, 4)) + 1e4
    x[:9] = x[0]
    label = rng.integers(0, 4, 90)
    label[89] = 4
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "entity_id long, label int, x array<double>")
    df = df.select("entity_id", "label", array_to_vector("x").alias("features"))
    assert learning.silhouette_euclidean(df, "entity_id", label="label") == pytest.approx(by_hand(x, label), abs=1e-9)


def test_equal_rows_have_no_distance():
    x = np.full((30, 3), 0.1) + 1e5
    assert (learning._distance_sums(x, x) == 0).all()


def test_distance_sums_of_wide_blocks():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 5))
    y = rng.normal(0, 1, (5000, 5))
    assert learning._distance_sums(x, y) == pytest.approx(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).sum(axis=1))


def test_rows_are_dealt_out_by_their_number(spark):
    """A frame in eight splits, all rows in one of them, as a file with a single row group has them."""
    lone = spark.range(1000).coalesce(1).union(spark.range(0, 0, 1, 7))
    sizes = spread(lone, 100).rdd.glom().map(len).collect()
    assert len(sizes) == 10 and max(sizes) < 200


def test_nearest_centres_as_argmin_has_them():
    gaps = np.random.default_rng(8).integers(0, 3, (5, 4, 200)).astype(float)
    gaps[2, 1, :9] = np.nan
    gaps[:, 3, 7] = np.nan
    found = learning._first_least(gaps, gaps.min(axis=0))
    assert (found.sum(axis=0) == 1).all() and (found.argmax(axis=0) == gaps.argmin(axis=0)).all()


def test_clusters_are_found_once_per_k(spark, monkeypatch):
    """The quality of a k reads stored clusters."""
    seen = []
    inner = learning.davies_bouldin
    monkeypatch.setattr(learning, "davies_bouldin", lambda df, *a: (seen.append(df.storageLevel.useMemory), inner(df, *a))[1])
    x = np.random.default_rng(9).normal(0, 1, (40, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity_id long, x array<double>").select("entity_id", array_to_vector("x").alias("features"))
    learning.kmeans_select(df, ks=(2, 3), restarts=2)
    assert seen == [True, True]
