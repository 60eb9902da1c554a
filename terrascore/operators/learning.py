"""Standardisation, principal components, k-means and cluster quality on MLlib.

Rows stay distributed; only columns x columns matrices and k centroids reach
the driver. Labels travel with entity ids, never by position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.session import materialize, spread

#: Rows of a batch that meet all centres at once.
STRIP = 1024
#: Rows on either side of a block of distances in the exact silhouette.
BLOCK_ROWS = 8192
#: Squared distances below this share of the squared lengths are taken from the differences themselves.
CLOSE = 1e-6


def to_vectors(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("entity_id",), out: str = "features") -> DataFrame:
    """Columns to one vector; a missing value is an error, as no row may drop out of a clustering unseen."""
    plain = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(plain).select(*keep, out)


def array_vectors(df: DataFrame, array: str, keep: Sequence[str], out: str = "features") -> DataFrame:
    return df.select(*keep, array_to_vector(F.transform(array, lambda x: x.cast("double"))).alias(out))


def standardise(df: DataFrame, features: str = "features") -> tuple[DataFrame, int, int]:
    """Replace ``features`` by mean 0, population deviation 1; also the row and non-constant column counts."""
    rows = df.count()
    model = StandardScaler(inputCol=features, outputCol="_z", withMean=True, withStd=True).fit(df)
    # the scaler divides by the sample deviation
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(model.mean)), inputCol="_z", outputCol="_p").transform(model.transform(df))
    return scaled.drop(features, "_z").withColumnRenamed("_p", features), rows, int((model.std.toArray() > 0).sum())


@dataclass
class Components:
    """Principal components of a standardised matrix."""

    scores: DataFrame  # the kept columns and ``components``, an array
    loadings: np.ndarray  # columns x components
    ratios: np.ndarray  # share of variance per component
    rows: int
    active: int  # non-constant columns

    def explained(self) -> DataFrame:
        """``component, ratio, cumulative``."""
        spark = self.scores.sparkSession
        total = np.cumsum(self.ratios)
        rows = [(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(self.ratios, total))]
        return spark.createDataFrame(rows, "component bigint, ratio double, cumulative double")

    def importance(self, names: Sequence[str]) -> DataFrame:
        """``code, importance``: squared loadings times variance, over all components."""
        spark = self.scores.sparkSession
        variance = self.ratios * self.active * self.rows / (self.rows - 1)
        values = (self.loadings**2) @ variance
        return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "code string, importance double")


def pca_components(df: DataFrame, k: int = 15, features: str = "features") -> Components:
    """Scores on the first ``k`` components of the standardised features.

    The sign of each component makes its largest loading positive.
    """
    scaled, rows, active = standardise(df, features)
    width = len(df.select(features).head()[0])
    model = PCA(k=min(k, width, rows), inputCol=features, outputCol="_pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    signs[signs == 0] = 1.0
    turned = F.array(*[F.lit(float(s)) for s in signs])
    scores = model.transform(scaled).withColumn("components", F.zip_with(vector_to_array("_pc"), turned, lambda x, s: x * s))
    return Components(scores.drop(features, "_pc"), loadings * signs, model.explainedVariance.toArray(), rows, active)


# -- k-means ------------------------------------------------------------------------


@dataclass
class Centres:
    """A fitted k-means model."""

    centres: np.ndarray  # k x columns
    cost: float  # squares within clusters
    features: str = "features"

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as MLlib names it
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``cluster_id``, the nearest centre; of equal ones the first."""
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in self.centres])
        gap = lambda c: F.aggregate(F.zip_with("_x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
        near = df.withColumn("_x", vector_to_array(self.features)).withColumn("_gaps", F.transform(centres, gap))
        return near.withColumn("cluster_id", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_x", "_gaps")


def _starts(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over a bounded sample."""
    rng = np.random.default_rng([seed, k])
    chosen = [sample[rng.integers(len(sample))]]
    gaps = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gaps.sum()
        at = rng.choice(len(sample), p=gaps / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        gaps = np.minimum(gaps, ((sample - sample[at]) ** 2).sum(axis=1))
    return np.stack(chosen)


def _first_least(gaps: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which gap along the first axis is the least; of equal ones the first, as ``argmin`` has it."""
    out = gaps == least
    taken = out[0].copy()
    for here in out[1:]:
        here &= ~taken
        taken |= here
    if not taken.all():  # what is no number equals nothing
        at = np.nonzero(~taken)
        out[(gaps[(slice(None), *at)].argmin(axis=0), *at)] = True
    return out


def _moved(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """For every model the means of its clusters and its cost, from one pass over the rows; an empty cluster keeps its centre."""

    groups = [[m for m in models if len(models[m]) == k] for k in sorted({len(c) for c in models.values()})]
    stacks = [(np.array(g, np.int32), np.stack([models[m] for m in g])) for g in groups]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((c.shape[0], c.shape[1], c.shape[2] + 2)) for _, c in stacks]
        # centres by (cluster, model), so that the clusters of a model are compared whole strip by whole strip
        turned = [(-2 * c.transpose(1, 0, 2).reshape(-1, c.shape[2]), (c * c).sum(axis=2).T.reshape(-1, 1)) for _, c in stacks]
        seen = False
        for batch in batches:
            every = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            seen = seen or len(every) > 0
            for at in range(0, len(every), STRIP):
                x = every[at : at + STRIP]
                own = (x * x).sum(axis=1)
                wide = np.column_stack([x, np.ones(len(x))])
                for (_, c), (doubled, lengths), total in zip(stacks, turned, sums):
                    m, k, _ = c.shape
                    gaps = (doubled @ x.T + lengths).reshape(k, m, -1)
                    least = gaps.min(axis=0)
                    member = _first_least(gaps, least).reshape(k * m, -1).astype(float)
                    total[:, :, :-1] += (member @ wide).reshape(k, m, -1).transpose(1, 0, 2)
                    total[:, 0, -1] += np.maximum(least + own, 0).sum(axis=1)
        for (names, c), total in zip(stacks, sums if seen else []):
            m, k, d = c.shape
            flat = pa.ListArray.from_arrays(pa.array(np.arange(m * k + 1, dtype=np.int32) * (d + 2)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(k, dtype=np.int32), m)), flat], names=["model", "cluster", "total"])

    parts = rows.mapInArrow(assign, "model int, cluster int, total array<double>")
    summed = parts.select("model", "cluster", array_to_vector("total").alias("total")).groupBy("model", "cluster").agg(Summarizer.sum(F.col("total")).alias("total"))
    out = {m: (c.copy(), 0.0) for m, c in models.items()}
    for r in summed.collect():
        total = r["total"].toArray()
        centres, cost = out[r["model"]]
        if total[-2] > 0:
            centres[r["cluster"]] = total[:-2] / total[-2]
        out[r["model"]] = (centres, cost + total[-1])
    return out


def kmeans_fits(
    df: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int = 500, features: str = "features", tol: float = 1e-4, sample_rows: int = 4096
) -> dict[int, Centres]:
    """Per k the fit with the least cost over several starts.

    All models take part in one pass over the rows per iteration; each leaves when the squared moves of its centres add up to at most
    ``tol`` times the mean variance of the columns. Tasks return sums by (model, cluster), which Spark adds up: what reaches the driver is the centres. Starts are drawn by k-means++ from at
    most about ``sample_rows`` rows, chosen by a hash of their values.
    """
    rows = spread(df.select(vector_to_array(features).alias("x")), 50_000).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = rows.agg(F.count(F.lit(1)).alias("n"), Summarizer.variance(array_to_vector("x")).alias("v")).head()
        n, least = size["n"], tol * float(np.mean(size["v"].toArray())) if size["n"] > 1 else 0.0
        share = min(1.0, sample_rows / max(n, 1))
        chosen = rows.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(4 * sample_rows)
        sample = np.array(sorted(r["x"] for r in chosen.collect()))
        if not len(sample):
            sample = np.array([r["x"] for r in rows.limit(1).collect()])
        jobs = [(k, s) for k in ks for s in seeds]
        fits = {i: _starts(sample, k, s) for i, (k, s) in enumerate(jobs)}
        active = dict(fits)
        for _ in range(max_iter):
            moved = {m: c for m, (c, _) in _moved(rows, active).items()}
            still = {m for m, c in moved.items() if ((c - active[m]) ** 2).sum() > least}
            fits |= moved
            active = {m: moved[m] for m in still}
            if not active:
                break
        costs = {m: cost for m, (_, cost) in _moved(rows, fits).items()}
    finally:
        rows.unpersist()
    best = {k: min((m for m, job in enumerate(jobs) if job[0] == k), key=lambda m: (costs[m], m)) for k in ks}
    return {k: Centres(fits[m], costs[m], features) for k, m in best.items()}


def best_kmeans(df: DataFrame, k: int, seeds: Sequence[int], max_iter: int = 500, features: str = "features") -> Centres:
    """The fit with the least cost over several starts."""
    return kmeans_fits(df, [k], seeds, max_iter, features)[k]


def kmeans_select(
    df: DataFrame,
    ks: Sequence[int] = tuple(range(3, 11)),
    restarts: int = 20,
    seed: int = 42,
    max_iter: int = 500,
    metric: str = "squared",
    features: str = "features",
    entity: str = "entity_id",
) -> tuple[DataFrame, Centres]:
    """Quality per k and the model with the best silhouette (the smaller k on ties).

    ``metric="squared"`` is the linear-time silhouette; ``"euclidean"`` is the
    exact one, quadratic in rows.
    """
    spark = df.sparkSession
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = []
        models = kmeans_fits(held, ks, range(seed, seed + restarts), max_iter, features)
        for k, model in models.items():
            # several passes read the clusters, one finds them
            labelled = model.transform(held).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                if metric == "euclidean":
                    quality = silhouette_euclidean(labelled, entity, features)
                else:
                    quality = ClusteringEvaluator(featuresCol=features, predictionCol="cluster_id").evaluate(labelled)
                spread = davies_bouldin(labelled, features).head()[0]
            finally:
                labelled.unpersist()
            rows.append((k, float(model.cost), float(quality), float(spread)))
    finally:
        held.unpersist()
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    schema = "k bigint, inertia double, silhouette double, davies_bouldin double, is_best boolean"
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], schema), models[best]


def _gap(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def davies_bouldin(df: DataFrame, features: str = "features", label: str = "cluster_id") -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / centre distance.

    Centres and spreads are aggregates; the k x k comparison runs on k rows.
    """
    spark = df.sparkSession
    centres = materialize(df.groupBy(F.col(label).alias("_label")).agg(Summarizer.mean(F.col(features)).alias("_c")).select("_label", vector_to_array("_c").alias("_centre")), "centres")
    own = df.select(F.col(label).alias("_own"), vector_to_array(features).alias("_x")).join(centres, F.col("_own") == F.col("_label"))
    spreads = own.groupBy("_label").agg(F.avg(_gap("_x", "_centre")).alias("spread"))
    found = {r["_label"]: r["spread"] for r in spreads.collect()}
    middle = {r["_label"]: np.array(r["_centre"]) for r in centres.collect()}
    worst = []
    for i in found:
        ratios = [(found[i] + found[j]) / gap for j in found if j != i and (gap := float(np.linalg.norm(middle[i] - middle[j]))) > 0]
        worst.append(max(ratios, default=0.0))
    return spark.createDataFrame([(float(np.mean(worst)) if worst else None,)], "davies_bouldin double")


def _distance_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every row of ``x`` the sum of its distances to the rows of ``y``, strip by strip as matrix products."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.zeros(len(x))
    width = max(1, STRIP * STRIP * 4 // len(y))
    for at in range(0, len(x), width):
        part = slice(at, at + width)
        both = xx[part, None] + yy
        squares = both - 2 * (x[part] @ y.T)
        i, j = np.nonzero(squares <= CLOSE * both)
        for k in range(0, len(i), STRIP * 16):
            a, b = i[k : k + STRIP * 16], j[k : k + STRIP * 16]
            squares[a, b] = ((x[at + a] - y[b]) ** 2).sum(axis=1)
        out[part] = np.sqrt(squares).sum(axis=1)
    return out


def _blocks_of(count: Column) -> Column:
    return F.ceil(count / F.lit(BLOCK_ROWS)).cast("int")


def silhouette_euclidean(df: DataFrame, entity: str, features: str = "features", label: str = "cluster_id") -> float:
    """Exact silhouette with plain distances.

    The mean distance of a row to a cluster is at least its distance to the centre, and at most that plus the mean distance of the
    members to it. Only clusters whose least is not above the smallest most of the row can be its nearest other one; for these and its
    own cluster the distances are summed. The rows that ask for a cluster and its members are both dealt out into blocks of about
    BLOCK_ROWS rows; every pair of blocks is one group, whose distances come from matrix products and never become rows.
    """
    rows = df.select(F.col(entity).alias("id"), F.col(label).cast("int").alias("label"), vector_to_array(features).alias("x"))
    members = materialize(rows.withColumn("dealt", F.xxhash64("id", "x")), "labelled")
    centres = materialize(df.groupBy(F.col(label).cast("int").alias("other")).agg(Summarizer.mean(F.col(features)).alias("_c"), F.count(F.lit(1)).alias("size")).select("other", "size", vector_to_array("_c").alias("centre")), "centres")
    # k rows, one for each cluster
    known = centres.agg(F.collect_list(F.struct("other", "size", "centre"))).scalar()
    reach = members.withColumn("_k", known).select("id", "label", "x", F.inline("_k")).withColumn("least", _gap("x", "centre"))
    reach = materialize(reach.select("id", "label", "other", "size", "least"), "reach")
    spread = reach.filter("label = other").groupBy(F.col("other").alias("_o")).agg(F.avg("least").alias("spread"))
    bounded = reach.join(spread, F.col("other") == F.col("_o")).select("id", "label", "other", "size", "least", (F.col("least") + F.col("spread")).alias("most"))
    nearest_most = F.min(F.when(F.col("label") != F.col("other"), F.col("most"))).over(Window.partitionBy("id"))
    open_ = bounded.withColumn("_m", nearest_most).filter((F.col("label") == F.col("other")) | (F.col("least") <= F.col("_m") * (1 + 1e-9)))
    open_ = materialize(open_.select("id", "label", "other", "size"), "open")
    # the blocks of a cluster and of the rows that ask for it
    asked = open_.groupBy("other").agg(_blocks_of(F.count(F.lit(1))).alias("parts"))
    sides = materialize(centres.select("other", _blocks_of(F.col("size")).alias("blocks")).join(asked, "other"), "blocks")
    few = F.broadcast(sides)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = open_.join(members.select("id", "x", "dealt"), "id").join(few, "other")
    asking = asking.select("id", "label", "other", "size", "x", F.pmod("dealt", "parts").cast("int").alias("part"), every("blocks").alias("block"))
    held = members.select(F.col("label").alias("other"), F.col("x").alias("y"), "dealt").join(few, "other")
    held = held.select("other", "y", F.pmod("dealt", "blocks").cast("int").alias("block"), every("parts").alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        total = _distance_sums(flat(left, "x"), flat(right, "y")) if left.num_rows and right.num_rows else np.zeros(left.num_rows)
        found = left.select(["id", "label", "other", "size"]).append_column("total", pa.array(total))
        return found if right.num_rows else found.slice(0, 0)

    keys = ["other", "block", "part"]
    # few bytes, much arithmetic: a stated number of partitions is not coalesced
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    met = asking.repartition(parts, *keys).groupBy(*keys).cogroup(held.repartition(parts, *keys).groupBy(*keys))
    kind = members.schema["id"].dataType.simpleString()
    met = met.applyInArrow(meet, f"id {kind}, label int, other int, size bigint, total double")
    sums = met.groupBy("id", "label", "other").agg(F.max("size").alias("size"), F.sum("total").alias("total"))
    own = F.col("label") == F.col("other")
    each = sums.groupBy("id").agg(
        F.max(F.when(own, F.col("size"))).alias("n"),
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    s = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return each.agg(F.avg(F.coalesce(s, F.lit(0.0)))).head()[0]
