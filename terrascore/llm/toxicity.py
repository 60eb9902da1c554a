"""Toxicity score: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Distinct character n-grams of the lowered text are hashed into buckets. Over the labelled rows that may be learned from, the ratio
``ln((p + a) / P / ((q + a) / Q))`` of a bucket compares the toxic texts that have it with the others; a logistic regression on the
scaled presence of the buckets is fitted by distributed L-BFGS. Buckets in few texts carry no weight.

The training sample is bounded by ``sample_rows`` (chosen by a hash of the id over all labelled rows, with its own share for each class,
so that a rare class is not lost, and weighed back to all labelled rows); every text is scored whole.

Defined results: null or empty text: the score of a text without features. A text with null label, or an id without text, teaches
nothing. Several labels for one id: the largest counts. Repeated rows count as often as they occur. No labels of one kind: the score
is the share of toxic labels (0.0 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch, char_runs, gram_hashes, held_out, sampled
from terrascore.llm.descent import Loss, minimise


@dataclass(frozen=True)
class ToxicitySettings:
    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    smoothing: float = 1.0
    least_texts: int = 4
    least_ratio: float = 0.7
    sample_rows: int = 12_000
    sample_tasks: int = 12
    penalty: float = 1e-4
    steps: int = 25


def buckets_of(column: pa.Array, settings: ToxicitySettings) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct buckets of its n-grams); a long text comes in several parts."""
    shift = np.uint64(64 - settings.bits)
    for rows, codes, first, end in char_runs(column, max(settings.orders) - 1, lower=True):
        hashed = [(gram_hashes(codes, n) >> shift).astype(np.uint32) for n in settings.orders]
        for row, a, b in zip(rows.tolist(), first.tolist(), end.tolist()):
            yield row, np.unique(np.concatenate([h[a:b] for h in hashed]))


def _whole(column: pa.Array, settings: ToxicitySettings) -> list[np.ndarray]:
    """Distinct buckets of every row."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for row, found in buckets_of(column, settings):
        out[row].append(found)
    return [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint32) for x in out]


def log_count_ratios(sample: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """(bucket, ratio) over a frame (label, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << settings.bits), np.int32)
        for batch in batches:
            for label, found in zip(batch.column("label").to_pylist(), _whole(batch.column("text"), settings)):
                seen[label][found] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[1][some].astype(np.int64)), pa.array(seen[0][some].astype(np.int64))], names=["bucket", "toxic", "other"])

    counts = sample.mapInArrow(count, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"))
    texts = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    a = settings.smoothing
    ratio = F.log((F.col("p") + a) / (texts.toxic + 2 * a)) - F.log((F.col("q") + a) / (texts.n - texts.toxic + 2 * a))
    return counts.where(F.col("p") + F.col("q") >= settings.least_texts).select("bucket", ratio.alias("ratio")).where(F.abs("ratio") >= settings.least_ratio)


def weighted_logistic(share: np.ndarray) -> Loss:
    """Loss and gradient of a logistic regression with a weight for each class; the last weight of the model is the intercept."""

    def logistic(w: np.ndarray, label: np.ndarray, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        z = np.bincount(row, w[ids] * values, len(sizes)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        loss = (np.logaddexp(0, z) - label * z) * share[label.astype(np.int64)]
        off = (p - label) * share[label.astype(np.int64)]
        grad = np.bincount(ids, off[row] * values, len(w)).astype(float)
        grad[-1] += off.sum()
        return float(loss.sum()), grad

    return logistic


@dataclass
class ToxicityModel:
    settings: ToxicitySettings
    weights: np.ndarray  # ratio times weight of every bucket
    intercept: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, held_out, score and predicted of every row of docs."""
        model = self
        source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
        kind = source.schema["doc_id"].dataType.simpleString()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = np.array([model.weights[found].sum(dtype=np.float64) for found in _whole(batch.column("text"), model.settings)]) + model.intercept
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

        return source.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Learn from the labelled rows of ``docs`` (doc_id, text) outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    parts = [sampled(known.where(F.col("label") == k), "doc_id", settings.sample_rows // 2) for k in (0, 1)]
    texts = docs.where("text is not null").select("doc_id", "text")
    # at most about sample_rows ids and labels are broadcast
    sample = texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("label", F.col("text").cast("string").alias("text"))
    sample = scratch.store(sample.repartition(settings.sample_tasks), "sample")
    size = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic = size.toxic or 0
    weights = np.zeros(1 << settings.bits, np.float32)
    if toxic in (0, size.n):
        return ToxicityModel(settings, weights, 60.0 if toxic else -60.0)
    ratios = log_count_ratios(sample, settings).toPandas().sort_values("bucket")
    ratio = np.zeros(1 << settings.bits, np.float32)
    ratio[ratios.bucket.to_numpy()] = ratios.ratio.to_numpy()
    place = np.full(1 << settings.bits, -1, np.int32)
    place[ratios.bucket.to_numpy()] = np.arange(len(ratios))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[place[x] >= 0] for x in _whole(batch.column("text"), settings)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([place[x] for x in found], pa.list_(pa.int32())), pa.array([ratio[x] for x in found], pa.list_(pa.float32()))], names=["label", "ids", "values"])

    rows = scratch.store(sample.mapInArrow(features, "label int, ids array<int>, values array<float>"), "features")
    start = np.zeros(len(ratios) + 1)
    # every class weighs as in all labelled rows, however many of it were taken
    true = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    start[-1] = np.log(true[1] / true[0])
    share = np.array([true[0] / (size.n - toxic), true[1] / toxic]) / (true[0] + true[1])
    penalty = np.full(len(start), settings.penalty)
    penalty[-1] = 0.0
    fitted = minimise(rows, weighted_logistic(share), start, penalty, 1, settings.steps)
    weights[ratios.bucket.to_numpy()] = ratios.ratio.to_numpy() * fitted[:-1]
    for name in ("sample", "features"):
        scratch.drop(name)
    return ToxicityModel(settings, weights, float(fitted[-1]))
