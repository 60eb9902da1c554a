"""Quality grade of a text by ordinal cumulative-link regression.

Graded ratings 0 .. K-1 are explained by one score ``s = w . x`` of hashed character n-grams and ordered thresholds
``t1 < t2 < ...`` with ``P(grade <= k) = sigmoid(t(k+1) - s)``: the weights are shared by all grades. Features are square roots of
relative n-gram frequencies, so the length of a text does not matter. Weights and thresholds (a first one and positive gaps) are fitted
together by distributed L-BFGS on a sample of at most about ``sample_rows`` rated texts, chosen by a hash of the id over all of them
with a share of its own for every grade, and weighted back to the true shares. Each text is scored whole: the expected grade
``sum P(grade >= k)`` and the tail probabilities serve selection.

Defined results: null or empty text: the scores of a text without features. Null grades or ids teach nothing; several ratings for one
id: the smallest counts. Repeated rows count as often as they occur. A grade that nobody gave has no probability of its own. Fewer than
two grades given: every text gets that grade (0 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch, char_runs, gram_hashes, held_out, sampled
from terrascore.llm.descent import minimise


@dataclass(frozen=True)
class QualitySettings:
    grades: int = 3
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 14
    sample_rows: int = 9_000
    sample_tasks: int = 12
    penalty: float = 1e-4
    steps: int = 40
    keep_grade: int = 1
    keep_probability: float = 0.5


def histograms(column: pa.Array, settings: QualitySettings) -> Iterator[np.ndarray]:
    """Square roots of the relative bucket frequencies of each row, in order."""
    dims, shift = 1 << settings.bits, np.uint64(64 - settings.bits)
    row_now, counts = 0, np.zeros(dims)
    for rows, codes, first, end in char_runs(column, max(settings.orders) - 1, lower=False):
        hashed = [(gram_hashes(codes, n) >> shift).astype(np.int64) for n in settings.orders]
        for row, a, b in zip(rows.tolist(), first.tolist(), end.tolist()):
            if row != row_now:
                yield np.sqrt(counts / max(counts.sum(), 1))
                row_now, counts = row, np.zeros(dims)
            for h in hashed:
                counts += np.bincount(h[a:b], minlength=dims)
    if len(column):
        yield np.sqrt(counts / max(counts.sum(), 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def thresholds(tail: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([tail[:1], np.exp(np.clip(tail[1:], -30, 30))]))


def cumulative_link(grades: int, share: np.ndarray):
    """Loss over rows whose label is a grade; ``share`` weighs a row by its grade."""

    def loss(w: np.ndarray, label: np.ndarray, sizes: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray]:
        dims = len(w) - (grades - 1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        score = np.bincount(row, w[ids] * values, len(sizes))
        edge = np.concatenate([[-np.inf], thresholds(w[dims:]), [np.inf]])
        upper, lower = sigmoid(edge[label + 1] - score), sigmoid(edge[label] - score)
        p = np.maximum(upper - lower, 1e-12)
        up, low = share[label] * upper * (1 - upper) / p, share[label] * lower * (1 - lower) / p
        grad = np.zeros(len(w))
        grad[:dims] = np.bincount(ids, (up - low)[row] * values, dims)
        by_edge = np.bincount(label, low, grades)[1:] - np.bincount(label, up, grades)[:-1]
        # a gap moves all thresholds from its own on
        grad[dims:] = np.cumsum(by_edge[::-1])[::-1] * np.concatenate([[1.0], np.exp(np.clip(w[dims + 1 :], -30, 30))])
        return float(-(share[label] * np.log(p)).sum()), grad

    return loss


@dataclass
class QualityModel:
    settings: QualitySettings
    weights: np.ndarray
    edges: np.ndarray  # thresholds

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, held_out, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...) and kept of every row of docs."""
        model, settings = self, self.settings
        source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
        kind = source.schema["doc_id"].dataType.simpleString()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.array([x @ model.weights for x in histograms(batch.column("text"), settings)])
                tails = 1 - sigmoid(model.edges[None, :] - score[:, None])
                kept = tails[:, settings.keep_grade - 1] >= settings.keep_probability
                arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "expected_grade", "tails", "kept"])

        return source.mapInArrow(apply, f"doc_id {kind}, held_out boolean, expected_grade double, tails array<double>, kept boolean")


def fit_quality(docs: DataFrame, ratings: DataFrame, settings: QualitySettings = QualitySettings()) -> QualityModel:
    """Learn from docs (doc_id, text) and ratings (doc_id, grade) outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "quality")
    top = settings.grades - 1
    known = ratings.where("doc_id is not null and grade is not null").where(~held_out()).groupBy("doc_id").agg(F.greatest(F.lit(0), F.least(F.lit(top), F.min("grade"))).cast("int").alias("label"))
    per_grade = [sampled(known.where(F.col("label") == k), "doc_id", settings.sample_rows // settings.grades) for k in range(settings.grades)]
    chosen = per_grade[0]
    for part in per_grade[1:]:
        chosen = chosen.union(part)
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.flatnonzero(x).astype(np.int32), x[x > 0].astype(np.float32)) for x in histograms(batch.column("text"), settings)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], names=["label", "ids", "values"])

    # at most about sample_rows ids and labels are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").repartition(settings.sample_tasks)
    rows = scratch.store(rows.mapInArrow(features, "label int, ids array<int>, values array<float>"), "features")
    taken = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    dims = 1 << settings.bits
    if len(taken) < 2:
        only = next(iter(taken), 0)
        return QualityModel(settings, np.zeros(dims), np.where(np.arange(1, settings.grades) <= only, -60.0, 60.0))
    true = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    everything = sum(true.values())
    share = np.array([true.get(k, 0) / max(taken.get(k, 0), 1) for k in range(settings.grades)]) / everything
    below = np.cumsum([true.get(k, 0) / everything for k in range(settings.grades)])[:-1]
    edge = np.log(np.clip(below, 1e-3, 1 - 1e-3) / np.clip(1 - below, 1e-3, 1))
    start = np.concatenate([np.zeros(dims), edge[:1], np.log(np.maximum(np.diff(edge), 1e-2))])
    penalty = np.concatenate([np.full(dims, settings.penalty), np.zeros(top)])
    fitted = minimise(rows, cumulative_link(settings.grades, share), start, penalty, 1, settings.steps)
    scratch.drop("features")
    return QualityModel(settings, fitted[:dims], thresholds(fitted[dims:]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from two-valued labels: 0 poor, 1 good but toxic, 2 good and not toxic. An unknown toxic label leaves no rating."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") > 0, 1).when(F.col("toxic") == 0, 2)
    return labels.select("doc_id", grade.alias("grade"))
