"""Runs of repeated word sequences, found by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are identical) and at least ``least_copies`` * q and ``least_words``
words that no neighbouring word extends. Texts are independent of each other, so one pass of Arrow batches does all: no shuffle.

A worker lays texts of bounded size end to end, each closed by a mark of its own, and doubles prefix ranks: level k holds the class of
every block of 2^k words, the last level the suffix array, in which every class is one range. For each dyadic level, the blocks at
multiples of 2^k ask for their next and previous occurrence in the neighbouring window: a range successor (predecessor) query to a
wavelet tree over the suffix array. A run of period q with four copies covers an aligned block of the smallest power of two >= q
together with its occurrence q words further on or back; in a periodic stretch the occurrences of a block form a progression whose
difference is the period, so the distance of neighbouring occurrences, where it is in (2^(k-1), 2^k], is a candidate period. The same
ranks extend a candidate to both sides. The distance to the nearest occurrence cannot be a multiple of the smallest period.

Memory of a worker: a pass holds texts of PASS_BYTES bytes together, or one longer text, with one rank a word for each level.

Defined results: null text and text without words: no runs, empty collapsed text. Rows are independent: repeated rows come back as often
as they occur, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import bounded_batches, passes, utf8


@dataclass(frozen=True)
class RunSettings:
    least_words: int = 6
    least_copies: int = 4  # below four an aligned block may miss its next occurrence


class PrefixRanks:
    """Classes of all blocks of 2^k words, and the suffix array. A rank is the place of the first suffix of its class."""

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        _, first, counts = np.unique(words, return_inverse=True, return_counts=True)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        rank = starts[first.reshape(-1)].astype(np.int32)
        sizes = counts[first.reshape(-1)]
        self.levels = [rank]
        active = np.flatnonzero(sizes > 1)
        span = 1
        while len(active) and span <= longest:
            # only classes of several blocks are told apart by what follows
            after = active + span
            key = rank[active].astype(np.int64) << 32
            key |= np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            active, key = active[order], key[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.concatenate([[True], (key[1:] >> 32) != (key[:-1] >> 32)])
            at = np.arange(len(key))
            place = np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            rank = rank.copy()
            rank[active] += place.astype(np.int32)
            alone = head & np.concatenate([head[1:], [True]])
            active = active[~alone]
            self.levels.append(rank)
            span *= 2
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n, dtype=np.int32)
        self.n = n

    def class_ends(self, level: int) -> np.ndarray:
        """For every rank of the level that is in use the place after its class."""
        counts = np.bincount(self.levels[level], minlength=self.n)
        return np.arange(self.n) + counts

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from a and from b on agree, and how many before them; a < b."""
        forward, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, span = self.levels[level], 1 << level
            # a block that reaches past the end holds a mark and equals no other, so a bound on the start is enough
            x, y = a + forward, b + forward
            forward += np.where((y < self.n) & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)]), span, 0)
            x, y = a - back - span, b - back - span
            back += np.where((x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]), span, 0)
        return forward, back


class WaveletTree:
    """Bits of the values of an array, level by level from the highest: order statistics of any range of it."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for k in range(self.bits - 1, -1, -1):
            one = (values >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            left = one == 0
            self.zeros.append(int(left.sum()))
            values = np.concatenate([values[left], values[~left]])

    def below(self, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of each range are less than its limit."""
        count = np.zeros(len(start), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            s, e = ones[start], ones[end]
            right = (limit >> (self.bits - 1 - k)) & 1 == 1
            count += np.where(right, (end - e) - (start - s), 0)
            start, end = np.where(right, zeros + s, start - s), np.where(right, zeros + e, end - e)
        return count

    def pick(self, start: np.ndarray, end: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value of each range with so many smaller ones."""
        value = np.zeros(len(start), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            s, e = ones[start], ones[end]
            left = (end - e) - (start - s)
            right = nth >= left
            value = (value << 1) | right
            nth = np.where(right, nth - left, nth)
            start, end = np.where(right, zeros + s, start - s), np.where(right, zeros + e, end - e)
        return value


def find_runs(words: np.ndarray, bounds: np.ndarray, settings: RunSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in texts laid end to end, by start and period.

    ``bounds`` are the starts of the texts and the end of the last one; the last word of each text is a mark that occurs only once.
    """
    longest = int(np.diff(bounds).max(initial=0))
    ranks = PrefixRanks(words, longest)
    tree = WaveletTree(ranks.order)
    pairs: list[np.ndarray] = []
    for level in range(len(ranks.levels)):
        span = 1 << level
        if span > longest:
            break
        blocks = np.arange(0, ranks.n, span)
        start = ranks.levels[level][blocks].astype(np.int64)
        end = ranks.class_ends(level)[start]
        several = end - start > 1
        blocks, start, end = blocks[several], start[several], end[several]
        own = tree.below(start, end, blocks)
        later = own + 1 < end - start
        after = tree.pick(start[later], end[later], own[later] + 1)
        earlier = own > 0
        before = tree.pick(start[earlier], end[earlier], own[earlier] - 1)
        first = np.concatenate([blocks[later], before])
        second = np.concatenate([after, blocks[earlier]])
        near = (second - first <= span) & (2 * (second - first) > span)
        pairs.append(np.stack([first[near], second[near]]))
    first, second = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    period = second - first
    forward, back = ranks.extend(first, second)
    start, length = first - back, forward + back + period
    long = length >= np.maximum(settings.least_words, settings.least_copies * period)
    found = np.unique(np.stack([start[long], period[long], length[long]]), axis=1)
    return found[0], found[2], found[1]


def _arrays(texts: list[bytes], settings: RunSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Start, length and period of the runs of each text, and the text without repeated copies."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) + 1 for w in split])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.empty(int(bounds[-1]), np.int64)
    marks = bounds[1:] - 1
    inside = np.ones(len(ids), bool)
    inside[marks] = False
    flat = pa.array([w for words in split for w in words], pa.binary())
    ids[inside] = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids[marks] = len(ids) + np.arange(len(marks))
    start, length, period = find_runs(ids, bounds, settings)
    text = np.searchsorted(bounds, start, "right") - 1
    first = np.searchsorted(text, np.arange(len(split) + 1))
    for i, words in enumerate(split):
        a, b = first[i], first[i + 1]
        s = start[a:b] - bounds[i]
        if a < b:
            # the copies after the first one of every run go
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, s + period[a:b], 1)
            np.add.at(edge, s + length[a:b], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        yield s, length[a:b], period[a:b], b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", settings: RunSettings = RunSettings()) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period, in words) and the collapsed text of every row of docs.

    The collapsed text keeps of every run the first period; its words are joined by one space.
    """
    if settings.least_copies < 4:
        raise ValueError("runs of fewer than four copies are not found by aligned blocks")
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in passes(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                rows = list(_arrays(texts, settings))
                bounds = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
                values = [pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64)) for k in range(3)]
                runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(values, fields=list(run)))
                collapsed = pa.array([r[3] for r in rows], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), runs, collapsed], names=["doc_id", "runs", "collapsed"])

    return source.mapInArrow(find, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: counts, the run with the greatest exponent, and digests of runs and collapsed text."""
    # runs come by start, then period, so the first of equal exponents stays
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, by the crc32 of the id, is made periodic from some word on.

    With h the crc32 of the decimal id, g = h / 10 and n words, word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) / (3 + g % 8). A null id changes nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", text.alias("text"), h.alias("h"))
    chosen = chosen.select("doc_id", "text", F.when(F.col("h") % 10 == 0, F.expr("h div 10")).alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = chosen.select("doc_id", "text", "g", F.when(F.col("g").isNotNull(), words).alias("w"))
    repeated = """array_join(concat(slice(w, 1, cast(g % size(w) as int)), transform(sequence(0, cast(size(w) - g % size(w) - 1 as int)),
        k -> w[cast(g % size(w) + k % (1 + (size(w) - g % size(w)) div (3 + g % 8)) as int)])), ' ')"""
    return chosen.select("doc_id", F.when(F.size("w") > 0, F.expr(repeated)).otherwise(F.col("text")).alias("text"))
