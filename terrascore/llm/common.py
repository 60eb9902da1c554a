"""Shared helpers: stored intermediates that can be dropped, and byte-level word hashing for Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.session import shared_folder

#: Words are split on these bytes: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text hashed in one numpy pass; bounds the memory of a pass, not the length of a text.
PASS_BYTES = 1 << 18
#: Bytes of a batch on its way to a Python worker; the default of 64 MB is held several times over by the JVM and the worker.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Scratch:
    """Frames written to the shared folder and read back: heavy work runs once, and a lost executor does not replay it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_folder(spark)}/terrascore/{label}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a stored frame that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the test fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def passes(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most PASS_BYTES bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + PASS_BYTES, "right")) - 1, first + 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of texts, A-Z lowered, from UTF-8 bytes without a Python loop over words."""

    def __init__(self):
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PASS_BYTES * 2, base, np.uint64)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PASS_BYTES * 2, inverse, np.uint64)]), dtype=np.uint64)
            code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        code[65:91] = code[97:123]
        self.code = code
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start offsets and hashes of the words of one byte run."""
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = self._cut(data, at)
            piece = data[at:end]
            inside = ~self.space[piece]
            edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(s):
                hashes.append(self._hash(piece, s, e))
                starts.append(s + at)
            at = end
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def _cut(self, data: np.ndarray, at: int) -> int:
        """End of a piece of about PASS_BYTES that splits no word."""
        end = at + PASS_BYTES
        while end < len(data):
            gaps = np.flatnonzero(self.space[data[end : end + PASS_BYTES]])
            if len(gaps):
                return end + int(gaps[0]) + 1
            end += PASS_BYTES
        return len(data)

    def _hash(self, piece: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if len(piece) < len(self.power):
                run = np.concatenate([[np.uint64(0)], np.cumsum(self.code[piece] * self.power[: len(piece)], dtype=np.uint64)])
                out = (run[e] - run[s]) * self.inverse[s]
                alone = np.flatnonzero(e - s > PASS_BYTES)
            else:
                out, alone = np.zeros(len(s), np.uint64), np.arange(len(s))
            for i in alone.tolist():
                out[i] = self._slices(piece[s[i] : e[i]])
            return mix(out + (e - s).astype(np.uint64))

    def _slices(self, word: np.ndarray) -> np.uint64:
        """The sum of one word; a word longer than PASS_BYTES is folded slice by slice."""
        total = np.zeros(1, np.uint64)
        for at in range(0, len(word), PASS_BYTES):
            part = word[at : at + PASS_BYTES]
            total = (mix(total) if at else total) + np.sum(self.code[part] * self.power[: len(part)], dtype=np.uint64)
        return total[0]

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of several texts laid end to end, and the row bounds in them."""
        sizes = np.diff(offsets)
        placed = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        for i, (a, b, at) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), begin.tolist())):
            placed[at : at + b - a] = data[a:b]
        starts, hashes = self.words(placed)
        return hashes, np.searchsorted(starts, begin)


def char_runs(column: pa.Array, context: int, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of texts in runs of bounded size: (row of each segment, codes, first and end position of each segment).

    Every segment has ``context`` codes before it: spaces at the start of a text, the preceding characters inside a long one, which
    comes as several segments. So what is computed for the characters of a text from their left context does not depend on the runs.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data, offsets = utf8(pc.utf8_lower(column) if lower else column)
    pad = np.full(context, 0x20, np.uint32)

    def decode(a: int, b: int) -> np.ndarray:
        return np.frombuffer(data[a:b].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)

    for a, b in passes(offsets):
        start, end = int(offsets[a]), int(offsets[b])
        if end - start <= PASS_BYTES:
            codes = decode(start, end)
            chars = np.concatenate([[0], np.cumsum((data[start:end] & 0xC0) != 0x80)])[offsets[a : b + 1] - start]
            first = chars[:-1] + context * np.arange(1, b - a + 1)
            placed = np.full(len(codes) + context * (b - a), 0x20, np.uint32)
            placed[np.arange(len(codes)) + context * np.repeat(np.arange(1, b - a + 1), np.diff(chars))] = codes
            yield np.arange(a, b), placed, first, first + np.diff(chars)
            continue
        tail = pad
        while start < end:
            stop = min(start + PASS_BYTES, end)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop += 1
            codes = np.concatenate([tail, decode(start, stop)])
            yield np.array([a]), codes, np.array([context]), np.array([len(codes)])
            tail, start = codes[len(codes) - context :], stop


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last ``order`` codes at every position from ``order - 1`` on, at the index of the last one."""
    with np.errstate(over="ignore"):
        out = np.full(len(codes), np.uint64(order) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
        for k in range(order):
            out[order - 1 :] += (codes[order - 1 - k : len(codes) - k].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64))
        return mix(out)


def fraction_for(rows: int, bound: int) -> float:
    """Share of rows to take for a sample of about ``bound`` rows."""
    return min(1.0, bound / max(rows, 1))


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows of df, chosen by a hash of the key: the same rows in every run and for every partitioning."""
    share = fraction_for(df.count(), bound)
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
