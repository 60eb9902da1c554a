"""Token counts of byte-level BPE by rank-synchronous merging.

The merge table is read once on the driver (its size is that of the vocabulary) and sent to the workers as sorted arrays. A worker
cuts texts into pre-tokens, and counts each new pre-token once: a batch of them is one ragged numpy array of symbol ids, and a round
looks up the rank of every neighbouring pair, finds the lowest rank of each sequence and merges all its occurrences in all sequences
at the same time. Sequences without a mergeable pair leave; what survives of each is its token count. Counts are remembered in a
table of bounded size.

Defined results: null or empty text: 0 bytes, 0 tokens. Text of any length is read in pieces cut before a white-space character that
follows another character, where no pre-token can cross. Strings of added tokens inside a text are one token each, as the library
does by default. Repeated rows come back repeated; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import bounded_batches

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters read at once, and counts remembered by a worker.
PIECE_CHARS = 1 << 19
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class MergeTable:
    """Sorted arrays of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        self.letters = np.array([vocab[x] for x in byte_letters()], np.int64)
        pairs = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.added = [x["content"] for x in stored.get("added_tokens", [])]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        out, alive = sizes.copy(), np.flatnonzero(sizes > 1)
        ids = self.letters[np.frombuffer(b"".join(raw[i] for i in alive.tolist()), np.uint8)]
        sizes = sizes[alive]
        none = len(self.merged)
        while len(alive):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), none - 1)
            rank = np.where(self.pairs[at] == key, self.ranks[at], none)
            rank = np.append(rank, none)
            rank[ends - 1] = none  # no pair across two sequences
            lowest = np.minimum.reduceat(rank, starts)
            owner = np.repeat(np.arange(len(alive)), sizes)
            hit = (rank == lowest[owner]) & (rank < none)
            # in a run such as aaaa only every second pair can merge
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            position = np.flatnonzero(hit)
            first = run[np.searchsorted(run, position, "right") - 1]
            position = position[(position - first) % 2 == 0]
            ids = ids.copy()
            ids[position] = self.merged[rank[position]]
            keep = np.ones(len(ids), bool)
            keep[position + 1] = False
            sizes = sizes - np.bincount(owner[position], minlength=len(alive))
            going = (lowest < none) & (sizes > 1)
            out[alive] = sizes
            keep &= going[owner]
            ids, alive, sizes = ids[keep], alive[going], sizes[going]
        return out


def pieces(text: str) -> Iterator[str]:
    """The text in order, cut only where a white-space character follows another character."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = SAFE.search(text, start + PIECE_CHARS)
        if not cut:
            break
        yield text[start : cut.start() + 1]
        start = cut.start() + 1
    yield text[start:]


SAFE = regex.compile(r"\P{White_Space}(?=\p{White_Space})")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    bounded_batches(docs.sparkSession)
    table = MergeTable(path)
    pattern, remembered = PATTERN, REMEMBERED
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        added = regex.compile("|".join(regex.escape(x) for x in table.added)) if table.added else None
        known: dict[str, int] = {}

        def settle(waiting: list[tuple[int, list[str]]], tokens: np.ndarray) -> None:
            new = list(set().union(*(words for _, words in waiting)).difference(known))
            if len(known) + len(new) > remembered:
                known.clear()
                new = list(set().union(*(words for _, words in waiting)))
            if new:
                known.update(zip(new, table.counts(new).tolist()))
            for row, words in waiting:
                tokens[row] += sum(map(known.__getitem__, words))

        for batch in batches:
            tokens, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            waiting, held = [], 0
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py() or ""
                sizes[row] = len(text.encode("utf-8"))
                parts = [text]
                if added and added.search(text):
                    parts = added.split(text)
                    tokens[row] += len(parts) - 1
                for part in parts:
                    for piece in pieces(part):
                        waiting.append((row, cut.findall(piece)))
                        held += len(piece)
                        if held > PIECE_CHARS:
                            settle(waiting, tokens)
                            waiting, held = [], 0
            settle(waiting, tokens)
            arrays = [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
