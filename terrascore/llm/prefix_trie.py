"""The trie of conversation prefixes: one node for every distinct sequence of first turns.

A turn becomes a 128-bit id (two 64-bit hashes of role and text, which stand for their equality) and a number of words; from there on no
text moves. Conversations are range-partitioned by their id sequences, then by conversation, with splitters that Spark samples; the number
of shards follows the number of turns, so a shard has a bounded size, and a sequence of which a third of all conversations are copies
spreads over as many shards as it needs.

A task lays its shard out as a matrix of dense turn ids, one conversation a row, padded where one is shorter, and sorts the rows by
``np.lexsort``. Where a column differs from the row before, a node starts; the masks are OR-accumulated along the columns, as a change
carries on to all deeper ones. ``np.reduceat`` over the starts of a column gives all nodes of that depth. Wide matrices are taken in
panels of columns, each with those rows alone that reach it, so memory follows the turns and not the longest conversation.

Nodes inside a shard are complete. Those on the path of its first or last conversation may go on in the neighbours: they come out as
partial cells, twice the number of shards times their depth at most, and one task recombines them with the same matrix, whose rows
are these border conversations. The list of the conversations that end in such a node is never gathered: every shard holds its part in
order, and a digest runs over the parts one after the other.

Defined results: null conversation ids are left out; turns come by number, null first, equal numbers by the id of the turn; repeated rows
are turns of their own. Other columns are ignored. Empty tables: no nodes, not even a root. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch


@dataclass(frozen=True)
class TrieSettings:
    shard_turns: int = 400_000  # turns of a range shard, on average at most
    panel: int = 64  # columns of the matrix at a time


#: Sides of a cell: complete, or on the path of the first or last conversation of its shard.
INSIDE, FIRST, LAST = 0, 1, 2
CELLS = (
    "shard int, side int, depth long, conv_id long, parent_conv_id long, parent_side int, n_convs long, words long, n_children long, n_leaves long, "
    "saved_tokens long, hi long, lo long, ends string"
)
MERGED = "shard int, side int, depth long, conv_id long, head boolean, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns an array of (hi, lo, words) in order, from rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    turn = F.struct(F.col("turn"), F.xxhash64(F.lit(1), role, text).alias("hi"), F.xxhash64(F.lit(2), text, role).alias("lo"), words.alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def with_shared_starts(sequences: DataFrame, block: int = 20, most: int = 3) -> DataFrame:
    """Every conversation c takes its first h turns from the first one of its block of ids, h being crc32(c) modulo ``most`` + 1.

    If that one has fewer turns, all of them; if there is none, none. Its own turns after its first h follow.
    """
    first = F.col("conv_id") - F.col("conv_id") % block
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = sequences.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, most).alias("head"))
    joined = sequences.select("conv_id", "turns", first.alias("first_id"), h.alias("h")).join(heads, "first_id", "left")
    start = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(start, own).alias("turns"))


def dense(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Turn ids as small numbers in the same order."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(np.concatenate([[0], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(order) else 0
    return out


def lay_out(ids: np.ndarray, offsets: np.ndarray, tie: np.ndarray, panel: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows in lexicographic order, equal ones by ``tie``, and for depth 0, 1, ... the first and the end place of every node."""
    sizes = np.diff(offsets)
    order = np.argsort(tie, kind="stable")
    group = np.zeros(len(order), np.int64)
    levels = [(np.array([0]), np.array([len(order)]))]
    for left in range(0, int(sizes.max(initial=0)), panel):
        places = np.flatnonzero(sizes[order] >= left)
        rows = order[places]
        width = min(panel, int(sizes[rows].max()) - left)
        filled = np.clip(sizes[rows] - left, 0, width)
        r = np.repeat(np.arange(len(rows)), filled)
        c = np.arange(len(r)) - np.repeat(np.cumsum(filled) - filled, filled)
        matrix = np.full((len(rows), width), -1, np.int32)
        matrix[r, c] = ids[offsets[rows][r] + left + c]
        prefix = group[places]
        by = np.lexsort((*matrix.T[::-1], prefix))
        matrix = matrix[by]
        order[places] = rows[by]
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        changed[1:, 0] |= prefix[1:] != prefix[:-1]
        np.logical_or.accumulate(changed, axis=1, out=changed)
        for d in range(width):
            start = np.flatnonzero(changed[:, d])
            end = np.append(start[1:], len(rows))
            there = matrix[start, d] >= 0
            levels.append((places[start[there]], places[end[there] - 1] + 1))
        group[places] = np.cumsum(changed[:, -1])
    return order, levels


def over(reduce: np.ufunc, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``reduce`` over values[start:end] of every node of a level; nodes are apart and in order."""
    return reduce.reduceat(np.append(values, values[-1:]), np.ravel([start, end], order="F"))[::2] if len(start) else values[:0]


def parents(levels: list[tuple[np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    return np.searchsorted(levels[d - 1][0], levels[d][0], "right") - 1


def summed(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


EMPTY = digest("")


def shard_cells(conv: np.ndarray, offsets: np.ndarray, hi: np.ndarray, lo: np.ndarray, words: np.ndarray, shard: int, panel: int) -> Iterator[pa.RecordBatch]:
    """Complete nodes of a shard, and its partial nodes: a row for each depth of the first and of the last conversation."""
    order, levels = lay_out(dense(hi, lo), offsets, conv, panel)
    conv, sizes, begin = conv[order], np.diff(offsets)[order], offsets[:-1][order]
    names = conv.astype(str)
    n_rows = len(conv)
    below: tuple[np.ndarray, ...] | None = None
    for d in range(len(levels) - 1, -1, -1):
        start, end = levels[d]
        n = len(start)
        first, last = start == 0, end == n_rows
        edge = first | last
        counts = end - start
        lowest = over(np.minimum, conv, start, end)
        token = words[begin[start] + d - 1] if d else np.zeros(n, np.int64)
        kids, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if below is not None:
            # partial children are left to the recombination
            up, whole, child_leaves, child_saved = below
            kids = np.bincount(up[whole], minlength=n).astype(np.int64)
            leaves, saved = summed(up[whole], child_leaves[whole], n), summed(up[whole], child_saved[whole], n)
        leaves[~edge & (kids == 0)] = 1
        saved[~edge] += ((counts - 1) * token)[~edge]
        ending = over(np.add, (sizes == d).astype(np.int64), start, end)
        ends = [",".join(names[s : s + e].tolist()) if e else "" for s, e in zip(start.tolist(), ending.tolist())]
        ends = [t if p else digest(t) if t else EMPTY for t, p in zip(ends, edge.tolist())]
        side = np.where(first, FIRST, np.where(last, LAST, INSIDE))
        up_conv, up_side = np.zeros(n, np.int64), np.zeros(n, np.int64)
        no_parent = np.ones(n, bool)
        if d:
            up = parents(levels, d)
            parent_start, parent_end = (x[up] for x in levels[d - 1])
            up_side = np.where(parent_start == 0, FIRST, np.where(parent_end == n_rows, LAST, INSIDE))
            up_conv = over(np.minimum, conv, *levels[d - 1])[up]
            no_parent = up_side != INSIDE
        below = (parents(levels, d), ~edge, leaves, saved) if d else None
        at = begin[start] + d - 1
        columns = [np.full(n, shard), side, np.full(n, d), lowest, up_conv, up_side, counts, token, kids, leaves, saved, hi[at] if d else np.zeros(n), lo[at] if d else np.zeros(n)]
        both = np.flatnonzero(first & last)
        if len(both):
            # the path of the last conversation is whole too; its part shared with the first one counts nothing
            again = [c[both].copy() for c in columns]
            again[1][:] = LAST
            again[3][:] = np.iinfo(np.int64).max
            for k in (6, 8, 9, 10):
                again[k][:] = 0
            columns = [np.concatenate([c, a]) for c, a in zip(columns, again)]
            no_parent = np.append(no_parent, no_parent[both])
            ends.append("")
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 7]
        arrays = [pa.array(c.astype(k.to_pandas_dtype()), k, mask=no_parent if i == 4 else None) for i, (c, k) in enumerate(zip(columns, kinds))]
        batch = pa.RecordBatch.from_arrays([*arrays, pa.array(ends, pa.string())], names=[c.split()[0] for c in CELLS.split(", ")])
        for at in range(0, batch.num_rows, 50_000):
            yield batch.slice(at, 50_000)


def recombine(cells: pa.Table, panel: int) -> Iterator[pa.RecordBatch]:
    """The partial nodes of all shards as whole ones; every cell learns the conversation of its node, the first one all of it."""
    shard, side, depth, conv, n_convs, words, kids, leaves, saved, hi, lo = (cells.column(c).to_numpy() for c in ("shard", "side", "depth", "conv_id", "n_convs", "words", "n_children", "n_leaves", "saved_tokens", "hi", "lo"))
    by = np.lexsort((depth, side, shard))
    shard, side, depth, conv, n_convs, words, kids, leaves, saved, hi, lo = (x[by] for x in (shard, side, depth, conv, n_convs, words, kids, leaves, saved, hi, lo))
    root = np.flatnonzero(depth == 0)
    ids = np.delete(dense(np.where(depth == 0, 0, hi), np.where(depth == 0, 0, lo)), root)
    offsets = np.append(root, len(depth)) - np.arange(len(root) + 1)
    order, levels = lay_out(ids, offsets, np.arange(len(root)), panel)
    sizes, cell = np.diff(offsets)[order], root[order]
    whole: list[dict[str, np.ndarray]] = []
    for d, (start, end) in enumerate(levels):
        rows = np.flatnonzero(sizes >= d)
        s, e = np.searchsorted(rows, start), np.searchsorted(rows, end - 1) + 1
        at = cell[rows] + d
        add = lambda v: over(np.add, v[at], s, e)
        whole.append({"at": at, "s": s, "e": e, "conv": over(np.minimum, conv[at], s, e), "n": add(n_convs), "kids": add(kids), "leaves": add(leaves), "saved": add(saved), "words": words[at[s]]})
    for d in range(len(levels) - 1, -1, -1):
        node = whole[d]
        node["leaves"] = np.where(node["kids"] == 0, 1, node["leaves"])
        node["saved"] = node["saved"] + (node["n"] - 1) * node["words"]
        if d:
            up, above = parents(levels, d), whole[d - 1]
            node["up"] = above["conv"][up]
            for name, values in (("kids", np.ones(len(up), np.int64)), ("leaves", node["leaves"]), ("saved", node["saved"])):
                above[name] = above[name] + summed(up, values, len(above["n"]))
    for d, node in enumerate(whole):
        size = node["e"] - node["s"]
        spread = np.repeat(np.arange(len(size)), size)
        at = node["at"][np.arange(len(spread)) + np.repeat(node["s"] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
        head = np.concatenate([[True], spread[1:] != spread[:-1]])
        up = node["up"][spread] if d else np.zeros(len(spread), np.int64)
        long = lambda v: pa.array(v[spread].astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[at]), pa.array(side[at]), pa.array(depth[at]), long(node["conv"]), pa.array(head), pa.array(up, mask=np.full(len(up), d == 0)), long(node["n"]), long(node["kids"]), long(node["leaves"]), long(node["saved"])],
            names=[c.split()[0] for c in MERGED.split(", ")],
        )


def running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined parts of every (depth, conv_id), which come together and in order."""
    key, state = None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["depth", "conv_id", "ends_sha256"])

    for batch in batches:
        for depth, conv, part in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "ends"))):
            if key == (depth, conv):
                state.update(b",")
            else:
                if key is not None:
                    yield done()
                key, state = (depth, conv), hashlib.sha256()
            state.update(part.encode())
    if key is not None:
        yield done()


def prefix_trie(sequences: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """The nodes of the trie over (conv_id, turns); turns as ``turn_sequences`` gives them, one row for each conversation.

    conv_id is the smallest member, so (conv_id, depth) names a node and its turns; parent_conv_id is that of the parent, null for the
    root. saved_tokens are the words a cache of prefixes does not read again, summed over the subtree; ends_sha256 is the digest of the
    members that have no further turn.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    panel = settings.panel
    rows = sequences.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["hi"], t["lo"]))).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = scratch.store(rows, "rows")
    turns = rows.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // settings.shard_turns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [], schema=pa.schema([("conv_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))]))
        if not held.num_rows:
            return
        held = held.combine_chunks()
        words = held.column("words").chunk(0)
        ids = held.column("ids").chunk(0).flatten().to_numpy()
        offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        yield from shard_cells(held.column("conv_id").to_numpy(), offsets, ids[::2], ids[1::2], words.flatten().to_numpy().astype(np.int64), TaskContext.get().partitionId(), panel)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from recombine(pa.Table.from_batches(held), panel)

    ranged = rows.repartitionByRange(shards, "ids", "conv_id").select("conv_id", "ids", "words")
    cells = scratch.store(ranged.mapInArrow(build, CELLS), "cells")
    edges = cells.where(F.col("side") != INSIDE)
    merged = scratch.store(edges.drop("ends", "parent_conv_id", "parent_side").repartition(1).mapInArrow(merge, MERGED), "merged")

    of = ["shard", "side", "depth"]
    parts = edges.where("ends <> ''").select(*of, "ends").join(merged.select(*of, "conv_id"), of)
    parts = parts.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "shard", "side")
    digests = parts.select("depth", "conv_id", "ends").mapInArrow(running_digests, "depth long, conv_id long, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    border = merged.where("head").select(*columns).join(digests, ["depth", "conv_id"], "left").select(*columns, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    inside = cells.where(F.col("side") == INSIDE)
    above = merged.select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("border_conv_id"))
    inside = inside.join(above, ["shard", "parent_side", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "border_conv_id"))
    return inside.select(*columns, F.col("ends").alias("ends_sha256")).union(border)
