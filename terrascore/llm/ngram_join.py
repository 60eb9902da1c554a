"""N-gram Jaccard self-join through a token-group matrix.

Every text becomes the set of its 5-word shingles (64-bit hashes). Equal sets are one *set* from there on. Sets are put into groups
that share a common shingle, each group keeps the union of its shingles, and a set is compared with a group only if

* one of the first ``n - ceil(0.8 n) + 1`` shingles of the set, rarest first, also comes first in a member of the group (the matrix
  is stored as (shingle, group) rows, so this is an equi-join), and
* the overlap of the set with the union of the group reaches ``ceil(0.8 n)``; the similarity with any member is bounded by it.

Groups that qualify are opened: exact intersections are matrix products, and only counts and a spanning forest of the links leave
the task. Both bounds are lossless, so every link is found. Groups are split until they hold a bounded number of sets and shingles;
no task holds an unbounded group and no pair of documents is ever a row.

Shingles travel as binary blocks, one per (input task, shuffle bucket), so that a shuffle row holds thousands of shingles.

Defined results: null or empty text (or one without words): n_shingles 0, linked with nothing, its own component. Fewer than five
words: the whole sequence is one shingle. Repeated rows: each comes back, all in one component. Null id: never chosen as
component_id unless the whole component has none. Other columns are ignored, whatever their names. Two different sets or shingles
are taken as equal when their 64-bit hashes are: the odds are n^2 / 2^65 for n different ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch, WordHasher, mix, passes, utf8

#: Shingles per shuffle bucket, sets per group and shingles per group that sizes are planned for.
BUCKET_SHINGLES = 1_000_000
GROUP_SETS = 256
GROUP_SHINGLES = 400_000
#: Shingles an input task holds before it sends its blocks on.
HELD_SHINGLES = 1_000_000
#: Columns of a membership matrix multiplied at once.
MATRIX_COLUMNS = 4_096


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``share`` percent over shingles of ``width`` words."""

    width: int = 5
    share: int = 80

    def least(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of n must share with any set it links with."""
        return -(-self.share * n // 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shingle_sets(column: pa.Array, width: int, hasher: WordHasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles of the rows one after the other, their count per row) for runs of rows."""
    data, offsets = utf8(column)
    spread = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    for a, b in passes(offsets):
        words, bounds = hasher.batch(data, offsets[a : b + 1])
        with np.errstate(over="ignore"):
            windows = np.zeros(max(len(words) - width + 1, 0), np.uint64)
            for k in range(width):
                windows += words[k : k + len(windows)] * spread[k]
            windows = mix(windows)
            found = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s >= width:
                    found.append(np.unique(windows[s : e - width + 1]))
                elif e > s:
                    # a short text never equals a window: its length goes into the hash
                    found.append(mix(np.array([np.sum(words[s:e] * spread[: e - s], dtype=np.uint64) ^ np.uint64(e - s)], np.uint64)))
                else:
                    found.append(np.zeros(0, np.uint64))
        yield a, np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(x) for x in found], np.int64)


def set_keys(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One order-free 64-bit key per set; 0 for empty sets."""
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        keys = mix(run[ends] - run[ends - sizes] + sizes.astype(np.uint64))
    return np.where(sizes > 0, keys, np.uint64(0))


def sets_of(docs: DataFrame, similarity: Similarity, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key) of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            n, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, shingles, sizes in shingle_sets(batch.column("text"), similarity.width, hasher):
                n.append(sizes)
                key.append(set_keys(shingles, sizes))
            arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(n)), pa.array(_signed(np.concatenate(key)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_shingles", "set_key"])

    return source.mapInArrow(keys, f"doc_id {kind}, text_key long, n_shingles long, set_key long")


def _blocks(bucket: np.ndarray, owner: np.ndarray, sizes: np.ndarray, items: dict[str, np.ndarray]) -> list[dict]:
    """One row per bucket: its owners in order, their sizes, how many items each has there, and the items.

    The entries come in order of bucket and, within it, of owner. Counts take the narrowest type that holds them.
    """
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(bucket)).tolist()):
        first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        counts = np.diff(first, append=b - a)
        kind = np.uint8 if counts.max() < 1 << 8 else np.uint16 if counts.max() < 1 << 16 else np.uint32
        row = {"bucket": int(bucket[a]), "owners": owner[a:b][first].tobytes(), "owner_sizes": sizes[a:b][first].astype(np.uint32).tobytes(), "counts": counts.astype(kind).tobytes()}
        rows.append(row | {k: v[a:b].tobytes() for k, v in items.items()})
    return rows


def _counts(table: pa.Table) -> np.ndarray:
    """The counts of all rows, whose width follows from the number of owners."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    parts = [np.frombuffer(c, kinds[8 * len(c) // len(o)]).astype(np.int64) for c, o in zip(table.column("counts").to_pylist(), table.column("owners").to_pylist())]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _bucket(x: np.ndarray, count: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def postings(docs: DataFrame, similarity: Similarity, text_col: str, buckets: int) -> DataFrame:
    """The shingles of every set as blocks by shingle; a task sends an equal set once, however many copies it reads."""
    width = similarity.width
    schema = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("owner_sizes", pa.binary()), ("counts", pa.binary()), ("shingles", pa.binary())])

    def send(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, sizes, shingles = (np.concatenate(x) for x in zip(*held))
        owner = np.repeat(np.arange(len(keys)), sizes)
        bucket = _bucket(shingles, buckets)
        order = np.argsort(bucket, kind="stable")
        owner = owner[order]
        rows = _blocks(bucket[order], keys[owner], sizes[owner], {"shingles": shingles[order]})
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, size = WordHasher(), set(), [], 0
        for batch in batches:
            for _, shingles, sizes in shingle_sets(batch.column(0), width, hasher):
                keys = set_keys(shingles, sizes)
                new = np.zeros(len(keys), bool)
                for i, (k, n) in enumerate(zip(keys.tolist(), sizes.tolist())):
                    if n and k not in seen:
                        seen.add(k)
                        new[i] = True
                if new.any():
                    held.append((keys[new], sizes[new], shingles[np.repeat(new, sizes)]))
                    size += int(sizes[new].sum())
                if size >= HELD_SHINGLES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(blocks, "bucket int, owners binary, owner_sizes binary, counts binary, shingles binary")


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def shared_shingles(blocks: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket the shingles that two or more sets have, as blocks by set, each with the logarithm of the number of these sets."""
    schema = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("owner_sizes", pa.binary()), ("counts", pa.binary()), ("shingles", pa.binary()), ("frequency", pa.binary())])

    def reduce(table: pa.Table) -> pa.Table:
        counts = _counts(table)
        shingles = _joined(table, "shingles", np.uint64)
        owners = np.repeat(_joined(table, "owners", np.uint64), counts)
        sizes = np.repeat(_joined(table, "owner_sizes", np.uint32), counts)
        order = np.argsort(shingles)
        again = np.diff(shingles[order]) == 0
        order = order[np.concatenate([again, [False]]) | np.concatenate([[False], again])]
        order = order[np.lexsort((owners[order], shingles[order]))]
        shingles, owners, sizes = shingles[order], owners[order], sizes[order]
        # two tasks may have sent the same set
        new = np.ones(len(order), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
        shingles, owners, sizes = shingles[new], owners[new], sizes[new]
        first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.zeros(0, np.int64)
        repeats = np.diff(first, append=len(shingles))
        frequency = np.repeat(repeats, repeats)
        keep = np.flatnonzero(frequency > 1)
        keep = keep[np.argsort(owners[keep], kind="stable")]  # buckets of sets are ranges of their keys
        items = {"shingles": shingles[keep], "frequency": (8 * np.log2(frequency[keep])).astype(np.uint8)}
        return pa.Table.from_pylist(_blocks(_bucket(owners[keep], buckets), owners[keep], sizes[keep], items), schema=schema)

    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, "bucket int, owners binary, owner_sizes binary, counts binary, shingles binary, frequency binary")


def candidates(blocks: DataFrame, similarity: Similarity, buckets: int) -> DataFrame:
    """Sets with enough shared shingles to link with any other: (set_key, n, shingles, n_leading, anchor).

    ``shingles`` are the shared ones, rarest first; the first ``n_leading`` are among the first of the set. The anchor is the smallest hash
    of them, which similar sets have in common with the probability of their similarity, and sets with a mere passage in common seldom.
    """
    schema = pa.schema([("set_key", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64())), ("n_leading", pa.int32()), ("anchor", pa.int64())])

    def reduce(table: pa.Table) -> pa.Table:
        counts = _counts(table)
        owners, sizes = np.repeat(_joined(table, "owners", np.uint64), counts), np.repeat(_joined(table, "owner_sizes", np.uint32), counts)
        shingles, frequency = _joined(table, "shingles", np.uint64), _joined(table, "frequency", np.uint8)
        order = np.lexsort((shingles, frequency, owners))
        owners, sizes, shingles = owners[order], sizes[order].astype(np.int64), shingles[order]
        first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else np.zeros(0, np.int64)
        count = np.diff(first, append=len(owners))
        n = sizes[first]
        least = similarity.least(n)
        rows = []
        for i in np.flatnonzero(count >= least).tolist():
            own = _signed(shingles[first[i] : first[i] + count[i]])
            # the unshared ones come first of all and fill the rest of the prefix
            rows.append({"set_key": int(owners[first[i]].view(np.int64)), "n": int(n[i]), "shingles": own, "n_leading": int(count[i] - least[i] + 1), "anchor": int(own.min())})
        return pa.Table.from_pylist(rows, schema=schema)

    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, "set_key long, n long, shingles array<long>, n_leading int, anchor long")


def large_anchors(sets: DataFrame) -> DataFrame:
    """(anchor, parts) of the anchors with too many sets or shingles for one group: at most one in GROUP_SETS sets."""
    parts = F.ceil(F.greatest(F.count("*") / GROUP_SETS, F.sum(F.size("shingles")) / GROUP_SHINGLES)).alias("parts")
    return sets.groupBy("anchor").agg(parts).where("parts > 1")


def grouped(sets: DataFrame, large: DataFrame) -> DataFrame:
    """Add the group of each set: its anchor, and a part number for large anchors."""
    part = F.pmod(F.xxhash64("set_key"), F.coalesce("parts", F.lit(1)))
    return sets.join(large, "anchor", "left").withColumn("grp", F.xxhash64("anchor", part)).drop("parts")


def group_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of groups (ga <= gb) in which a member of each leads with the same shingle, from the token-group matrix."""
    matrix = sets.select(F.explode(F.slice("shingles", F.lit(1), F.col("n_leading"))).alias("shingle"), "grp").distinct()
    other = matrix.select("shingle", F.col("grp").alias("gb"))
    crossed = matrix.join(other, "shingle").where("grp < gb").select(F.col("grp").alias("ga"), "gb").distinct()
    own = sets.groupBy("grp").count().where("count > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    return crossed.union(own)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of membership matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for side in (left, right):
        sizes = np.array([len(x) for x in side])
        flat = np.concatenate(side)
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        row, col = np.repeat(np.arange(len(side)), sizes)[hit], at[hit]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    for c in range(0, len(both), MATRIX_COLUMNS):
        width = min(MATRIX_COLUMNS, len(both) - c)
        parts = []
        for (row, col), m in zip(sides, (len(left), len(right))):
            a, b = np.searchsorted(col, [c, c + width])
            part = np.zeros((m, width), np.float32)
            part[row[a:b], col[a:b] - c] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def links_in(table: pa.Table, similarity: Similarity) -> pa.Table:
    """Exact links between the two groups of a pair: per linked set the root of its tree and the number of linked documents."""
    schema = pa.schema([("set_key", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    side = table.column("side").to_numpy()
    key, n, copies = (table.column(c).to_numpy() for c in ("set_key", "n", "copies"))
    sets = [x.values.to_numpy() for x in table.column("shingles")]
    same = bool((side == 0).all())
    rows = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))]
    if not same:
        for one, two in ((0, 1), (1, 0)):
            if len(rows[one]) and len(rows[two]):
                union = np.unique(np.concatenate([sets[i] for i in rows[two].tolist()]))
                bound = np.array([np.isin(sets[i], union, assume_unique=True).sum() for i in rows[one].tolist()])
                rows[one] = rows[one][bound >= similarity.least(n[rows[one]])]
    a, b = rows
    if not len(a) or not len(b):
        return schema.empty_table()
    common = _overlaps([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()]).astype(np.int64)
    linked = 100 * common >= similarity.share * (n[a][:, None] + n[b][None, :] - common)
    if same:
        np.fill_diagonal(linked, False)
    # labels of the bipartite graph, spread until they rest
    la, lb = key[a].copy(), key[b].copy()
    big = np.iinfo(np.int64).max
    while linked.any():
        na = np.minimum(la, np.where(linked, lb[None, :], big).min(axis=1))
        nb = na if same else np.minimum(lb, np.where(linked, na[:, None], big).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    out = [(a, la, (linked * copies[b][None, :]).sum(axis=1), linked.any(axis=1))]
    if not same:
        out.append((b, lb, (linked * copies[a][:, None]).sum(axis=0), linked.any(axis=0)))
    arrays = [np.concatenate([key[r][m] for r, _, _, m in out]), np.concatenate([x[m] for _, x, _, m in out]), np.concatenate([x[m] for _, _, x, m in out])]
    return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], schema=schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for every vertex of the edges (u, v): alternating large and small stars until nothing changes."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, step = None, 0
    while True:
        edges = scratch.store(edges, f"stars{step}")
        if step:
            scratch.drop(f"stars{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before, step = now, step + 1
        # large star: the larger neighbours of a vertex move to its smallest one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def ngram_join(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_key (xxhash64 of the text), n_shingles, set_key, component_id, n_links."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = scratch.store(sets_of(docs, similarity, id_col, text_col), "rows")
    known = rows.where("n_shingles > 0").groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    known = scratch.store(known, "known")
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_SHINGLES))

    shared = shared_shingles(postings(docs, similarity, text_col, buckets), buckets)
    sets = scratch.store(candidates(shared, similarity, buckets), "sets")
    groups = grouped(sets, scratch.store(large_anchors(sets), "anchors"))
    pairs = scratch.store(group_pairs(groups), "pairs")
    # who meets in which pair is settled with keys alone; the shingles then move once to each meeting
    members = groups.select("grp", "set_key")
    left = pairs.join(members, pairs.ga == members.grp).select("ga", "gb", F.lit(0).alias("side"), "set_key")
    right = pairs.where("ga <> gb").join(members, pairs.gb == members.grp).select("ga", "gb", F.lit(1).alias("side"), "set_key")
    meetings = left.union(right).join(known.select("set_key", "copies"), "set_key").join(sets.select("set_key", "n", "shingles"), "set_key")
    opened = meetings.groupBy("ga", "gb").applyInArrow(lambda table: links_in(table, similarity), "set_key long, root long, links long")
    links = scratch.store(opened, "links")
    for name in ("sets", "anchors", "pairs"):
        scratch.drop(name)

    roots = components(links.select(F.col("set_key").alias("u"), F.col("root").alias("v")), scratch)
    linked = links.groupBy("set_key").agg(F.sum("links").alias("links"))
    placed = known.join(roots.withColumnRenamed("v", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    placed = scratch.store(placed.join(linked, "set_key", "left"), "placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "root").select("set_key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_key"))
    out = rows.join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", "set_key", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_key")
