"""Extendible hashing of rows into shards of bounded bytes.

Rows hash to 60 bits. A directory is indexed by the leading bits of the hash; a bucket is a prefix, and only a bucket above the byte
limit splits on its next bit. The bytes of the buckets of all depths come from one aggregation of fine prefixes (cells), level by level:
a bucket that fits and whose parent does not is a shard, and a cell leads to the shard above it. Cells that are too large by themselves
are taken up again with further bits, over nothing but the rows below them. Rows that agree in all bits cannot be split by bits; they
overflow into pages of as many rows as fit. So every shard fits, except a page of one row that is larger than the limit by itself.

Everything is grouped and joined by prefix; the directory is a table and never reaches the driver.

Defined results: a null text has 0 bytes. Repeated rows (equal id and text) have equal hashes and share a shard or overflow pages; of rows
with equal id and text that differ elsewhere in an overflow page, one stands for all. An empty table has no shard. The columns of the
input travel inside one struct, so no name clashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch

HASH_BITS = 60
#: Bits below the expected depth at which cells are first counted, and bits taken up at a time after that.
SPARE_BITS, MORE_BITS = 4, 12


def row_hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the MD5 of id and text."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def cell_of(bits: int) -> Column:
    return F.shiftright("hash", HASH_BITS - bits)


def split_round(keys: DataFrame, limit: int, low: int, high: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cell, depth, bucket, shard_bytes, shard_rows) of the cells of ``high`` bits below a shard, and the cells that are too large.

    At depth ``low`` all buckets of the keys are known to be too large, unless low is 0.
    """
    cells = scratch.store(keys.groupBy(cell_of(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), f"cells{high}")
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = scratch.store(above.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")), f"buckets{high}")
    fits = buckets.where(F.col("shard_bytes") <= limit).withColumn("parent", F.shiftright("bucket", 1))
    full = buckets.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
    shards = fits.join(full, ["depth", "parent"], "left_semi").drop("parent")
    if low == 0:
        shards = shards.union(fits.where("depth = 0").drop("parent").select(shards.columns))
    lead = above.select("cell", "depth", "bucket").join(shards, ["depth", "bucket"]).select("cell", "depth", "bucket", "shard_bytes", "shard_rows")
    return lead, buckets.where((F.col("depth") == high) & (F.col("shard_bytes") > limit)).select(F.col("bucket").alias("cell"))


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per row: ``row`` (a struct of the columns to keep, all by default), bytes, shard (its prefix and page), depth, shard_bytes."""
    scratch = Scratch(docs.sparkSession, "sharding")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("row"), row_hash(id_col, text_col).alias("hash"), size.alias("bytes"))
    keys = scratch.store(rows.select("hash", "bytes"), "keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, math.ceil(math.log2(max(total, 1) / limit + 1)) + SPARE_BITS)
    prefix = F.when(F.col("depth") > 0, F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0"))).otherwise("")
    out, left = None, rows
    while True:
        lead, over = split_round(keys, limit, low, high, scratch)
        lead, over = scratch.store(lead, f"lead{high}"), scratch.store(over, f"over{high}")
        placed = left.withColumn("cell", cell_of(high)).join(lead, "cell")
        placed = placed.select("row", "bytes", F.concat(prefix, F.lit(".0")).alias("shard"), "depth", "shard_bytes")
        out = placed if out is None else out.union(placed)
        if over.isEmpty():
            return out
        left = left.withColumn("cell", cell_of(high)).join(over, "cell", "left_semi").drop("cell")
        if high == HASH_BITS:
            return out.union(pages(left, limit, scratch))
        keys = scratch.store(keys.withColumn("cell", cell_of(high)).join(over, "cell", "left_semi").drop("cell"), f"keys{high}")
        low, high = high, min(HASH_BITS, high + MORE_BITS)


def pages(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Pages of rows that agree in all bits, every row as it is.

    Rows are numbered inside each part of the stored input, and the parts of a hash by their running counts, so that a hash of any size
    is laid out by as many tasks as it has parts.
    """
    held = scratch.store(rows.select("row", "hash", "bytes", F.spark_partition_id().alias("part")), "overflow")
    parts = held.groupBy("hash", "part").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    by_part = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
    parts = parts.select("hash", "part", per_page.alias("per_page"), F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("hash")).alias("n"))
    place = F.row_number().over(Window.partitionBy("hash", "part").orderBy("bytes")) - 1
    laid = held.withColumn("place", place).join(scratch.store(parts, "parts"), ["hash", "part"])
    laid = laid.withColumn("page", F.floor((F.col("before") + F.col("place")) / F.col("per_page")))
    here = F.least(F.col("per_page"), F.col("n") - F.col("page") * F.col("per_page"))
    name = F.concat(F.lpad(F.bin("hash"), HASH_BITS, "0"), F.lit("."), F.col("page").cast("string"))
    return laid.select("row", "bytes", name.alias("shard"), F.lit(HASH_BITS).alias("depth"), (F.col("bytes") * here).alias("shard_bytes"))
