"""Exact duplicates by a content sort: equal texts become neighbours, and neighbours are compared in full.

The order is that of the first characters of the normalised text, then of its SHA-256, then of a salt from the id. Spark samples
splitters of this order, range-partitions the texts by them and sorts each range externally, so that a third of all rows with one text is
spread over as many ranges as it needs; keys stay short, so neither the sample in the driver nor the splitters grow with the texts. In
every range a row starts a new run unless its text equals the whole text before it. From there on rows are narrow: each range counts its
runs and finds the row that stays, the parts of a group (at most ``salts``) meet, and every part gets the result of its group back, so no
key of a join holds more than a part.

The row with the most code points in the original text stays, of those the one with the smallest id; a null id comes last. Texts are equal
when identical after deleting space, \\t, \\n, \\v, \\f and \\r. SHA-256 stands for equality between the parts of a group.

Defined results: null text: empty; all empty texts are one group. Of rows equal in id and text one is kept. Other columns are ignored.
Empty tables: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch


@dataclass(frozen=True)
class ContentSortSettings:
    prefix: int = 16  # characters of the text that lead the order
    salts: int = 1024  # parts of a group, at most


def without_spaces(text: Column) -> Column:
    """The text without space and the characters 9 to 13."""
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        text = F.replace(text, F.lit(chr(code)), F.lit(""))
    return text


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: ContentSortSettings = ContentSortSettings()) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs."""
    scratch = Scratch(docs.sparkSession, "content-sort")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("size"), without_spaces(text).alias("body"))
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(settings.salts)).cast("int")
    rows = rows.select("*", F.substring("body", 1, settings.prefix).alias("head"), F.sha2("body", 256).alias("text_sha256"), salt.alias("salt"))
    order = ["head", "text_sha256", "salt"]
    # the range partitioning serves the window: one exchange of the texts, one external sort
    neighbours = Window.partitionBy(*order).orderBy("body", F.desc("size"), F.asc_nulls_last("doc_id"))
    starts = ~F.col("body").eqNullSafe(F.lag("body").over(neighbours))
    runs = rows.repartitionByRange(*order).select("doc_id", "size", "text_sha256", "salt", starts.alias("starts"), (F.row_number().over(neighbours) == 1).alias("leads"))
    runs = scratch.store(runs, "runs")

    best = F.min(F.struct((-F.col("size")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    parts = runs.groupBy("text_sha256", "salt").agg(F.count("*").alias("n"), F.count_if("starts").alias("texts"), best)
    groups = parts.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.max("texts").alias("texts"), F.min("best").alias("best"), F.collect_list("salt").alias("salts"))
    # neighbours with one digest and two texts have never been seen; they must not become one group in silence
    checked = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error("different texts with one SHA-256"))
    parts = groups.select(F.col("text_sha256").alias("of_text"), checked.cast("long").alias("group_size"), "best", F.explode("salts").alias("of_salt"))
    joined = runs.join(parts, (F.col("text_sha256") == F.col("of_text")) & (F.col("salt") == F.col("of_salt")))
    # rows equal in id and text share a part, so one of them leads it
    kept = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("size") == -F.col("best.shortness"))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
