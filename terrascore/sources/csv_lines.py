"""CSV by lines: files and texts of any size as rows of lines, put together to records by shuffles.

A line starts a record if an even number of quotes stands before it in its file. Quotes and record starts are counted in chunks of lines;
one narrow row a chunk carries the counts on through the file, so no task holds a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrascore.operators.joins import lookup_join
from terrascore.session import materialize
from terrascore.sources.landing import FileRule, csv_cells, csv_header, csv_lines, csv_record, match_rule

#: Lines (of a text) or records that are counted together.
CHUNK_LINES = 4_096


def file_lines(spark: SparkSession, path: str | Sequence[str], rules: Sequence[FileRule]) -> DataFrame:
    """``file, chunk, at, line, rule`` of files with a rule, read in splits: a large file is shared among many tasks.

    ``chunk`` and ``at`` grow along a file: the split's place in the file, then the place of the line among those of its task.
    """
    meta = {"file_path": "_metadata.file_path", "file_name": "_metadata.file_name", "_block": "_metadata.file_block_start"}
    lines = spark.read.text(path).select(F.col("value").alias("line"), *[F.col(v).alias(k) for k, v in meta.items()], F.monotonically_increasing_id().alias("at"))
    ruled = match_rule(lines, rules).filter(F.col("rule").isNotNull())
    chunk = F.struct("_block", F.floor(F.col("at") / CHUNK_LINES).alias("part"))
    return ruled.select(F.col("file_path").alias("file"), chunk.alias("chunk"), "at", "line", "rule")


def text_lines(df: DataFrame, file: str, text: Column, rule: Column) -> DataFrame:
    """The same of texts held in a column; null texts have no lines."""
    lines = df.select(F.col(file).alias("file"), rule.alias("rule"), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("at", "line"))
    chunk = F.struct(F.lit(0).cast("bigint").alias("_block"), F.floor(F.col("at") / CHUNK_LINES).alias("part"))
    return lines.select("file", chunk.alias("chunk"), F.col("at").cast("bigint").alias("at"), "line", "rule")


def csv_rows(lines: DataFrame) -> DataFrame:
    """``file, record_no, record`` of lines as above, one file name a file; the same records as ``landing.csv_records`` gives.

    The preface is skipped, the header trimmed, short rows padded, empty cells null, cells beyond the header kept. A quote that is never
    closed makes the rest of its file one record, as it would be one cell.
    """
    whole = materialize(_joined(materialize(lines, "lines")), "csv-lines")
    rule = F.col("rule")
    whole = whole.filter((F.col("no") >= rule["skip_rows"]) & (F.trim("text") != ""))
    first = whole.groupBy("file").agg(F.min_by(F.struct("text", "rule"), "no").alias("first"), F.min("no").alias("first_no"), F.count(F.lit(1)).alias("n"))
    names = F.transform(_cells(F.col("first.text"), F.col("first.rule")), lambda c: F.trim(c))
    header = first.withColumn("_names", names).select("file", "n", "first_no", csv_header("_names", F.col("first.rule.has_header")).alias("_header"))
    data = lookup_join(whole, materialize(header, "csv-headers"), ["file"], "n").filter(~rule["has_header"] | (F.col("no") > F.col("first_no")))
    read = data.withColumn("_cells", _cells(F.col("text"), rule)).select("file", "no", csv_record(F.col("_cells")).alias("record"))
    return _numbered(materialize(read, "csv-records"))


def _cells(text: Column, rule: Column) -> Column:
    """Cells of one record; breaks inside quotes are masked, so it is one line."""
    return csv_cells(F.get(csv_lines(text, rule["sep"], rule["quotechar"]), F.lit(0)), rule["sep"], rule["quotechar"])


def _joined(lines: DataFrame) -> DataFrame:
    """``file, no, text, rule``: the lines of each record put together, numbered from 0 in their file, blank ones too."""
    quote = F.col("rule.quotechar")
    marks = F.floor((F.length("line") - F.length(F.replace("line", quote, F.lit("")))) / F.greatest(F.length(quote), F.lit(1)))
    in_chunk = Window.partitionBy("file", "chunk").orderBy("at")
    counted = lines.withColumn("_before", F.sum(marks).over(in_chunk) - marks).withColumn("_marks", marks)
    even = F.col("_before") % 2 == 0
    chunks = counted.groupBy("file", "chunk").agg(F.sum("_marks").alias("_marks"), F.count_if(even).alias("_even"), F.count_if(~even).alias("_odd"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("_marks").over(earlier), F.lit(0)) % 2 == 1
    starts = chunks.withColumn("_open", opened).withColumn("_starts", F.when(F.col("_open"), F.col("_odd")).otherwise(F.col("_even")))
    offsets = starts.select("file", "chunk", "_open", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_offset"))
    placed = counted.join(materialize(offsets, "line-chunks"), ["file", "chunk"])
    is_start = (F.when(F.col("_open"), ~even).otherwise(even)).cast("bigint")
    numbered = placed.select("file", "at", "line", "rule", "chunk", is_start.alias("_start"), "_offset")
    numbered = numbered.withColumn("no", F.col("_offset") + F.sum("_start").over(in_chunk) - 1)
    pieces = F.array_sort(F.collect_list(F.struct(F.col("chunk._block").alias("block"), "at", "line")))
    text = F.array_join(F.transform(pieces, lambda p: p["line"]), "\n")
    return numbered.groupBy("file", "no").agg(text.alias("text"), F.any_value("rule").alias("rule"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``record_no`` from 0 without gaps in the order of ``no``."""
    rows = rows.withColumn("_chunk", F.floor(F.col("no") / CHUNK_LINES))
    earlier = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("file", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("file", "_chunk").orderBy("no"))
    return rows.join(offsets, ["file", "_chunk"]).select("file", (F.col("_offset") + place - 1).cast("bigint").alias("record_no"), "record")
