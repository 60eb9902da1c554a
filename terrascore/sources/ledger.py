"""A ledger of landed files, so that a load opens only the files that can hold new rows.

The ledger is a small table, a row per file and source with the dates it spans. Files are told apart by path and modification time: a
file that was rewritten counts as new, one that is gone is never asked for. Only file names reach the driver, and only of the files to
be read, which Spark's own listing holds as well.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrascore.operators.contracts import load_starts

LEDGER = "file string, modified timestamp, path string, source_name string, first_date date, last_date date, n_rows bigint"


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, modified, path`` of every Parquet file below ``folder``; nothing but the listing is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return listed.select(*_identity(), "path")


def _identity() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The stored ledger; empty before its first entry."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def read_files(spark: SparkSession, folder: str, files: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows of the named files; columns held in folder names are kept."""
    names = [_literal(r.path) for r in files.select("path").distinct().collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*names)


def _literal(path: str) -> str:
    """A path whose wildcard characters stand for themselves."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def update_ledger(spark: SparkSession, folder: str, ledger: str, schema: StructType | str, source: str = "source_name", loaded: str = "loaded_at") -> DataFrame:
    """Enter the files that the ledger does not have yet, and return it whole.

    Only their columns ``source`` and ``loaded`` are read, once in the life of a file. An empty file is entered without a source. May be
    repeated after a failure: what was entered is not new any more, and an entry that stands twice changes nothing.
    """
    known = read_ledger(spark, ledger)
    new = landed_files(spark, folder).join(known, ["file", "modified"], "left_anti")
    day = F.to_date(loaded)
    spans = read_files(spark, folder, new, schema).select(*_identity(), F.col(source).alias("source_name"), day.alias("day")) if not new.isEmpty() else None
    if spans is not None:
        held = spans.groupBy("file", "modified", "source_name").agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))
        entries = new.join(held, ["file", "modified"], "left").select("file", "modified", "path", "source_name", "first_date", "last_date", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        entries.write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def due_files(spark: SparkSession, folder: str, ledger: DataFrame, watermarks: DataFrame) -> DataFrame:
    """``path`` of the files that can hold rows to load: of an unknown source, not before a source's watermark, or not in the ledger yet."""
    present = landed_files(spark, folder)
    entered = present.join(ledger.drop("path"), ["file", "modified"])
    marked = entered.filter("n_rows > 0").join(load_starts(watermarks), F.col("source_name") == F.col("_source"), "left")
    due = marked.filter(F.col("_source").isNull() | (F.col("last_date") >= F.col("_from")))
    late = present.join(ledger, ["file", "modified"], "left_anti")
    return due.select("path").union(late.select("path")).distinct()


def incremental_read(
    spark: SparkSession,
    folder: str,
    ledger: DataFrame,
    watermarks: DataFrame,
    schema: StructType | str,
    source: str = "source_name",
    loaded: str = "loaded_at",
) -> DataFrame:
    """The rows that ``incremental_filter`` keeps of all files below ``folder``, read from the files that can hold any.

    A source without a watermark costs its own files only, not the whole landing table. A ledger that lags behind is no harm: files it does
    not know are read.
    """
    rows = read_files(spark, folder, due_files(spark, folder, ledger, watermarks), schema)
    marked = rows.join(load_starts(watermarks), F.col(source) == F.col("_source"), "left")
    return marked.filter(F.col("_source").isNull() | (F.to_date(loaded) >= F.col("_from"))).drop("_source", "_from")
