"""Streaming forms of the keyed dedupe and of the raw to curated load."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrascore.operators import curated
from terrascore.operators.contracts import FieldMapping
from terrascore.plans import curation
from terrascore.session import materialize, shared_folder
from terrascore.sources.landing import FileRule
from terrascore.sources.tables import LAYOUTS


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream over the Parquet files of one table."""
    reader = spark.readStream.schema(LAYOUTS[name]).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_dedupe(stream: DataFrame, mapping: FieldMapping, loaded: str = "ts") -> DataFrame:
    """Drop repeats of the contract's dedupe keys that arrive within its late-arrival days.

    State is held per key and expires with the watermark, so it is bounded by
    the keys of that many days.
    """
    timed = stream.withColumn(loaded, F.col(loaded).cast("timestamp"))
    return timed.withWatermark(loaded, f"{mapping.late_arrivals_days} days").dropDuplicatesWithinWatermark(list(mapping.dedupe_keys))


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process what is available into a Parquet table and read it back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/terrascore/{label}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def upsert_partitions(path: str, batch: DataFrame, partition: str = "report_period") -> None:
    """Merge a batch into the table at ``path``, rewriting only the partitions it touches.

    The partition column is part of the key. The merged rows are written aside before they replace anything, and replaying a batch
    changes nothing. The partitions a batch touches are few and go into the scan as values, so only they are read.
    """
    spark = batch.sparkSession
    fresh = materialize(batch, "batch")
    touched = [r[0] for r in fresh.select(partition).distinct().collect()]
    layout = StructType([f for f in fresh.schema if f.name != "record_no"])
    stored = None
    try:
        stored = spark.read.schema(layout).parquet(path)
    except AnalysisException as problem:
        # only a table that is not there yet counts as empty
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    if stored is not None:
        hit = F.col(partition).isin([t for t in touched if t is not None])
        hit = hit | F.col(partition).isNull() if None in touched else hit
        stored = stored.filter(hit).select(*layout.names)
    merged = materialize(curation.upsert_curated(stored, fresh), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def start_curated_load(l0: DataFrame, rules: Sequence[FileRule], sales_path: str, revenue_path: str, progress: str) -> StreamingQuery:
    """Landing stream into the two curated tables, one upsert per micro-batch."""

    def load(rows: DataFrame, batch_id: int) -> None:
        batch = curation.curate(rows, rules)
        upsert_partitions(sales_path, batch.sales)
        upsert_partitions(revenue_path, batch.revenue)

    return l0.writeStream.foreachBatch(load).option("checkpointLocation", progress).trigger(availableNow=True).start()


def curated_schema(fields: Sequence[str]) -> str:
    """Layout of a curated table with the given number columns."""
    numbers = ", ".join(f"{f} double" for f in fields)
    return f"l0_id bigint, source_name string, country string, {numbers}, source_file string, report_period string"


SALES_SCHEMA = curated_schema(list(curated.SALES_FIELDS))
REVENUE_SCHEMA = curated_schema(list(curated.REVENUE_FIELDS))
