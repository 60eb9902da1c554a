"""The ledger of landed files: which files a load opens, rewritten and late files, folders as columns."""

import datetime
from urllib.parse import unquote

from pyspark.sql import functions as F

from terrascore.operators import contracts
from terrascore.sources import ledger

ROWS = "source_name string, loaded_at timestamp, x int"


def land(spark, folder, name, rows):
    stamped = [(s, datetime.datetime.fromisoformat(day), x) for s, day, x in rows]
    spark.createDataFrame(stamped, ROWS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def marks(spark, *rows):
    return spark.createDataFrame([(s, datetime.date.fromisoformat(d)) for s, d in rows], "source_name string, watermark_date date").withColumn("grace_days", F.lit(2).cast("smallint"))


def opened(df):
    return sorted({unquote(f).rsplit("/", 2)[1] for f in df.inputFiles()})


def test_only_due_files_are_opened(spark, tmp_path):
    folder, book = str(tmp_path / "landed files"), str(tmp_path / "ledger")
    land(spark, folder, "old-a", [("a", "2024-01-01", 1), ("a", "2024-01-02", 2)])
    land(spark, folder, "edge-a", [("a", "2024-01-07", 3), ("a", "2024-01-08", 4)])
    land(spark, folder, "new-a{1}", [("a", "2024-01-10", 5)])
    land(spark, folder, "new-source", [("b", "2020-01-01", 6)])
    land(spark, folder, "no-source", [(None, "2020-01-01", 7)])
    land(spark, folder, "empty", [])
    known = marks(spark, ("a", "2024-01-10"))
    entries = ledger.update_ledger(spark, folder, book, ROWS)
    assert {(r.source_name, str(r.first_date), r.n_rows) for r in entries.filter("n_rows > 1").collect()} == {("a", "2024-01-01", 2), ("a", "2024-01-07", 2)}
    read = ledger.incremental_read(spark, folder, entries, known, ROWS)
    assert opened(read) == ["edge-a", "new-a{1}", "new-source", "no-source"]
    rows = sorted(r.x for r in read.collect())
    every = spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(folder)
    assert rows == sorted(r.x for r in contracts.incremental_filter(every, known).collect()) == [4, 5, 6, 7]

    # nothing new: the ledger stays; a late file is read before it is entered, a rewritten one counts as new
    assert ledger.update_ledger(spark, folder, book, ROWS).count() == entries.count()
    land(spark, folder, "late", [("a", "2024-01-11", 8)])
    land(spark, folder, "old-a", [("a", "2024-01-09", 9)])
    again = ledger.incremental_read(spark, folder, entries, known, ROWS)
    assert sorted(r.x for r in again.collect()) == [4, 5, 6, 7, 8, 9]
    after = ledger.update_ledger(spark, folder, book, ROWS)
    assert after.count() == entries.count() + 2
    assert sorted(r.x for r in ledger.incremental_read(spark, folder, after, known, ROWS).collect()) == [4, 5, 6, 7, 8, 9]


def test_folder_columns_and_nothing_due(spark, tmp_path):
    folder, book = str(tmp_path / "by-source"), str(tmp_path / "ledger")
    df = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1), 1), ("b", datetime.datetime(2024, 1, 5), 2)], ROWS)
    df.write.partitionBy("source_name").parquet(folder)
    entries = ledger.update_ledger(spark, folder, book, ROWS)
    read = ledger.incremental_read(spark, folder, entries, marks(spark, ("a", "2024-02-01"), ("b", "2024-01-05")), ROWS)
    assert [(r.source_name, r.x) for r in read.collect()] == [("b", 2)] and len(read.inputFiles()) == 1
    assert ledger.incremental_read(spark, folder, entries, marks(spark, ("a", "2025-01-01"), ("b", "2025-01-01")), ROWS).count() == 0
