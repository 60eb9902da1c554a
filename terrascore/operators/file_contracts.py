"""Contracts against what is stored: the schema of every Parquet file, read from its footer, as rows.

Footers are read by the tasks, a file at a time; everything after that is joins and aggregates over one narrow row per file and column,
so a table may have any number of files. No rows of the tables are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.operators.contracts import FAMILY_OF, SPARK_TYPES, Contract

ISSUES = "table_name string, file string, severity string, category string, column_name string, expected string, actual string"
FOOTER = "table_name string, file string, column_name string, actual string"
DECLARED = "table_name string, column_name string, required boolean, expected string"


def read_footers(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """``table_name, file, column_name, actual`` for every Parquet file at the path of a table; types by their contract names.

    A file without columns has one row with a null column; a path without files has no rows.
    """
    listed = None
    for name, path in folders.items():
        # the content column is not asked for, so only the listing is read
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.lit(name).alias("table_name"), F.col("path").alias("file"))
        listed = files if listed is None else listed.union(files)
    if listed is None:
        return spark.createDataFrame([], FOOTER)

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        plain = {
            pa.int64(): "bigint", pa.int32(): "int", pa.int16(): "smallint", pa.string(): "string", pa.large_string(): "string",
            pa.float64(): "double", pa.float32(): "float", pa.bool_(): "boolean", pa.binary(): "binary", pa.date32(): "date",
        }

        def spark_type(kind: pa.DataType) -> str:
            if pa.types.is_timestamp(kind):
                return "timestamp" if kind.tz else "timestamp_ntz"
            if pa.types.is_decimal(kind):
                return f"decimal({kind.precision},{kind.scale})"
            return plain.get(kind, str(kind))

        for batch in batches:
            rows = []
            for table, file in zip(batch["table_name"], batch["file"]):
                store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", file)))
                with store.open_input_file(path) as source:
                    schema = pq.read_schema(source)
                rows += [(table, file, f.name, spark_type(f.type)) for f in schema] or [(table, file, None, None)]
            yield pd.DataFrame(rows, columns=["table_name", "file", "column_name", "actual"])

    # the function names nothing of this package, so the workers need only pyarrow
    stored = listed.mapInPandas(footers, FOOTER)
    named = F.create_map(*[F.lit(x) for pair in SPARK_TYPES.items() for x in pair])
    decimal = F.when(F.col("actual").startswith("decimal"), F.replace("actual", F.lit("decimal"), F.lit("numeric")))
    return stored.withColumn("actual", F.coalesce(decimal, F.try_element_at(named, "actual"), "actual"))


def declared_columns(spark: SparkSession, contracts: Mapping[str, Contract]) -> DataFrame:
    """``table_name, column_name, required, expected`` of the declared columns; bounded by the contracts."""
    rows = []
    for table, c in contracts.items():
        names = [*c.required, *[o for o in c.optional if o not in c.required]]
        rows += [(table, n, n in c.required, c.types.get(n)) for n in names]
        rows += [(table, n, None, t) for n, t in c.types.items() if n not in names]
    return spark.createDataFrame(rows, DECLARED)


def family(name: Column) -> Column:
    """What a type name is compared by, as ``contracts.type_family``."""
    lower = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for pair in FAMILY_OF.items() for x in pair])
    return F.when(lower.contains("numeric") | lower.contains("decimal"), "numeric").otherwise(F.coalesce(F.try_element_at(known, lower), lower))


def schema_issues(footers: DataFrame, contracts: Mapping[str, Contract], tables: Sequence[str] = ()) -> DataFrame:
    """Issue rows of every file against the contract of its table, and of the files of a table against each other.

    Missing required column: error; missing optional column: info; extra column: warning; other type than declared: error; a table of a
    contract (or of ``tables``) without a file: critical; a table without a contract: warning. ``drift``, a warning: a column that most
    files of the table hold is absent here, or has another type than in most files (ties: the first type by name). ``footers`` is read
    several times, so hand over a stored frame.
    """
    spark = footers.sparkSession
    declared = declared_columns(spark, contracts)
    held = footers.filter(F.col("column_name").isNotNull())
    files = footers.select("table_name", "file").distinct()
    null = F.lit(None).cast("string")

    def issue(rows: DataFrame, severity: Column, category: Column, expected: Column = null, actual: Column = null) -> DataFrame:
        has = rows.columns
        column = F.col("column_name") if "column_name" in has else null
        file = F.col("file") if "file" in has else null
        return rows.select("table_name", file.alias("file"), severity.alias("severity"), category.alias("category"), column.alias("column_name"), expected.alias("expected"), actual.alias("actual"))

    listed = declared.filter(F.col("required").isNotNull())
    absent = files.join(listed, "table_name").join(held.select("table_name", "file", "column_name"), ["table_name", "file", "column_name"], "left_anti")
    found = issue(absent, F.when(F.col("required"), "error").otherwise("info"), F.when(F.col("required"), "missing_column").otherwise("missing_optional_column"))
    with_contract = spark.createDataFrame([(t,) for t in contracts], "table_name string")
    extra = held.join(with_contract, "table_name", "left_semi").join(listed.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    found = found.union(issue(extra, F.lit("warning"), F.lit("extra_column")))
    typed = held.join(declared.filter(F.col("expected").isNotNull()), ["table_name", "column_name"])
    typed = typed.filter(family(F.col("expected")) != family(F.col("actual")))
    found = found.union(issue(typed, F.lit("error"), F.lit("type_mismatch"), F.col("expected"), F.col("actual")))
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys([*contracts, *tables])], "table_name string")
    found = found.union(issue(wanted.join(files, "table_name", "left_anti"), F.lit("critical"), F.lit("existence")))
    found = found.union(issue(files.select("table_name").distinct().join(with_contract, "table_name", "left_anti"), F.lit("warning"), F.lit("compatibility")))

    counts = held.groupBy("table_name", "column_name", "actual").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("table_name", "column_name").agg(F.sum("n").alias("holders"), F.min_by("actual", F.struct(-F.col("n"), "actual")).alias("usual"))
    changed = held.join(usual, ["table_name", "column_name"]).filter(F.col("actual") != F.col("usual"))
    found = found.union(issue(changed, F.lit("warning"), F.lit("drift"), F.col("usual"), F.col("actual")))
    total = files.groupBy("table_name").agg(F.count(F.lit(1)).alias("files"))
    partly = usual.join(total, "table_name").filter((F.col("holders") < F.col("files")) & (F.col("holders") * 2 > F.col("files")))
    gone = files.join(partly, "table_name").join(held.select("table_name", "file", "column_name"), ["table_name", "file", "column_name"], "left_anti")
    return found.union(issue(gone, F.lit("warning"), F.lit("drift"), F.col("usual")))


def exact_files(footers: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """``table_name, file, missing, extra, matches``: both lists, sorted, are empty for an exact match."""
    names = F.create_map(*[x for t, cols in expected.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cols]).cast("array<string>"))])
    held = footers.filter(F.col("table_name").isin(list(expected))).groupBy("table_name", "file").agg(F.collect_list("column_name").alias("held"))
    wanted = F.try_element_at(names, F.col("table_name"))
    lists = held.select("table_name", "file", F.sort_array(F.array_except(wanted, "held")).alias("missing"), F.sort_array(F.array_except("held", wanted)).alias("extra"))
    return lists.withColumn("matches", (F.size("missing") == 0) & (F.size("extra") == 0))


def relaxed_files(footers: DataFrame, core: Mapping[str, Sequence[str]]) -> DataFrame:
    """``table_name, file, compatible, missing, layout``: core columns only; files with batch ids are of the optimized layout, others legacy."""
    exact = exact_files(footers, core).select("table_name", "file", (F.size("missing") == 0).alias("compatible"), "missing", F.array_contains("extra", "batch_id").alias("_extra"))
    names = F.create_map(*[x for t, cols in core.items() for x in (F.lit(t), F.lit("batch_id" in cols))])
    batched = F.col("_extra") | (F.try_element_at(names, F.col("table_name")) & ~F.array_contains("missing", "batch_id"))
    return exact.select("table_name", "file", "compatible", "missing", F.when(batched, "optimized").otherwise("legacy").alias("layout"))
