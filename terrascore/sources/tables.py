"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Declared layouts of the test tables: no scan starts with an inference job.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan; filters and columns are pushed down by Catalyst."""
    reader = spark.read.schema(LAYOUTS[name]) if name in LAYOUTS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def read_database(spark: SparkSession, url: str, table: str, split_on: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """Parallel scan of a live database table, split into ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=split_on, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options)
        .load()
    )


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """UTF-8 CSV with a header row and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("encoding", "UTF-8").option("escape", '"').csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header row in every file; a quote inside a cell is doubled."""
    df.write.option("encoding", "UTF-8").option("escape", '"').csv(path, header=True)


def write_json(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """JSON lines with nulls kept and decimals as floating numbers."""
    plain = df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema])
    (plain.orderBy(*order) if order else plain).write.option("ignoreNullFields", "false").json(path)


def write_facts(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Parquet laid out by the columns queries filter on, for partition pruning."""
    df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.partitionBy(*partition_by).parquet(path)


def write_matrix(pairs: DataFrame, path: str) -> None:
    """Pair table as Parquet; the ids in the rows replace positional row order."""
    pairs.write.parquet(path)
