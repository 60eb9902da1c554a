"""Ranks, top-n lists and ordered views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.operators.joins import lookup_join
from terrascore.session import materialize


def running_counts(counted: DataFrame, groups: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """Add ``_before``, the rows ahead of a value in its group, and ``_total``, all rows of the group.

    ``counted`` has one row per group and value with its number of rows ``n``; values are of any orderable type. The rows are dealt out by
    ranges of (group, value), so a group of any size spreads over as many tasks as it needs; only one sum per group and range is ordered
    as a whole.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    # stored with the number of the range: it is fixed from here on
    ranged = materialize(counted.repartitionByRange(*groups, order).withColumn("_range", F.spark_partition_id()), "ranges")
    names = [f"_g{i}" for i in range(len(groups))]
    sums = ranged.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, names)], F.col("_range").alias("_at")).agg(F.sum("n").alias("_rows"))
    earlier = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_at", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead"), F.sum("_rows").over(Window.partitionBy(*names)).alias("_total"))
    inside = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, names)] + [F.col("_range") == F.col("_at")]
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, same)
    return placed.withColumn("_before", F.col("_ahead") + F.col("_inside")).select(*counted.columns, "_before", "_total")


def value_ranks(df: DataFrame, score: str) -> DataFrame:
    """``score, n, rank``: one row per distinct score that is not null, best first, ties share a rank."""
    counted = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    return running_counts(counted, [], score, descending=True).select(score, "n", (F.col("_before") + 1).cast("bigint").alias("rank"))


def competition_rank(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    """Add ``out`` = 1 + number of rows with a greater ``score``; null scores get null.

    ``df`` is read twice, so hand over a materialised or cheap frame. Scores compare as their type does: whole numbers exactly, nan
    above all numbers.
    """
    key = "_rank_key"
    keyed = df.withColumn(key, F.col(score))
    ranks = materialize(value_ranks(keyed, key).withColumnRenamed("rank", out), "ranks")
    return lookup_join(keyed, ranks, [key], "n").drop(key)


def top_n(df: DataFrame, order: Column, n: int, tie: str) -> DataFrame:
    """First ``n`` rows; planned as a per-task heap, not a full sort."""
    return df.orderBy(order, F.col(tie)).limit(n)


def top_bottom_n(df: DataFrame, score: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` best and ``n`` worst rows with their place in each list."""
    top = top_n(df.filter(F.col(score).isNotNull()), F.col(score).desc(), n, tie)
    bottom = top_n(df.filter(F.col(score).isNotNull()), F.col(score).asc(), n, tie)
    up = Window.orderBy(F.col(score).desc(), F.col(tie))
    down = Window.orderBy(F.col(score).asc(), F.col(tie))
    return (
        top.withColumn("place", F.row_number().over(up).cast("bigint"))
        .withColumn("list", F.lit("top"))
        .unionByName(bottom.withColumn("place", F.row_number().over(down).cast("bigint")).withColumn("list", F.lit("bottom")))
    )


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int, out: str = "place") -> DataFrame:
    """First ``n`` rows of each group; every task keeps only ``n`` per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= n)


def sort_table(df: DataFrame, column: str, descending: bool = False, collation: str = "ru") -> DataFrame:
    """Order by any column: nulls last both ways, true before false going up, words in local order."""
    kind = df.schema[column].dataType.typeName()
    key = F.col(column)
    if kind == "boolean":
        key = ~key
    elif kind == "string":
        key = F.collate(key, collation)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())
