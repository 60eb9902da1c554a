"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 1024


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weight: str,
    hot_share: float = 0.001,
) -> DataFrame:
    """Left join to a table that has one row per key and knows how often it occurs.

    Keys above ``hot_share`` of the total weight number at most 1 / hot_share,
    so that part of ``right`` is broadcast; their rows are spread evenly over
    the shuffle that serves all other keys. No row is dropped or repeated.
    """
    values = [c for c in right.columns if c not in keys and c != weight]
    limit = right.agg((F.sum(weight) * F.lit(float(hot_share))).alias("limit")).scalar()
    hot = right.filter(F.col(weight) > limit).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.struct(*values).alias("_hot_value"),
    )
    cold = right.filter(F.col(weight) <= limit).select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys],
        F.struct(*values).alias("_cold_value"),
    )
    matched = left.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    is_hot = F.col("_hot_value").isNotNull()
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    # rows with a hot key have their value, rows without a key get none: both may go anywhere
    salted = matched.withColumn(
        "_salt", F.when(is_hot | no_key, F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    )
    cold = cold.withColumn("_cold_salt", F.lit(0).cast("bigint"))
    on = [F.col(k) == F.col(f"_cold_{k}") for k in keys] + [F.col("_salt") == F.col("_cold_salt")]
    merged = salted.join(cold, on, "left").withColumn("_value", F.coalesce("_hot_value", "_cold_value"))
    return merged.select(*left.columns, *[F.col(f"_value.{v}").alias(v) for v in values])
