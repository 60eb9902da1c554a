"""Keyed change operators over snapshots: upsert, insert-if-absent, change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; null is a key value of its own.

    An aggregate rather than a window: repeats of a busy key collapse inside
    each task, before the shuffle.
    """
    values = [c for c in batch.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return batch.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])


def upsert_snapshot(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep_first: Sequence[str] = (),
    touched: tuple[str, Column] | None = None,
) -> DataFrame:
    """The target after the batch: matching keys overwritten, others added.

    ``keep_first`` columns hold on to the value of the first insert.
    ``touched = (column, time)`` stamps rows whose values changed.
    """
    fresh = last_wins(batch, keys, order)
    stamp = touched[0] if touched else None
    values = [c for c in target.columns if c not in keys and c != stamp]
    overwritten = [c for c in values if c not in keep_first]
    old = target.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    new = fresh.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.struct(*values).alias("_new"))
    both = old.join(new, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys], "full_outer")
    had, got = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = [F.when(had, F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}")).alias(k) for k in keys]
    for c in values:
        replace = got if c in overwritten else got & ~had
        out.append(F.when(replace, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c))
    if touched:
        same = F.lit(True)
        for c in overwritten:
            same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
        out.append(F.when(got & ~(had & same), touched[1]).otherwise(F.col(f"_old.{stamp}")).alias(stamp))
    return both.select(*out)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The target plus batch rows whose key it lacks, of a repeated key the first by ``order``."""
    known = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    values = [c for c in batch.columns if c not in keys]
    firsts = batch.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    absent = firsts.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in values]).join(
        known, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys], "left_anti"
    )
    return target.unionByName(absent.select(*target.columns))


def audit_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Change log between two snapshots: one row per inserted, updated or deleted key."""
    left = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_had"))
    right = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_got"))
    both = left.join(right, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys], "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    operation = F.when(F.col("_had").isNull(), "INSERT").when(F.col("_got").isNull(), "DELETE").when(~same, "UPDATE")
    return (
        both.withColumn("operation", operation)
        .filter(F.col("operation").isNotNull())
        .select(
            *[F.when(F.col("_had").isNull(), F.col(f"_n_{k}")).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys],
            *[f"old_{v}" for v in values],
            *[f"new_{v}" for v in values],
            "operation",
        )
    )
