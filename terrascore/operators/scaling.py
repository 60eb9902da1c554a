"""Global and per-group normalisation without single-partition windows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.session import materialize


def column_bounds(df: DataFrame, cols: Sequence[str]) -> Column:
    """One-row struct ``<col>_lo, <col>_hi`` as a scalar subquery.

    Each task reduces its rows to one partial row, so only partials move.
    """
    fields = [f(c).alias(f"{c}_{tag}") for c in cols for f, tag in ((F.min, "lo"), (F.max, "hi"))]
    return df.agg(F.struct(*fields).alias("bounds")).scalar()


def scaled(x: Column, lo: Column, hi: Column, on_constant: float | None = None) -> Column:
    """Position of ``x`` between ``lo`` and ``hi``; a constant column gives ``on_constant``."""
    position = (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    return position if on_constant is None else F.when(hi == lo, F.lit(float(on_constant))).otherwise(position)


def minmax_scale(
    df: DataFrame,
    cols: Sequence[str],
    on_constant: float | None = None,
    inverted: Iterable[str] = (),
    suffix: str = "_scaled",
) -> DataFrame:
    """Add ``<col><suffix>`` in [0, 1] over all rows of ``df``."""
    bounds = column_bounds(df, cols)
    flipped = set(inverted)
    out = df.withColumn("_bounds", bounds)
    added = {}
    for c in cols:
        x = scaled(F.col(c), F.col(f"_bounds.{c}_lo"), F.col(f"_bounds.{c}_hi"), on_constant)
        added[f"{c}{suffix}"] = 1 - x if c in flipped else x
    return out.withColumns(added).drop("_bounds")


def group_mean_fill(df: DataFrame, group: str, cols: Sequence[str], suffix: str = "_filled") -> DataFrame:
    """Add ``<col><suffix>``: the value, or the mean of its group where missing.

    The means are one small aggregate, pre-reduced in every task and written
    once; joining it back moves no group into one task, however large.
    """
    means = materialize(
        df.groupBy(F.col(group).alias("_group")).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols]),
        "group-means",
    )
    joined = df.join(means, F.col(group).eqNullSafe(F.col("_group")), "left")
    filled = {f"{c}{suffix}": F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in cols}
    return joined.withColumns(filled).drop("_group", *[f"_mean_{c}" for c in cols])
