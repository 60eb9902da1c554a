"""Exact quantiles that never hold a whole group in one task.

The built-in percentile keeps every distinct value of a group in one buffer.
Here equal values are counted first, running counts over ranges of the values
give the place of each, and a quantile picks the values at its two places.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.operators.ranking import running_counts


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Per group: ``n_values`` and one column per entry of ``probs`` (linear interpolation)."""
    keys = [f"_q{i}" for i in range(len(groups))]
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_counts(counted, keys, "_v")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("n")), F.col("_v")))

    ends = []
    for i, p in enumerate(probs.values()):
        place = (F.col("_total") - 1) * F.lit(float(p))
        ends += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    found = placed.groupBy(*keys).agg(F.max("_total").alias("n_values"), *ends)
    # an aggregate without groups has a row even for no values at all
    found = found.filter(F.col("n_values").isNotNull())
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        place = (F.col("n_values") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "n_values", *cols)
