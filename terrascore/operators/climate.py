"""Seasonal means and degree-days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINTER = (12, 1, 2)
SUMMER = (6, 7, 8)


def degree_days(temperature: Column, base: float = 18.0) -> Column:
    """How far a day stays below the base."""
    return F.greatest(F.lit(0.0), F.lit(base) - temperature)


def yearly_degree_days(daily: DataFrame, base: float = 18.0) -> DataFrame:
    """``entity_id, year, degree_days`` from daily mean temperatures."""
    return daily.groupBy("entity_id", F.year("date").alias("year")).agg(
        F.sum(degree_days(F.col("temperature"), base)).alias("degree_days")
    )


def seasonal_climate(monthly: DataFrame, yearly: DataFrame, years: Sequence[int]) -> DataFrame:
    """Means over all, winter and summer months, their span, and degree-days.

    Degree-days are averaged over the monthly rows, so a year counts by its months.
    """
    wanted = F.col("year").isin(*years)
    joined = monthly.filter(wanted).join(yearly.filter(wanted), ["entity_id", "year"], "left")
    winter = F.avg(F.when(F.col("month").isin(*WINTER), F.col("temperature")))
    summer = F.avg(F.when(F.col("month").isin(*SUMMER), F.col("temperature")))
    return joined.groupBy("entity_id").agg(
        F.avg("temperature").alias("temp_mean"),
        winter.alias("temp_winter"),
        summer.alias("temp_summer"),
        (summer - winter).alias("temp_amplitude"),
        F.avg("degree_days").alias("degree_days"),
    )
