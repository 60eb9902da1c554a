"""Views over the monthly territory series and yearly snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_stats(series: DataFrame) -> DataFrame:
    """Per category: territories, mean, extremes and sample deviation."""
    return series.groupBy("category").agg(
        F.countDistinct("territory_id").alias("territories_count"),
        F.avg("consumption").alias("avg_consumption"),
        F.min("consumption").alias("min_consumption"),
        F.max("consumption").alias("max_consumption"),
        F.stddev_samp("consumption").alias("stddev_consumption"),
    )


def latest_month(series: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of the newest date that have a dictionary entry, with its description."""
    newest = series.agg(F.max("date").alias("newest")).scalar()
    return (
        series.filter(F.col("date") == newest)
        .join(categories, F.col("category") == F.col("category_name"))
        .select("territory_id", "date", "category", "consumption", F.col("description").alias("category_description"))
    )


def latest_value(yearly: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the most recent year per key, as one aggregate."""
    return yearly.groupBy(key).agg(F.max("year").alias("year"), F.max_by(value, "year").alias(value))


def crosswalk(rows: DataFrame, mapping: DataFrame, key: str, target: str) -> DataFrame:
    """Attach codes of another territory system; rows without one stay, flagged."""
    return rows.join(mapping, key, "left").withColumn("matched", F.col(target).isNotNull())
