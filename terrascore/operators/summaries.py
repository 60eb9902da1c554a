"""Statistics behind the reports: one aggregate each, small results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.operators.quantiles import exact_quantiles
from terrascore.operators.ranking import top_n
from terrascore.session import materialize


def region_stats(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy("region_name").agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("entities"))


def zone_compare(df: DataFrame, score: str) -> DataFrame:
    """Counts and means inside and outside the zone, their distance and the higher side."""
    inside, outside = F.avg(F.when(F.col("is_zone"), F.col(score))), F.avg(F.when(~F.col("is_zone"), F.col(score)))
    return df.agg(
        F.count_if(F.col("is_zone")).alias("zone_count"),
        F.count_if(~F.col("is_zone")).alias("other_count"),
        inside.alias("zone_mean"),
        outside.alias("other_mean"),
        F.abs(inside - outside).alias("difference"),
        F.when(inside > outside, "zone").otherwise("other").alias("higher"),
    )


def kpi_summary(df: DataFrame, score: str, size: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("entities"),
        F.countDistinct("region_name").alias("regions"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
        F.sum(size).alias("total_size"),
        F.count_if(F.col("is_zone")).alias("zone_count"),
    )


def critical_summary(df: DataFrame, score: str, below: float = 3.0) -> DataFrame:
    """How many entities score below the limit, their share, range and regions."""
    low = F.col(score) < below
    return df.agg(
        F.count_if(low).alias("critical"),
        (F.count_if(low) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"),
        F.min(F.when(low, F.col(score))).alias("lowest"),
        F.max(F.when(low, F.col(score))).alias("highest"),
        F.array_join(F.array_sort(F.collect_set(F.when(low, F.col("region_name")))), ", ").alias("regions"),
    )


def band_counts(df: DataFrame, band: Column) -> DataFrame:
    return df.groupBy("region_name", "is_zone", band.alias("band")).agg(F.count(F.lit(1)).alias("entities"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers, mean and sample deviation per group."""
    quartiles = exact_quantiles(df, [group], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    limits = materialize(quartiles.withColumnRenamed(group, "_group"), "quartiles")
    joined = df.join(limits, F.col(group).eqNullSafe(F.col("_group")))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return joined.groupBy(group, "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("deviation"),
    )


def region_rollup(df: DataFrame, size: str) -> DataFrame:
    """Totals for all entities, per region and per entity; ``level`` 0, 1, 2."""
    out = df.rollup("region_name", "entity_id").agg(
        F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("entities"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 3, 0).when(F.col("_g") == 1, 1).otherwise(2)
    return out.withColumn("level", level).drop("_g")


def group_baselines(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means of every metric per region and over all (null region), with the best region marked."""
    lead = metrics[0]
    means = materialize(
        df.rollup("region_name").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("entities"), F.grouping_id().alias("_g")),
        "baselines",
    )
    best = means.filter("_g = 0").agg(F.min(F.struct((-F.col(lead)).alias("m"), "region_name")).alias("b")).select("b.region_name").scalar()
    return means.withColumn("is_best", (F.col("_g") == 0) & (F.col("region_name") == best)).withColumn("scope", F.when(F.col("_g") == 1, "all").otherwise("region")).drop("_g")


def top_bottom_contrast(df: DataFrame, rank: str, metrics: Sequence[str], n: int = 10) -> DataFrame:
    """Mean of each metric over the first and last ``n`` by rank, and the difference."""
    first = top_n(df, F.col(rank).asc(), n, "entity_id")
    last = df.orderBy(F.col(rank).desc(), F.col("entity_id").desc()).limit(n)
    both = first.select(*metrics, F.lit("top").alias("_side")).unionByName(last.select(*metrics, F.lit("bottom").alias("_side")))
    long = both.unpivot(["_side"], list(metrics), "metric", "value")
    top, bottom = F.avg(F.when(F.col("_side") == "top", F.col("value"))), F.avg(F.when(F.col("_side") == "bottom", F.col("value")))
    return long.groupBy("metric").agg(top.alias("top_mean"), bottom.alias("bottom_mean"), (top - bottom).alias("difference"))


def quality_counts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Volumes of a load: entities, with coordinates, in zone, facts, indicators, missing values."""
    left = entities.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("with_coordinates"),
        F.count_if(F.col("is_zone")).alias("zone_count"),
        F.count_if(~F.col("is_zone")).alias("other_count"),
    )
    right = facts.agg(
        F.struct(
            F.count(F.lit(1)).alias("facts"),
            F.countDistinct("code").alias("indicators"),
            F.count_if(F.col("value").isNull()).alias("missing_values"),
        ).alias("f")
    ).scalar()
    return left.withColumn("_f", right).select("*", "_f.facts", "_f.indicators", "_f.missing_values").drop("_f")


# -- clusters -----------------------------------------------------------------------

# Size bands and the names a cluster gets.
LABEL_BANDS = (15000, 7000, 4000, 2000)
LABEL_PATTERN = "Ханты-Мансийский|Ямало-Ненецкий"
LABELS = {
    "single": "Аномалия: ",
    "large_oil": "Нефтегазовые посёлки (ХМАО/ЯНАО)",
    "large": "Крупные ПГТ/города",
    "middle_zone": "Арктические центры",
    "middle": "Средние города/ПГТ",
    "small_zone": "Арктические сёла",
    "small_oil": "Малые нефтегазовые ПГТ",
    "small": "Стабильные сёла",
    "tiny_zone": "Малые арктические НП",
    "tiny": "Сельские поселения",
    "rest": "Малые изолированные НП",
    "again": " (вар.%d)",
}


def cluster_stats(df: DataFrame, scores: Sequence[str] = ()) -> DataFrame:
    return df.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("population").alias("mean_population"),
        F.sum("population").alias("total_population"),
        F.count_if(F.col("is_zone")).alias("zone_count"),
        *[F.avg(s).alias(f"mean_{s}") for s in scores],
    )


def cluster_descriptors(df: DataFrame, pattern: str = LABEL_PATTERN) -> DataFrame:
    """Size, mean population, zone share, share of matching regions, modal region, one name."""
    # counted per region first: a cluster that holds most rows shrinks to one row per region
    cells = df.groupBy("cluster_id", "region_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("population").alias("p"),
        F.count("population").alias("p_n"),
        F.count_if(F.col("is_zone")).alias("z"),
        F.min("entity_name").alias("first_name"),
    )
    known = F.when(F.col("region_name").isNotNull(), F.struct((-F.col("n")).alias("minus"), "region_name"))
    return cells.groupBy("cluster_id").agg(
        F.sum("n").alias("entities"),
        (F.sum("p") / F.nullif(F.sum("p_n"), F.lit(0))).alias("mean_population"),
        (F.sum("z") / F.sum("n")).alias("zone_share"),
        (F.sum(F.when(F.col("region_name").rlike(pattern), F.col("n")).otherwise(0)) / F.sum("n")).alias("pattern_share"),
        F.min(known)["region_name"].alias("modal_region"),
        F.min("first_name").alias("first_name"),
    )


def cluster_label(bands: Sequence[float] = LABEL_BANDS, labels: Mapping[str, str] = LABELS) -> Column:
    """Name of a cluster from its descriptors."""
    size, zone, oil = F.col("mean_population"), F.col("zone_share") > 0.5, F.col("pattern_share") > 0.5
    huge, middle, small, tiny = (F.lit(float(b)) for b in bands)

    def say(key: str) -> Column:
        return F.lit(labels[key])

    return (
        F.when(F.col("entities") == 1, F.concat(say("single"), F.col("first_name")))
        .when(size > huge, F.when(oil, say("large_oil")).otherwise(say("large")))
        .when(size > middle, F.when(zone, say("middle_zone")).otherwise(say("middle")))
        .when(size > small, F.when(zone, say("small_zone")).when(oil, say("small_oil")).otherwise(say("small")))
        .when(size > tiny, F.when(zone, say("tiny_zone")).otherwise(say("tiny")))
        .otherwise(say("rest"))
    )


def cluster_names(descriptors: DataFrame, bands: Sequence[float] = LABEL_BANDS, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """``cluster_id, cluster_name``; a repeated name gets a numbered suffix in id order."""
    based = descriptors.select("cluster_id", cluster_label(bands, labels).alias("_base"))
    again = F.row_number().over(Window.partitionBy("_base").orderBy("cluster_id")) - 1
    named = based.withColumn("_again", again)
    suffix = F.when(F.col("_again") > 0, F.format_string(labels["again"], F.col("_again"))).otherwise("")
    return named.select("cluster_id", F.concat("_base", suffix).alias("cluster_name"))


def cluster_profiles(df: DataFrame, names: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``cluster_id, cluster_name, entities, mean_values`` with a map of non-null means."""
    means = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("entities"), *[F.avg(m).alias(m) for m in metrics])
    entries = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics])
    mapped = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return means.join(names, "cluster_id").select("cluster_id", "cluster_name", "entities", mapped.alias("mean_values"))


def cluster_metrics(df: DataFrame, metrics: Mapping[str, float]) -> DataFrame:
    """Long ``cluster_id, metric, value`` with each mean times its factor."""
    means = df.groupBy("cluster_id").agg(*[(F.avg(m) * F.lit(float(k))).alias(m) for m, k in metrics.items()])
    return means.unpivot(["cluster_id"], list(metrics), "metric", "value")
