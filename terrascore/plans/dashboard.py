"""Comparison products of the dashboard, for all entities at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.text import entity_label
from terrascore.operators.summaries import group_baselines
from terrascore.plans.composite import COMPONENTS, WEIGHTS

SCORES = tuple(f"{c}_score" for c in COMPONENTS)


def component_baselines(index: DataFrame) -> DataFrame:
    return group_baselines(index, ["index_10", *SCORES])


def _baseline(baselines: DataFrame, scope: str) -> DataFrame:
    row = baselines.filter(F.col("scope") == scope)
    return row.select(F.col("region_name").alias("_region"), *[F.col(c).alias(f"base_{c}") for c in ("index_10", *SCORES)])


def with_baseline(index: DataFrame, mode: str) -> DataFrame:
    """Add ``base_*`` columns: national or regional means (a small stored table)."""
    baselines = component_baselines(index)
    if mode == "regional":
        return index.join(_baseline(baselines, "region"), F.col("region_name").eqNullSafe(F.col("_region"))).drop("_region")
    row = _baseline(baselines, "all").drop("_region")
    return index.withColumn("_b", row.agg(F.struct(*[F.first(c).alias(c) for c in row.columns])).scalar()).select("*", "_b.*").drop("_b")


def _steps(score: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Eight ordered steps from the baseline to the index."""
    base = F.col("base_index_10")
    rows = [(F.lit("baseline"), base)]
    rows += [(F.lit(c), score[c] * F.lit(w) * 10 - base * F.lit(w)) for c, w in weights.items()]
    rows.append((F.lit("total"), score["index"]))
    return F.array(*[F.struct(F.lit(i).alias("step"), name.alias("label"), x.alias("value")) for i, (name, x) in enumerate(rows)])


def waterfall(index: DataFrame, mode: str = "national", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``entity_id, step, label, value``: how each component moves an entity off the baseline."""
    score = {c: F.col(f"{c}_score") for c in weights} | {"index": F.col("index_10")}
    steps = with_baseline(index, mode).select("entity_id", F.explode(_steps(score, weights)).alias("s"))
    return steps.select("entity_id", F.col("s.step").cast("bigint").alias("step"), "s.label", "s.value")


def average_waterfall(index: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """The waterfall of the average entity; in either mode it starts from the national mean."""
    row = _baseline(component_baselines(index), "all")
    score = {c: F.col(f"base_{c}_score") for c in weights} | {"index": F.col("base_index_10")}
    steps = row.select(F.explode(_steps(score, weights)).alias("s"))
    return steps.select(F.col("s.step").cast("bigint").alias("step"), "s.label", "s.value")


def radar(index: DataFrame, mode: str = "national") -> DataFrame:
    """``entity_id, component, value, baseline`` for every entity."""
    joined = with_baseline(index, mode)
    axes = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_score").alias("value"), F.col(f"base_{c}_score").alias("baseline")) for c in COMPONENTS])
    return joined.select("entity_id", F.explode(axes).alias("a")).select("entity_id", "a.component", "a.value", "a.baseline")


def best_region_radar(index: DataFrame) -> DataFrame:
    """The average entity in regional mode: best region against the national mean."""
    baselines = component_baselines(index)
    long = baselines.unpivot(["scope", "is_best"], list(SCORES), "component", "value")
    best = F.max(F.when(F.col("is_best"), F.col("value")))
    every = F.max(F.when(F.col("scope") == "all", F.col("value")))
    out = long.groupBy("component").agg(best.alias("value"), every.alias("baseline"))
    return out.withColumn("component", F.regexp_replace("component", "_score$", ""))


def filter_index(index: DataFrame, region: str = "all", zone: str = "all") -> DataFrame:
    """Rows of one region or all, inside (``yes``) or outside (``no``) the zone or both."""
    out = index
    if region != "all":
        out = out.filter(F.col("region_name") == region)
    if zone in ("yes", "no"):
        out = out.filter(F.col("is_zone") == (zone == "yes"))
    return out


def search_entities(index: DataFrame, term: str) -> DataFrame:
    """Entities whose label contains the term, any case; the best ranked one is selected."""
    label = entity_label(F.col("entity_name"), F.col("region_name"), F.col("index_10"))
    found = index.select("entity_id", "index_rank", label.alias("label")).filter(F.contains(F.lower("label"), F.lower(F.lit(term))))
    first = found.agg(F.min(F.struct("index_rank", "entity_id")).alias("f")).select("f.entity_id").scalar()
    return found.withColumn("selected", F.col("entity_id") == first)


def display_rows(index: DataFrame) -> DataFrame:
    """Table rows: percentages recomputed from the four-digit scores, flag as plain boolean."""
    rescaled = {f"{c}_score_100": F.col(f"{c}_score") * 100 for c in COMPONENTS}
    return index.withColumns(rescaled).withColumn("is_zone", F.coalesce(F.col("is_zone"), F.lit(False)))
