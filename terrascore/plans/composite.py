"""The composite index: six normalised components, weighted, ranked and labelled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.numbers import banded, percent_over, round_half_up, threshold_lookup, weighted_score, welfare_ratio
from terrascore.operators.climate import seasonal_climate
from terrascore.operators.ranking import competition_rank
from terrascore.operators.scaling import group_mean_fill, minmax_scale
from terrascore.plans.roles import IndexRoles
from terrascore.session import materialize

# Component weights, colour bands and climate labels of the published index.
WEIGHTS = {"quality": 0.35, "market": 0.20, "consumption": 0.15, "access": 0.15, "climate": 0.10, "mobility": 0.05}
SCORE_BANDS = [(3.0, "#d32f2f"), (4.5, "#f57c00"), (6.5, "#fbc02d")]
TOP_BAND = "#388e3c"
CLIMATE_BANDS = [(5000, "Мягкий"), (6000, "Холодный"), (7500, "Очень холодный"), (9000, "Арктический")]
TOP_CLIMATE = "Экстремальный"
HEATING_BASELINE = 4500.0

COMPONENTS = tuple(WEIGHTS)


@dataclass
class IndexSettings:
    """Everything the published index hard-codes."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    levels: Mapping[int, float] = field(default_factory=dict)
    default_level: float = 27000.0
    year: int = 2024
    period: tuple[str, str] = ("2024-07-01", "2024-12-31")
    climate_years: Sequence[int] = (2023, 2024)
    score_bands: Sequence[tuple[float, str]] = tuple(SCORE_BANDS)
    climate_bands: Sequence[tuple[float, str]] = tuple(CLIMATE_BANDS)
    heating_baseline: float = HEATING_BASELINE
    neutral: float = 0.5
    null_neutral: bool = False
    keep_null_band: bool = False


def entity_base(settlements: DataFrame, regions: DataFrame, territories: DataFrame) -> DataFrame:
    """Entities with region and territory names; entities without a territory stay."""
    keyed = territories.select("territory_id", F.lower(F.trim("territory_name")).alias("territory_key"))
    return settlements.join(regions, "region_id").join(keyed, "territory_id", "left")


def consumption_mean(series: DataFrame, key: str, period: tuple[str, str], category: str | None = None) -> DataFrame:
    """Mean consumption per key within a period, reduced before any join to entities."""
    start, end = (F.lit(d).cast("date") for d in period)
    rows = series.filter((F.col("date") >= start) & (F.col("date") < F.date_add(end, 1)))
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy(key).agg(F.avg("consumption").alias("consumption_raw"))


def mobility_by_name(mobility: DataFrame, year: int) -> DataFrame:
    """One value per normalised name; a name that occurs twice is averaged, not multiplied."""
    return (
        mobility.filter(F.col("year") == year)
        .groupBy(F.lower(F.trim("territory_label")).alias("territory_key"))
        .agg(F.avg("mobility_km").alias("mobility_raw"))
    )


def territory_facts(territories: DataFrame, market: DataFrame, mobility: DataFrame, year: int) -> DataFrame:
    """``territory_id, territory_key, market_raw, mobility_raw``, written once.

    Entities crowd into few territories, so shuffling them by territory would
    be lopsided; a stored table of known size lets Catalyst broadcast it.
    """
    this_year = market.filter(F.col("year") == year).select("territory_id", F.col("market_access").alias("market_raw"))
    keyed = territories.select("territory_id", F.lower(F.trim("territory_name")).alias("territory_key"))
    joined = keyed.join(this_year, "territory_id", "left").join(mobility_by_name(mobility, year), "territory_key", "left")
    return materialize(joined, "territory-facts")


def index_inputs(roles: IndexRoles, s: IndexSettings) -> DataFrame:
    """One row per entity with the raw component values.

    Fact tables are reduced to one row per entity or territory before they
    meet the entities, so a busy key costs one row in every join.
    """
    climate = seasonal_climate(roles.climate_monthly, roles.climate_yearly, s.climate_years)
    return (
        roles.settlements.join(roles.regions, "region_id")
        .join(territory_facts(roles.territories, roles.market, roles.mobility, s.year), "territory_id", "left")
        .join(consumption_mean(roles.consumption, "entity_id", s.period), "entity_id", "left")
        .join(roles.quality, "entity_id", "left")
        .join(roles.access, "entity_id", "left")
        .join(climate, "entity_id", "left")
        .join(roles.attributes, "entity_id", "left")
    )


def component_scores(inputs: DataFrame, s: IndexSettings) -> DataFrame:
    """Add the six ``<component>_score`` columns and the unrounded ``score``."""
    filled = group_mean_fill(inputs, "region_id", ["market_raw", "consumption_raw", "mobility_raw"])
    level = threshold_lookup(F.col("region_id"), s.levels, s.default_level)
    scaled = minmax_scale(
        filled, ["market_raw_filled", "degree_days", "mobility_raw_filled"], inverted=["degree_days"]
    )
    raw = {
        "quality": F.col("quality_scaled"),
        "market": F.col("market_raw_filled_scaled"),
        "consumption": welfare_ratio(F.col("consumption_raw_filled"), level, null_neutral=s.null_neutral),
        "access": F.col("access_scaled"),
        "climate": F.col("degree_days_scaled"),
        "mobility": F.col("mobility_raw_filled_scaled"),
    }
    scored = scaled.withColumns({f"{c}_score": F.coalesce(x, F.lit(float(s.neutral))) for c, x in raw.items()})
    score = weighted_score({c: F.col(f"{c}_score") for c in raw}, s.weights)
    # twelve digits: entities whose scores differ by float noise only are ties
    return scored.withColumn("score", score).withColumn("rank_score", F.round("score", 12))


def climate_band(s: IndexSettings) -> Column:
    band = banded(F.col("degree_days"), s.climate_bands, TOP_CLIMATE)
    return F.when(F.col("degree_days").isNotNull(), band) if s.keep_null_band else band


def composite_index(roles: IndexRoles, settings: IndexSettings | None = None) -> DataFrame:
    """The published view: names, flags, components on two scales, index on three, rank and labels."""
    s = settings or IndexSettings()
    inputs = materialize(index_inputs(roles, s), "index-inputs")
    ranked = competition_rank(component_scores(inputs, s), "rank_score", out="index_rank")
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("is_zone", "is_remote", "is_special", "is_suburb")]
    return ranked.select(
        "entity_id",
        "entity_name",
        "entity_type",
        "region_name",
        *flags,
        *[round_half_up(F.col(f"{c}_score"), 4).alias(f"{c}_score") for c in COMPONENTS],
        *[round_half_up(F.col(f"{c}_score") * 100, 2).alias(f"{c}_score_100") for c in COMPONENTS],
        round_half_up(F.col("score"), 4).alias("index_score"),
        round_half_up(F.col("score") * 100, 2).alias("index_score_100"),
        round_half_up(F.col("score") * 10, 2).alias("index_10"),
        banded(F.col("rank_score") * 10, s.score_bands, TOP_BAND).alias("index_colour"),
        "index_rank",
        *[round_half_up(F.col(c), 1).alias(c) for c in ("temp_mean", "temp_winter", "temp_summer", "temp_amplitude")],
        round_half_up(F.col("degree_days"), 4).alias("degree_days"),
        round_half_up(F.col("mobility_raw_filled"), 2).alias("mobility_km"),
        climate_band(s).alias("climate_band"),
        percent_over(F.col("degree_days"), s.heating_baseline).alias("heating_over_baseline"),
    )


def recomputed_index(roles: IndexRoles, settings: IndexSettings | None = None) -> DataFrame:
    """``entity_id, index_score, index_score_100`` from the fact tables, the components unrounded: the other side of a reconciliation."""
    s = settings or IndexSettings()
    anew = component_scores(materialize(index_inputs(roles, s), "index-inputs"), s)
    return anew.select("entity_id", round_half_up(F.col("score"), 4).alias("index_score"), round_half_up(F.col("score") * 100, 2).alias("index_score_100"))


def export_index(index: DataFrame) -> DataFrame:
    """Projection handed to the dashboard, ordered by rank."""
    dropped = ("mobility_km", "climate_band", "heating_over_baseline")
    return index.drop(*dropped).orderBy("index_rank", "entity_id")
