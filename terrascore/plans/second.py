"""Second index: first index, accessibility and settlement type, compared with the first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions.numbers import weighted_score
from terrascore.functions.text import OTHER_TYPE, TYPE_RULES, type_score
from terrascore.operators.ranking import competition_rank
from terrascore.operators.scaling import minmax_scale
from terrascore.session import materialize

# Weights of the second index.
SECOND_WEIGHTS = {"first": 0.60, "access": 0.30, "type": 0.10}


def second_index(
    entities: DataFrame,
    first: DataFrame,
    access: DataFrame,
    weights: Mapping[str, float] = SECOND_WEIGHTS,
    rules: Sequence[tuple[Sequence[str], float]] = tuple(TYPE_RULES),
    default: float = OTHER_TYPE,
) -> DataFrame:
    """Both indices side by side with their ranks and the change between them.

    ``entities`` has ``entity_id, entity_type``; ``first`` has ``index_v1``;
    ``access`` has ``access_score, hub_km``.
    """
    joined = entities.join(first.select("entity_id", "index_v1"), "entity_id").join(
        access.select("entity_id", "access_score", "hub_km"), "entity_id", "left"
    )
    rows = materialize(joined, "second-inputs")
    scaled = minmax_scale(rows, ["index_v1"], on_constant=0.5).withColumnRenamed("index_v1_scaled", "first_scaled")
    typed = scaled.withColumn("type_score", type_score(F.col("entity_type"), rules, default))
    parts = {"first": F.col("first_scaled"), "access": F.col("access_score"), "type": F.col("type_score")}
    scored = typed.withColumn("index_v2", weighted_score(parts, weights)).withColumns(
        {"index_v2_10": F.col("index_v2") * 10, "delta": F.col("index_v2") - F.col("first_scaled")}
    )
    stored = materialize(scored, "second-index")
    return rank_change(stored, "index_v1", "index_v2")


def rank_change(df: DataFrame, old: str, new: str) -> DataFrame:
    """Add ``rank_old``, ``rank_new`` and ``rank_change`` = old - new (up is positive)."""
    keyed = df.withColumns({"_old": F.round(old, 12), "_new": F.round(new, 12)})
    ranked = competition_rank(competition_rank(keyed, "_old", out="rank_old"), "_new", out="rank_new")
    return ranked.withColumn("rank_change", F.col("rank_old") - F.col("rank_new")).drop("_old", "_new")
