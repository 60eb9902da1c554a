"""First index: known cells, drop sparse codes, impute, pick factors, scale, rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.operators import cells, matrix
from terrascore.operators.learning import pca_components, to_vectors
from terrascore.operators.ranking import competition_rank
from terrascore.session import materialize


def imputed_matrix(entities: DataFrame, facts: DataFrame, max_missing: float = 0.5, pick: str = "earliest") -> tuple[DataFrame, list[str]]:
    """Complete entity x code matrix and the codes that were dense enough to keep."""
    codes = matrix.indicator_codes(facts)
    wide = materialize(entities.join(matrix.indicator_pivot(facts, codes, pick), "entity_id", "left"), "matrix")
    kept = matrix.dense_codes(wide, codes, max_missing)
    filled = matrix.median_impute(wide, kept).drop(*[c for c in codes if c not in kept])
    return materialize(filled, "imputed"), kept


@dataclass(frozen=True)
class LongMatrix:
    """The matrix in long form, each part stored once: entities, known cells, and the codes kept with range and median."""

    entities: DataFrame
    cells: DataFrame
    codes: DataFrame


def long_matrix(entities: DataFrame, facts: DataFrame, max_missing: float = 0.5, pick: str = "earliest") -> LongMatrix:
    """As ``imputed_matrix`` for any number of codes; missing cells are implied by the median of their code."""
    stored = materialize(entities, "entities")
    known = materialize(cells.known_cells(stored, facts, pick), "cells")
    kept = materialize(cells.dense(cells.code_profile(stored, known), max_missing), "dense")
    return LongMatrix(stored, known, materialize(cells.with_medians(kept, known), "codes"))


def first_index(
    entities: DataFrame,
    facts: DataFrame,
    n_factors: int = 10,
    max_missing: float = 0.5,
    factors: Sequence[str] | None = None,
) -> DataFrame:
    """``entity_id, index_v1, place``.

    Factors default to those that follow ``population`` best or, where the
    entities have no such column, to those that weigh most in the components.
    """
    long = long_matrix(entities, facts, max_missing)
    if factors is not None:
        chosen = long.codes.filter(F.col("code").isin(list(factors)))
    elif "population" in entities.columns:
        best = cells.top_codes(long.entities, long.cells, long.codes, "population", n_factors)
        chosen = long.codes.join(best.select("code"), "code", "left_semi")
    else:
        # components are linear algebra over columns
        wide, kept = imputed_matrix(entities, facts, max_missing)
        found = pca_components(to_vectors(wide, kept)).importance(kept)
        chosen = long.codes.join(found.orderBy(F.desc("importance"), "code").limit(n_factors).select("code"), "code", "left_semi")
    scored = cells.mean_scaled(long.entities, long.cells, materialize(chosen, "factors"))
    scored = materialize(scored.withColumn("_rank", F.round("index_v1", 12)), "first-index")
    return competition_rank(scored, "_rank", out="place").drop("_rank")
