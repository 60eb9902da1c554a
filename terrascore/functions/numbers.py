"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Decimal rounding, half away from zero; ten digits absorb float noise."""
    return F.round(x.cast("decimal(28,10)"), digits).cast("double")


def weighted_score(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of weight x score in the order of ``weights``."""
    terms = [F.lit(float(w)) * scores[name] for name, w in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def banded(x: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose upper bound lies above ``x``; nulls fall to ``otherwise``."""
    expr = F.when(x < F.lit(bands[0][0]), bands[0][1])
    for bound, label in bands[1:]:
        expr = expr.when(x < F.lit(bound), label)
    return expr.otherwise(otherwise)


def threshold_lookup(key: Column, levels: Mapping[int, float], default: float) -> Column:
    """Constant per key from a parameter map, with a default for other keys."""
    expr = None
    for k, level in levels.items():
        expr = (F if expr is None else expr).when(key == F.lit(k), F.lit(float(level)))
    return F.lit(float(default)) if expr is None else expr.otherwise(F.lit(float(default)))


def welfare_ratio(x: Column, level: Column, cap: float = 2.0, null_neutral: bool = False) -> Column:
    """``least(x / level, cap) / cap``.

    ``least`` skips nulls, so a missing ``x`` scores 1.0 by default;
    ``null_neutral`` keeps it null for a later neutral default instead.
    """
    ratio = F.least(x / level, F.lit(cap)) / F.lit(cap)
    return F.when(x.isNotNull(), ratio) if null_neutral else ratio


def percent_over(x: Column, baseline: float) -> Column:
    """How far ``x`` lies above ``baseline``, in whole percent."""
    return round_half_up((x - F.lit(float(baseline))) / F.lit(float(baseline)) * F.lit(100.0), 0)


def distance_decay(km: Column, scale_km: float = 500.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + km / F.lit(float(scale_km)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    spread = F.nullif(F.stddev_samp(px) * F.stddev_samp(py), F.lit(0.0))
    constant = (F.min(px) == F.max(px)) | (F.min(py) == F.max(py))
    return F.when(~constant, F.covar_samp(px, py) / spread)
