"""Text column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrascore.functions.numbers import round_half_up

# Ordered substrings of settlement types and their scores.
TYPE_RULES = [
    (("пгт", "рабочий", "рп"), 1.0),
    (("посёлок", "поселок"), 0.85),
    (("город", "гп"), 1.0),
    (("село",), 0.7),
]
OTHER_TYPE = 0.6

# Tokens a CSV reader treats as missing.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Month names of report files.
MONTHS = "January February March April May June July August September October November December".split()


def type_score(kind: Column, rules: Sequence[tuple[Sequence[str], float]] = tuple(TYPE_RULES), default: float = OTHER_TYPE) -> Column:
    """Score of the first rule one of whose words occurs in the lower-cased type."""
    name = F.lower(kind)
    expr = None
    for words, score in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        expr = (F if expr is None else expr).when(hit, F.lit(float(score)))
    return expr.otherwise(F.lit(float(default)))


def shorten(text: Column, limit: int = 30) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def yes_no(flag: Column, yes: str = "Да", no: str = "Нет") -> Column:
    return F.when(flag, yes).otherwise(no)


def thousands(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(round_half_up(x, 0), 0)


def entity_label(name: Column, region: Column, score: Column) -> Column:
    """The line a user searches in: ``name (region) — index x.xx``."""
    return F.format_string("%s (%s) — index %.2f", name, region, score)


def glob_regex(pattern: str) -> str:
    """Anchored, case-blind regular expression for a ``*`` / ``?`` file pattern."""
    wild = {"*": ".*", "?": "."}
    return "(?i)^" + "".join(wild.get(ch, re.escape(ch)) for ch in pattern) + "$"


def period_from_name(name: Column, given: Column | None = None) -> Column:
    """``yyyy-MM`` from an English month and a year in the name, else the given period, else ``unknown``."""
    pattern = "(?i)(" + "|".join(MONTHS) + r")[ _-]*(\d{4})"
    month = F.initcap(F.regexp_extract(name, pattern, 1))
    year = F.regexp_extract(name, pattern, 2)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    found = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"))
    fallback = F.lit("unknown") if given is None else F.coalesce(F.nullif(given, F.lit("")), F.lit("unknown"))
    return F.when(month != "", found).otherwise(F.trim(fallback))


def to_number(text: Column) -> Column:
    """Number from money text: dollar signs and thousands commas dropped, failure is null."""
    return F.regexp_replace(F.trim(text), r"[$,]", "").try_cast("double")


def numify(text: Column) -> Column:
    """Number from any text: only digits, dots and minus signs are read."""
    return F.regexp_replace(text, r"[^\d.\-]", "").try_cast("double")


def present(text: Column) -> Column:
    """The text, or null when it is one of the tokens that mean missing."""
    return F.when(~text.isin(MISSING_TOKENS), text)


def report_target(rule_id: Column) -> Column:
    """Curated table a rule feeds."""
    name = F.lower(rule_id)
    return F.when(name.contains("revenue_share") | name.contains("revshare"), "revenue").otherwise("sales")
