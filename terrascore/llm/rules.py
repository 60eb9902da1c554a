"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures are column expressions over the text, its words and its lines; a rule names a measure and the range it has to be in. The
whole table becomes one projection of measures and verdicts, with no user function and no shuffle.

Repeated windows: every window of ``window`` words is one 64-bit hash; where hashes repeat, their positions are sorted next to each other
and the words they cover are summed from the gaps between them, so the work is n log n in the words of a text.

Defined results: null or empty text: all counts 0, which fails the least number of words. Ratios of nothing are 0. Repeated rows each
come back. All columns of the input other than the id and the text are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Symbols counted by the symbol ratio.
SYMBOLS = "#*$%&|<>"
#: Very common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by at or this from "
    "der die das und ist zu den von mit ein eine nicht auf im des dem sich "
    "le la les et de des un une du est que en dans pour au "
    "el los las y que del por con se una es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` has to be at least ``least`` and at most ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        value, out = F.col(self.measure), F.lit(False)
        if self.least is not None:
            out = out | (value < self.least)
        if self.most is not None:
            out = out | (value > self.most)
        return out


#: Rules that every text has to pass, in whole numbers.
BASE_RULES = (Rule("n_words", least=20), Rule("repeat_excess", most=0))
#: Rules of the method.
RULES = (
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.01),
    Rule("upper_ratio", most=0.5),
    Rule("dup_line_ratio", most=0.5),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("bullet_line_ratio", most=0.9),
)


def without(text: Column, letters: Sequence[str]) -> Column:
    for letter in letters:
        text = F.replace(text, F.lit(letter))
    return text


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, carry: bool = False) -> DataFrame:
    """doc_id and all measures of every row; with ``carry`` also the whole row as the struct ``row``."""
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    along = ["row"] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *row)
    # each array is a column of its own, so that no expression is evaluated twice or inside a lambda
    split = base.select(
        "doc_id",
        *along,
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n_words = F.size("words").cast("long")
    counted = split.select(
        "doc_id",
        *along,
        n_words.alias("n_words"),
        F.char_length(without(F.col("text"), " \t\n\v\f\r")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]\s"))).cast("long").alias("n_bullet_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.when(
        F.size("hashes") >= window,
        F.transform(F.sequence(F.lit(0), F.size("hashes") - window), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = counted.withColumn("windows", windows).drop("hashes")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    sorted_ = hashed.withColumn("placed", F.when(repeats, placed)).drop("windows")
    # equal hashes stand next to each other
    beside = lambda x, i, step: F.get("placed", i + step).getField("h").eqNullSafe(x.getField("h"))
    twice = F.filter("placed", lambda x, i: beside(x, i, -1) | beside(x, i, 1))
    starts = sorted_.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x.getField("at").cast("long")))).drop("placed")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc.getField("sum") + F.least(F.lit(window).cast("long"), p - acc.getField("last"))).alias("sum")),
        lambda acc: acc.getField("sum"),
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, base_rules: Sequence[Rule] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row: doc_id, the counts and ratios, base_failed, the list of failed rules and kept (and ``row``, with ``carry``)."""
    counts = measures(docs, id_col, text_col, carry=carry)
    n, lines = F.col("n_words"), F.col("n_lines")
    ratios = counts.withColumns({
        "repeat_excess": F.greatest(F.lit(0), 100 * F.col("n_repeat_words") - 30 * n),
        "mean_word_chars": ratio(F.col("word_chars"), n),
        "symbol_ratio": ratio(F.col("n_symbols"), n),
        "stop_word_ratio": ratio(F.col("n_stop_words"), n),
        "upper_ratio": ratio(F.col("n_upper"), F.col("word_chars")),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), lines),
        "ellipsis_line_ratio": ratio(F.col("n_ellipsis_lines"), lines),
        "bullet_line_ratio": ratio(F.col("n_bullet_lines"), lines),
    })
    base_failed = F.lit(False)
    for rule in base_rules:
        base_failed = base_failed | rule.failed()
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.measure)) for r in rules]))
    out = ratios.withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    if carry:
        # a filter on kept must not be pushed below the projection, where every measure would be computed anew
        kept = kept & (F.monotonically_increasing_id() >= 0)
    return out.withColumn("kept", kept).drop("repeat_excess")
