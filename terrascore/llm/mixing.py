"""Mixing sources to target weights by iterative proportional fitting.

The tokens of all documents are summed per cell (source, language, topic). A sweep rakes the cell weights to the target share of every
level of one dimension after the other: margins are grouped sums over the cells, factors are joined back. Cells stay a Spark table, so
neither the number of sources nor of topics is limited; only one number per sweep, the largest deviation from a target, reaches the
driver. After convergence the sampling probability of a document is ``min(1, c * weight)`` of its cell. By default c is the largest value
for which no probability is cut, so the expected tokens of the sample meet every target; with ``keep_share`` it is calibrated so that the
expected tokens are that share of all, and cells at probability 1 fall short of their target. With ``least_kept`` c stays the exact one
while it keeps that share of the tokens, and is calibrated to it otherwise, so that a few rare cells do not decide how much of all is
kept; the share kept and the levels that fall short are logged, and ``shares_kept`` has them all. A document is drawn by a hash of its id and text, so the draw does not depend on
partitions or on repeated runs.

Targets of a dimension are explicit shares, or an exponent that tempers the shares found in the data (1 keeps them, 0 makes all
levels equal). Targets of levels without tokens are left out and the rest scaled to 1.

Defined results: a null level counts as the level ``(none)``; a level without an explicit share gets no weight. Null or empty texts have
no tokens; their cell may have no weight, which is then 1. Repeated rows are weighed each and drawn alike. An empty table has no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch
from terrascore.llm.rules import SPACE
from terrascore.llm.sharding import HASH_BITS, row_hash

#: Words that mark the topic of a text; the topic with the most distinct marks is taken, the first of equals.
TOPICS = {
    "legal": ("license", "copyright", "rights reserved", "terms of", "privacy"),
    "web": ("http", "www.", "cookie", "subscribe", "click"),
    "contact": ("@", "phone", "e-mail", "address", "call us"),
    "access": ("password", "secret", "token", "api_key", "akia"),
}
NO_TOPIC, NO_LEVEL = "general", "(none)"


@dataclass(frozen=True)
class MixingSettings:
    targets: Mapping[str, float | Mapping[str, float]] = field(default_factory=lambda: {"source": 0.9, "lang": 0.9, "topic": 0.9})
    keep_share: float | None = None  # None: as many as keep every target exactly
    least_kept: float | None = None  # share of the tokens below which targets give way to it
    tolerance: float = 1e-6
    sweeps: int = 40
    topic_column: str | None = None  # None: by the marks of the word table, whatever columns the documents have


def topic_of(text: Column) -> Column:
    low = F.lower(text)
    marks = [(F.concat_ws("", *[F.when(F.contains(low, F.lit(w)), "x") for w in words]), name) for name, words in TOPICS.items()]
    score = [(F.length(x), name) for x, name in marks]
    best = F.greatest(*[n for n, _ in score])
    out = F.when(best == 0, NO_TOPIC)
    for n, name in score:
        out = out.when(n == best, name)
    return out


def measured(docs: DataFrame, dimensions: list[str], id_col: str, text_col: str, carry: bool = False, topic_column: str | None = None) -> DataFrame:
    """(doc_id, the levels, n_tokens, draw) of every row; ``draw`` is uniform in [0, 1). With ``carry`` also the whole row as ``row``."""
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    levels = [F.coalesce(((F.col(topic_column) if topic_column else topic_of(text)) if d == "topic" else F.col(d)).cast("string"), F.lit(NO_LEVEL)).alias(d) for d in dimensions]
    tokens = F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), *levels, tokens.alias("n_tokens"), (row_hash(id_col, text_col) / float(1 << HASH_BITS)).alias("draw"), *row)


def target_shares(cells: DataFrame, dimension: str, target: float | Mapping[str, float]) -> DataFrame:
    """(level, share) summing to 1 over the levels that have tokens."""
    found = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if isinstance(target, Mapping):
        given = F.lit(0.0)
        for level, share in target.items():
            given = F.when(F.col(dimension) == level, float(share)).otherwise(given)
        raw = found.select(dimension, given.alias("raw"))
    else:
        raw = found.select(dimension, F.pow(F.col("tokens").cast("double"), float(target)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total")).scalar()
    return raw.select(dimension, (F.col("raw") / total).alias("share"))


def rake(cells: DataFrame, settings: MixingSettings, scratch: Scratch) -> DataFrame:
    """The cells with a weight per token that brings all margins to their targets; the weighted tokens sum to all tokens."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    shares = {d: scratch.store(target_shares(cells, d, t), f"target_{d}") for d, t in settings.targets.items()}
    now = cells.withColumn("weight", F.lit(1.0))

    def margins(frame: DataFrame, d: str) -> DataFrame:
        return frame.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass")).join(shares[d], d)

    for sweep in range(settings.sweeps):
        for d in shares:
            factor = F.when(F.col("mass") > 0, F.col("share") * total / F.col("mass")).otherwise(0.0)
            factors = margins(now, d).select(d, factor.alias("factor"))
            now = now.join(factors, d, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor")
        now = scratch.store(now, f"sweep{sweep}")
        if sweep:
            scratch.drop(f"sweep{sweep - 1}")
        off = None
        for d in list(shares)[:-1] or list(shares):
            one = margins(now, d).select(F.abs(F.col("mass") / total - F.col("share")).alias("off"))
            off = one if off is None else off.union(one)
        left = off.agg(F.max("off")).first()[0] or 0.0
        if left < settings.tolerance:
            break
    else:
        logging.getLogger(__name__).warning("after %d sweeps a margin is still off by %.2g of all tokens", settings.sweeps, left)
    return now


def scale_for(cells: DataFrame, keep_share: float | None, least_kept: float | None = None) -> float:
    """c of the sampling probabilities; for a given share by a search with one small aggregate per 64 steps."""
    total, most, least = cells.agg(F.sum("tokens"), F.max("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    if not total or not most:
        return 1.0
    if keep_share is None:
        # the weighted tokens sum to all tokens, so the exact c is the share it keeps
        if least_kept is None or 1.0 / most >= least_kept:
            return 1.0 / most
        keep_share = least_kept
    low, high = 0.0, 1.0 / least
    for _ in range(5):
        grid = [low + (high - low) * k / 64 for k in range(65)]
        sums = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * F.col("weight"))).alias(f"s{k}") for k, c in enumerate(grid)]).first()
        enough = [k for k, s in enumerate(sums) if s >= keep_share * total]
        if not enough:
            return high
        low, high = grid[max(enough[0] - 1, 0)], grid[enough[0]]
    return high


def cell_weights(rows: DataFrame, settings: MixingSettings, scratch: Scratch) -> DataFrame:
    """(the levels, tokens, weight, probability) of every cell of measured rows."""
    dimensions = list(settings.targets)
    cells = scratch.store(rows.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, settings, scratch)
    probability = F.least(F.lit(1.0), F.lit(scale_for(raked, settings.keep_share, settings.least_kept)) * F.col("weight"))
    return scratch.store(raked.select(*dimensions, "tokens", "weight", probability.alias("probability")), "weights")


def shares_kept(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, level, target, share) of every level: its share of the weighted and of the expected tokens."""
    out = None
    both = cells.agg(F.sum(F.col("tokens") * F.col("weight")).alias("all"), F.sum(F.col("tokens") * F.col("probability")).alias("kept")).first()
    for d in dimensions:
        sums = cells.groupBy(F.col(d).alias("level")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("target"), F.sum(F.col("tokens") * F.col("probability")).alias("share"))
        one = sums.select(F.lit(d).alias("dimension"), "level", (F.col("target") / F.lit(both["all"] or 1.0)).alias("target"), (F.col("share") / F.lit(both["kept"] or 1.0)).alias("share"))
        out = one if out is None else out.union(one)
    return out


def log_shares(cells: DataFrame, dimensions: list[str]) -> None:
    total, kept = cells.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    if not total:
        return
    short = shares_kept(cells, dimensions).where(F.col("share") < 0.999 * F.col("target"))
    n, first = short.count(), short.orderBy(F.col("share") / F.col("target")).limit(20).collect()
    names = "; ".join(f"{r.dimension} {r.level} {r.share:.3g} of {r.target:.3g}" for r in first)
    logging.getLogger(__name__).log(logging.WARNING if n else logging.INFO, "%.1f%% of the tokens are kept, %d levels fall short of their target%s", 100 * kept / total, n, f", by most: {names}" if n else "")


def mix_to_targets(docs: DataFrame, settings: MixingSettings = MixingSettings(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row: doc_id, the levels, n_tokens, weight, probability and sampled (and ``row``, with ``carry``)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    dimensions = list(settings.targets)
    rows = scratch.store(measured(docs, dimensions, id_col, text_col, topic_column=settings.topic_column), "rows")
    weights = cell_weights(rows, settings, scratch)
    if settings.least_kept is not None:
        log_shares(weights, dimensions)
    weights = weights.drop("tokens")
    if carry:
        rows = measured(docs, dimensions, id_col, text_col, True, settings.topic_column)
    kept = ["row"] if carry else []
    return rows.join(weights, dimensions).select("doc_id", *dimensions, "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled"), *kept)
