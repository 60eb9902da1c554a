"""The indicator matrix in long form: any number of codes, none of them a column or a list on the driver.

Only known cells are rows. A missing cell holds the median of its code, so with values measured from that median it is zero: sums of
deviations and of their products over known cells alone are the sums over the whole completed matrix. The mean is never further from the
median than one standard deviation, so these sums lose no more than a digit against sums around the mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.operators.matrix import numbered
from terrascore.operators.quantiles import exact_quantiles
from terrascore.session import materialize

#: Parts of the code table when every entity, or every code, meets every code because the result has a row for each pair.
GRID_PARTS = 32
#: Most codes that are broadcast to meet every row.
BROADCAST_CODES = 10_000


def known_cells(entities: DataFrame, facts: DataFrame, pick: str = "earliest") -> DataFrame:
    """``entity_id, code, value``: per entity and code the earliest (or latest) value by year and fact id.

    A row with a null value stands for a code without a value there, so that no code is lost; facts of other entities count as such, with
    a null id. Facts without a code are left out.
    """
    order = F.when(F.col("value").isNotNull(), F.struct("year", "fact_id"))
    chosen = (F.min_by if pick == "earliest" else F.max_by)("value", order).cast("double").alias("value")
    cells = facts.filter(F.col("code").isNotNull()).groupBy("entity_id", "code").agg(chosen)
    ids = entities.select(F.col("entity_id").alias("_entity"))
    joined = cells.join(ids, F.col("entity_id") == F.col("_entity"), "left")
    return joined.select(F.col("_entity").alias("entity_id"), "code", F.when(F.col("_entity").isNotNull(), F.col("value")).alias("value"))


def code_profile(entities: DataFrame, cells: DataFrame) -> DataFrame:
    """``code, known, missing, missing_share, low, high``, one row per code from one aggregate."""
    n = entities.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = cells.groupBy("code").agg(F.count("value").alias("known"), F.min("value").alias("low"), F.max("value").alias("high"))
    return counted.withColumn("missing", n - F.col("known")).select(
        "code", "known", "missing", (F.col("missing") / F.nullif(n, F.lit(0))).alias("missing_share"), "low", "high"
    )


def dense(profile: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Codes whose share of missing values is at most ``max_missing``."""
    return profile.filter(F.col("missing_share") <= max_missing)


def with_medians(codes: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``median``, the exact median of the known values; null for a code without any."""
    found = exact_quantiles(cells.join(codes.select("code"), "code", "left_semi"), ["code"], "value", {"median": 0.5})
    return codes.join(found.select("code", "median"), "code", "left")


def deviations(cells: DataFrame, codes: DataFrame) -> DataFrame:
    """``entity_id, code, d``: known values of these codes measured from the median."""
    known = cells.filter(F.col("value").isNotNull()).join(codes.select("code", "median"), "code")
    return known.select("entity_id", "code", (F.col("value") - F.col("median")).alias("d"))


def _parted(codes: DataFrame) -> DataFrame:
    return codes.withColumn("_part", F.pmod(F.xxhash64("code"), F.lit(GRID_PARTS)))


def with_every_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Each row once per code: few codes go to the rows, many are joined part by part.

    The codes are stored first, so that their number is known and no plan takes the repeated rows for the smaller side.
    """
    codes = materialize(codes, "grid-codes")
    if codes.count() <= BROADCAST_CODES:
        return rows.crossJoin(F.broadcast(codes))
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_PARTS - 1).cast("bigint"))))
    return parts.join(_parted(codes).hint("shuffle_hash"), "_part").drop("_part")


def imputed_cells(entities: DataFrame, cells: DataFrame, codes: DataFrame) -> DataFrame:
    """``entity_id, code, value`` of the completed matrix: every entity with every code, the median where no value is known."""
    grid = with_every_code(entities.select("entity_id"), codes.select("code", "median"))
    known = cells.filter(F.col("value").isNotNull())
    return grid.join(known, ["entity_id", "code"], "left").select("entity_id", "code", F.coalesce("value", "median").alias("value"))


def _correlation(n: Column, xy: Column, x: Column, y: Column, xx: Column, yy: Column) -> Column:
    """Pearson correlation of sums, kept within [-1, 1]."""
    spread = F.sqrt(F.greatest(n * xx - x * x, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - y * y, F.lit(0.0)))
    r = (n * xy - x * y) / F.nullif(spread, F.lit(0.0))
    return F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))


def correlations(entities: DataFrame, cells: DataFrame, codes: DataFrame) -> DataFrame:
    """``code_a, code_b, r`` of the completed matrix for every pair of codes; constant codes give null.

    Known cells of one entity meet each other once per unordered pair, and their products are summed in the tasks before they are
    shuffled by pair. An entity has at most one cell per code, so no join key is larger than the code table.
    """
    moved = deviations(cells, codes)
    n = entities.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    own = moved.groupBy("code").agg(F.sum("d").alias("x"), F.sum(F.col("d") * F.col("d")).alias("xx"))
    own = codes.select("code", (F.col("low") < F.col("high")).alias("varies")).join(own, "code", "left")
    own = materialize(own.fillna(0.0, ["x", "xx"]), "code-sums")
    left = moved.filter("d <> 0").select("entity_id", F.col("code").alias("a"), F.col("d").alias("da"))
    right = moved.filter("d <> 0").select("entity_id", F.col("code").alias("b"), F.col("d").alias("db"))
    pairs = left.join(right, (left["entity_id"] == right["entity_id"]) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.sum(F.col("da") * F.col("db")).alias("xy"))
    first = own.select(F.col("code").alias("a"), F.col("x").alias("xa"), F.col("xx").alias("xxa"), F.col("varies").alias("va"))
    grid = with_every_code(first, own).filter(F.col("a") < F.col("code")).withColumnRenamed("code", "b")
    r = _correlation(n, F.coalesce("xy", F.lit(0.0)), F.col("xa"), F.col("x"), F.col("xxa"), F.col("xx"))
    found = grid.join(pairs, ["a", "b"], "left").select("a", "b", F.when(F.col("va") & F.col("varies"), r).alias("r"))
    both = F.array(F.struct(F.col("a").alias("code_a"), F.col("b").alias("code_b")), F.struct(F.col("b").alias("code_a"), F.col("a").alias("code_b")))
    diagonal = own.select(F.col("code").alias("code_a"), F.col("code").alias("code_b"), F.when(F.col("varies"), 1.0).alias("r"))
    return found.select(F.explode(both).alias("p"), "r").select("p.code_a", "p.code_b", "r").union(diagonal)


def top_codes(entities: DataFrame, cells: DataFrame, codes: DataFrame, size: str, n: int = 10) -> DataFrame:
    """``place, code, correlation``: the ``n`` codes most correlated (in absolute value) with the column ``size`` of the entities.

    Entities without a size are left out. Codes that are constant over the others come last.
    """
    sized = entities.filter(F.col(size).isNotNull()).select("entity_id", F.col(size).cast("double").alias("_size"))
    mean = sized.agg(F.avg("_size").alias("m")).scalar()
    sized = materialize(sized.withColumn("_size", F.col("_size") - mean), "sizes")
    total = sized.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum("_size"), F.lit(0.0)).alias("y"),
            F.coalesce(F.sum(F.col("_size") * F.col("_size")), F.lit(0.0)).alias("yy"), (F.min("_size") < F.max("_size")).alias("varies"),
        ).alias("t")
    ).scalar()
    d, y = F.col("d"), F.col("_size")
    sums = deviations(cells, codes).join(sized, "entity_id").groupBy("code").agg(
        F.count(F.lit(1)).alias("k"), F.sum(d).alias("x"), F.sum(d * d).alias("xx"), F.sum(d * y).alias("xy"), F.min(d).alias("low"), F.max(d).alias("high")
    )
    # with a missing cell the median, a deviation of zero, is one of the values
    low = F.when(F.col("k") < F.col("t.n"), F.least("low", F.lit(0.0))).otherwise(F.col("low"))
    high = F.when(F.col("k") < F.col("t.n"), F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))
    r = _correlation(F.col("t.n"), F.col("xy"), F.col("x"), F.col("t.y"), F.col("xx"), F.col("t.yy"))
    strength = codes.select("code").join(sums, "code", "left").withColumn("t", total)
    return numbered(strength.select("code", F.when((low < high) & F.col("t.varies"), F.abs(r)).alias("correlation")), n)


def mean_scaled(entities: DataFrame, cells: DataFrame, factors: DataFrame, out: str = "index_v1") -> DataFrame:
    """``entity_id`` and ``out``: mean of the min-max scaled factors of the completed matrix, times ten; null without factors.

    ``factors`` has ``code, low, high, median``. An entity starts from the medians and only its known values move it. Constant codes count zero.
    """

    def scaled(value: str) -> Column:
        return F.coalesce((F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0))

    start = factors.agg(F.struct(F.sum(scaled("median")).alias("at"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    known = cells.filter(F.col("value").isNotNull()).join(factors.select("code", "low", "high", "median"), "code")
    moves = known.groupBy("entity_id").agg(F.sum(scaled("value") - scaled("median")).alias("_move"))
    total = F.col("_s.at") + F.coalesce("_move", F.lit(0.0))
    joined = entities.select("entity_id").join(moves, "entity_id", "left").withColumn("_s", start)
    return joined.select("entity_id", (total / F.nullif(F.col("_s.n"), F.lit(0)) * 10).alias(out))
