"""Indicator matrix: pivot, missing values, imputation, factors, index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType

from terrascore.functions.numbers import safe_corr
from terrascore.operators.quantiles import exact_quantiles
from terrascore.operators.scaling import minmax_scale

def indicator_codes(facts: DataFrame, code: str = "code") -> list[str]:
    """The distinct indicator codes, which become the column names of the matrix."""
    return sorted(r[0] for r in facts.select(code).filter(F.col(code).isNotNull()).distinct().collect())


def numeric_columns(df: DataFrame, metadata: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns that are not metadata; read from the schema alone."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in metadata]


def indicator_pivot(facts: DataFrame, codes: Sequence[str], pick: str = "earliest") -> DataFrame:
    """Entity x code matrix; of several values the earliest (or latest) by year and fact id."""
    order = F.struct("year", "fact_id")
    chosen = (F.min_by if pick == "earliest" else F.max_by)("value", order)
    return facts.filter(F.col("value").isNotNull()).groupBy("entity_id").pivot("code", list(codes)).agg(chosen)


def to_long(wide: DataFrame, codes: Sequence[str], keep: Sequence[str] = ("entity_id",), value: str = "value") -> DataFrame:
    return wide.unpivot(list(keep), list(codes), "code", value)


def missing_profile(wide: DataFrame, codes: Sequence[str]) -> DataFrame:
    """``code, missing, missing_share`` from one aggregate over the matrix."""
    counts = wide.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in codes])
    return counts.unpivot(["n"], list(codes), "code", "missing").select(
        "code", "missing", (F.col("missing") / F.nullif(F.col("n"), F.lit(0))).alias("missing_share")
    )


def dense_codes(wide: DataFrame, codes: Sequence[str], max_missing: float = 0.5) -> list[str]:
    """Codes whose share of missing values is at most ``max_missing``."""
    kept = missing_profile(wide, codes).filter(F.col("missing_share") <= max_missing).select("code")
    return sorted(r[0] for r in kept.collect())


def median_impute(wide: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Replace nulls by the median of their column."""
    if not codes:
        return wide
    medians = exact_quantiles(to_long(wide, codes), ["code"], "value", {"median": 0.5})
    row = medians.agg(F.struct(*[F.max(F.when(F.col("code") == c, F.col("median"))).alias(c) for c in codes]).alias("m")).scalar()
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.col("_medians")[c]) for c in codes}
    return wide.withColumn("_medians", row).withColumns(filled).drop("_medians")


def correlation_matrix(wide: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as ``code_a, code_b, r``.

    Only the columns x columns matrix reaches the driver. Constant columns give null.
    """
    spark = wide.sparkSession
    vectors = VectorAssembler(inputCols=list(codes), outputCol="v").transform(wide.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in codes]))
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    fixed = {c for c, r in zip(codes, wide.agg(*[(F.min(f"`{c}`") == F.max(f"`{c}`")).alias(c) for c in codes]).head()) if r}
    rows = [
        (a, b, None if a in fixed or b in fixed else float(matrix[i, j]))
        for i, a in enumerate(codes)
        for j, b in enumerate(codes)
    ]
    schema = StructType([StructField("code_a", StringType()), StructField("code_b", StringType()), StructField("r", DoubleType())])
    return spark.createDataFrame(rows, schema)


def top_factors(wide: DataFrame, codes: Sequence[str], size: str, n: int = 10) -> DataFrame:
    """The ``n`` codes most correlated (in absolute value) with ``size``, ranked."""
    long = to_long(wide.filter(F.col(size).isNotNull()), codes, keep=("entity_id", size))
    strength = long.groupBy("code").agg(F.abs(safe_corr(F.col("value"), F.col(size))).alias("correlation"))
    return numbered(strength, n)


def numbered(strength: DataFrame, n: int) -> DataFrame:
    """``place, code, correlation`` of the ``n`` strongest codes, nulls last, ties by code."""
    best = strength.orderBy(F.col("correlation").desc_nulls_last(), "code").limit(n)
    rows = F.sort_array(F.collect_list(F.struct(F.col("correlation").isNull().alias("unknown"), (-F.col("correlation")).alias("minus"), "code")))
    # at most n rows are left, so numbering them is a bounded list
    return best.agg(rows.alias("rows")).select(F.posexplode("rows")).select(
        (F.col("pos") + 1).cast("bigint").alias("place"), F.col("col.code").alias("code"), (-F.col("col.minus")).alias("correlation")
    )


def index_v1(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``entity_id, index_v1``: mean of the min-max scaled factors, times ten."""
    scaled = minmax_scale(wide, list(factors), on_constant=0.0)
    total = F.lit(0.0)
    for c in factors:
        total = total + F.col(f"`{c}_scaled`")
    return scaled.select("entity_id", (total / F.lit(float(len(factors))) * 10).alias("index_v1"))


def block_score(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Weighted mean of indicator values per entity and block; a missing weight counts one.

    Values are summed per entity and code before the small link table multiplies them.
    """
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    sums = facts.filter(F.col("value").isNotNull()).groupBy("entity_id", "code").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return (
        sums.join(links, "code")
        .groupBy("entity_id", "block")
        .agg((F.sum(F.col("total") * weight) / F.nullif(F.sum(F.col("n") * weight), F.lit(0.0))).alias("block_score"))
    )
