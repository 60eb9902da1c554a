"""Records to typed curated rows: column picking, mapping, role inference, votes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.functions.text import period_from_name, to_number
from terrascore.operators.ranking import top_per_group

# Accepted column names and name fragments of the source reports.
COUNTRY_NAMES = ["Country", "country"]
COUNTRY_TOKENS = ["country", "region", "territory"]
UNITS_NAMES = ["Units", "units", "Quantity", "units_sold", "qty", "quantity"]
GROSS_NAMES = ["Gross Revenue (USD)", "Gross_Revenue_USD", "GrossRevenueUSD", "Gross", "gross_usd", "revenue_usd"]
GROSS_MUST = ["gross", "revenue", "usd"]
SHARE_NAMES = ["Additional Revenue Share (USD)", "Additional_Revenue_Share_USD", "Revenue Share (USD)", "rev_share_usd", "revenue_share_usd"]
SHARE_MUST = ["share", "usd", "revenue"]
NUMBER_TOKENS = ["gross", "revenue", "amount", "usd", "net", "sales", "units", "qty", "quantity", "share"]
SALES_HINTS = {
    "country": ["country", "region", "territory", "market"],
    "units": ["units", "unit", "qty", "quantity", "net_units"],
    "revenue": ["revenue", "gross", "net", "sales", "usd", "amount"],
}
SHARE_HINTS = {
    "country": ["country", "region", "territory", "market"],
    "share": ["revenue_share", "rev_share", "additional", "bonus", "usd", "amount", "total"],
}


@dataclass(frozen=True)
class FieldPick:
    """Where a field comes from: exact names first, then name fragments."""

    names: Sequence[str]
    tokens: Sequence[str]
    must: Sequence[str] = ()


SALES_FIELDS = {"units": FieldPick(UNITS_NAMES, NUMBER_TOKENS), "gross_revenue_usd": FieldPick(GROSS_NAMES, NUMBER_TOKENS, GROSS_MUST)}
REVENUE_FIELDS = {"additional_revenue_share_usd": FieldPick(SHARE_NAMES, NUMBER_TOKENS, SHARE_MUST)}
COUNTRY = FieldPick(COUNTRY_NAMES, COUNTRY_TOKENS)
KEYS = ["l0_id", "source_file", "country", "report_period"]


def _has_any(name: Column, tokens: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.contains(F.lower(name), F.lit(t))
    return hit


def pick_column(columns: Column, pick: FieldPick) -> Column:
    """Name of the column that feeds a field, decided once per landing row."""
    exact = [F.when(F.array_contains(columns, n), F.lit(n)) for n in pick.names]
    fits = F.filter(columns, lambda c: _has_any(c, pick.tokens) & (_has_any(c, pick.must) if pick.must else F.lit(True)))
    return F.coalesce(*exact, F.get(fits, F.lit(0)))


def map_fields(rows: DataFrame, numbers: Mapping[str, FieldPick]) -> DataFrame:
    """Explode records into typed rows; a record without country and numbers is dropped."""
    picked = rows.select(
        F.col("id").alias("l0_id"),
        "source_name",
        period_from_name(F.col("source_file"), F.col("report_period")).alias("report_period"),
        "source_file",
        pick_column(F.col("columns"), COUNTRY).alias("_country"),
        *[pick_column(F.col("columns"), p).alias(f"_{f}") for f, p in numbers.items()],
        F.posexplode("records").alias("record_no", "_record"),
    )
    country = F.nullif(F.trim(F.try_element_at("_record", "_country")), F.lit(""))
    values = {f: to_number(F.try_element_at(F.col("_record"), F.col(f"_{f}"))) for f in numbers}
    typed = picked.select(
        "l0_id", "source_name", "report_period", country.alias("country"), *[x.alias(f) for f, x in values.items()], "source_file", "record_no"
    )
    return typed.filter(F.coalesce("country", *[F.col(f).cast("string") for f in numbers]).isNotNull())


def load_outcome() -> Column:
    """What became of a landing row."""
    return (
        F.when(F.col("rule").isNull(), "no_rule")
        .when(F.col("records").isNull() | (F.size("records") == 0), "empty")
        .otherwise(F.col("rule.target"))
    )


def load_stats(rows: DataFrame, sales: DataFrame, revenue: DataFrame) -> DataFrame:
    """One row: landing rows read, without rule, empty; curated rows per target, and how many of them an upsert writes, one per key."""
    written = {"l1_sales_upserted": sales, "l1_revenue_upserted": revenue}
    counts = {"sales_rows": sales, "rev_rows": revenue} | {name: df.select(*KEYS).distinct() for name, df in written.items()}
    out = rows.withColumn("_outcome", load_outcome()).agg(
        F.count(F.lit(1)).alias("l0_read"),
        F.count_if(F.col("_outcome") == "no_rule").alias("no_rule"),
        F.count_if(F.col("_outcome") == "empty").alias("empty_df"),
    )
    return out.withColumns({name: df.agg(F.count(F.lit(1))).scalar() for name, df in counts.items()})


def upsert_counts(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row ``inserted, updated``: what an upsert of the batch does to the target; null is a key value of its own."""
    keys = batch.select(*KEYS).distinct()
    met = keys.alias("b").join(target.select(*KEYS).distinct().withColumn("_there", F.lit(True)).alias("t"), [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in KEYS], "left")
    return met.agg(F.count_if(F.col("_there").isNull()).alias("inserted"), F.count_if(F.col("_there").isNotNull()).alias("updated"))


# -- profiling ----------------------------------------------------------------------


def _hinted(columns: Column, hints: Sequence[str]) -> Column:
    """First column (by hint order, then column order) whose name contains a hint."""
    return F.coalesce(*[F.get(F.filter(columns, lambda c: _has_any(c, [h])), F.lit(0)) for h in hints])


def infer_roles(rows: DataFrame) -> DataFrame:
    """Add ``kind`` and ``roles`` (role -> column) for rows with records."""
    columns = F.col("columns")
    picked = rows.filter(F.size("records") > 0).withColumns(
        {
            "_country": _hinted(columns, SALES_HINTS["country"]),
            "_units": _hinted(columns, SALES_HINTS["units"]),
            "_revenue": _hinted(columns, SALES_HINTS["revenue"]),
            "_share": _hinted(columns, SHARE_HINTS["share"]),
        }
    )
    is_share = F.col("_share").isNotNull() & F.col("_units").isNull()
    share_roles = F.create_map(F.lit("country"), F.col("_country"), F.lit("share"), F.col("_share"))
    sales_roles = F.create_map(F.lit("country"), F.col("_country"), F.lit("units"), F.col("_units"), F.lit("revenue"), F.col("_revenue"))
    out = picked.withColumn("kind", F.when(is_share, "revenue_share").otherwise("sales"))
    return out.withColumn("roles", F.when(is_share, share_roles).otherwise(sales_roles)).drop("_country", "_units", "_revenue", "_share")


def role_votes(inferred: DataFrame) -> DataFrame:
    """``kind, role, column_name, votes``: the most frequent column per role, ties by name."""
    votes = (
        inferred.select("kind", F.explode("roles").alias("role", "column_name"))
        .filter(F.col("column_name").isNotNull())
        .groupBy("kind", "role", "column_name")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    best = F.min(F.struct((-F.col("votes")).alias("minus"), "column_name")).alias("b")
    return votes.groupBy("kind", "role").agg(best).select("kind", "role", "b.column_name", (-F.col("b.minus")).alias("votes"))


def role_examples(inferred: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` non-null values per kind and role, in load order."""
    cells = (
        inferred.select("id", "kind", F.explode("roles").alias("role", "_column"), "records")
        .filter(F.col("_column").isNotNull())
        .select("id", "kind", "role", F.posexplode(F.transform("records", lambda r: F.try_element_at(r, F.col("_column")))).alias("record_no", "example"))
        .filter(F.col("example").isNotNull())
        .withColumn("_group", F.concat_ws("/", "kind", "role"))
    )
    return top_per_group(cells, "_group", [F.col("id"), F.col("record_no")], n).select("kind", "role", "place", "example")


# Curated field and type per role.
TARGET_FIELDS = {
    ("sales", "country"): ("country_name", "string"),
    ("sales", "units"): ("units_sold", "double"),
    ("sales", "revenue"): ("net_revenue_usd", "double"),
    ("revenue_share", "country"): ("country_name", "string"),
    ("revenue_share", "share"): ("revenue_share_usd", "double"),
}
TARGET_TABLES = {"sales": "l1_gaming_sales", "revenue_share": "l1_gaming_revenue_share"}


def suggest_mapping(votes: DataFrame) -> DataFrame:
    """Mapping skeleton: target table, field, its type and the winning source column."""
    key = F.concat_ws("/", "kind", "role")
    fields = F.create_map(*[F.lit(x) for (k, r), (f, _) in TARGET_FIELDS.items() for x in (f"{k}/{r}", f)])
    types = F.create_map(*[F.lit(x) for (k, r), (_, t) in TARGET_FIELDS.items() for x in (f"{k}/{r}", t)])
    tables = F.create_map(*[F.lit(x) for k, t in TARGET_TABLES.items() for x in (k, t)])
    return votes.select(
        "kind",
        F.try_element_at(tables, F.col("kind")).alias("target_table"),
        F.try_element_at(fields, key).alias("field"),
        F.try_element_at(types, key).alias("field_type"),
        F.col("column_name").alias("source_column"),
    )
