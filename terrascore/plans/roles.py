"""Roles of the composite index, bound to the generated test tables.

A role is a frame with the columns its consumer expects; a deployment binds
its own tables the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.operators.climate import degree_days
from terrascore.operators.series import latest_value
from terrascore.session import materialize
from terrascore.sources.landing import FileRule
from terrascore.sources.tables import read_table

YEARS = (1996, 1997)
HALF_YEAR = ("1996-07-01", "1996-12-31")
INDEX_YEAR = 1996


@dataclass
class IndexRoles:
    """Inputs of the composite index."""

    settlements: DataFrame  # entity_id, entity_name, entity_type, region_id, territory_id
    regions: DataFrame  # region_id, region_name
    territories: DataFrame  # territory_id, territory_name
    attributes: DataFrame  # entity_id, is_zone, is_remote, is_special, is_suburb
    quality: DataFrame  # entity_id, quality_scaled
    market: DataFrame  # territory_id, market_access, year
    consumption: DataFrame  # entity_id, date, consumption
    access: DataFrame  # entity_id, access_scaled
    climate_monthly: DataFrame  # entity_id, year, month, temperature
    climate_yearly: DataFrame  # entity_id, year, degree_days
    mobility: DataFrame  # territory_label, year, mobility_km


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = scan(spark, sf_dir, "customer")
    nation = scan(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_name").alias("entity_name"),
        F.col("c_mktsegment").alias("entity_type"),
        F.col("n_regionkey").cast("int").alias("region_id"),
        F.col("c_nationkey").cast("string").alias("territory_id"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("territory_id"), F.col("n_name").alias("territory_name")
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four flags."""
    return scan(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        (F.col("c_nationkey") % 3 == 0).alias("is_zone"),
        (F.col("c_custkey") % 7 == 0).alias("is_remote"),
        (F.col("c_custkey") % 10 == 0).alias("is_special"),
        (F.col("c_custkey") % 4 == 1).alias("is_suburb"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), ((F.col("c_acctbal") + 1000) / 11000).alias("quality_scaled"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), ((F.col("c_custkey") * 17 % 101) / F.lit(100.0)).alias("access_scaled"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market access per territory."""
    return (
        scan(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").cast("string").alias("territory_id"))
        .agg(F.sum("s_acctbal").alias("market_access"))
        .withColumn("year", F.lit(INDEX_YEAR))
    )


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("consumption")
    )


def measurements(spark: SparkSession, sf_dir: str, years: tuple[int, ...] | None) -> DataFrame:
    """Temperature readings, cut to whole years by a range the Parquet scan can use."""
    rows = scan(spark, sf_dir, "lineitem").filter(F.col("l_suppkey").isNotNull())
    if years:
        rows = rows.filter(
            (F.col("l_shipdate") >= F.lit(f"{min(years)}-01-01").cast("date"))
            & (F.col("l_shipdate") < F.lit(f"{max(years) + 1}-01-01").cast("date"))
        )
    return rows


def climate_daily(spark: SparkSession, sf_dir: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """Daily sums per entity."""
    return (
        measurements(spark, sf_dir, years)
        .groupBy(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("total"), F.count("l_quantity").alias("readings"))
    )


def climate_tables(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Monthly temperatures and yearly degree-days; both read one stored table with a row per entity and month."""
    day = F.col("total") / F.col("readings") - 25
    months = daily.groupBy("entity_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        (F.sum("total") / F.sum("readings") - 25).alias("temperature"), F.sum(degree_days(day)).alias("degree_days")
    )
    months = materialize(months, "climate-months")
    return months.drop("degree_days"), months.groupBy("entity_id", "year").agg(F.sum("degree_days").alias("degree_days"))


def daily_means(daily: DataFrame) -> DataFrame:
    return daily.select("entity_id", "date", (F.col("total") / F.col("readings") - 25).alias("temperature"))


def mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "nation").select(
        F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("territory_label"),
        F.lit(INDEX_YEAR).alias("year"),
        (F.col("n_nationkey") * 3 % 11).cast("double").alias("mobility_km"),
    )


def index_roles(spark: SparkSession, sf_dir: str) -> IndexRoles:
    monthly, yearly = climate_tables(climate_daily(spark, sf_dir, YEARS))
    return IndexRoles(
        settlements=settlements(spark, sf_dir),
        regions=regions(spark, sf_dir),
        territories=territories(spark, sf_dir),
        attributes=attributes(spark, sf_dir),
        quality=quality(spark, sf_dir),
        market=market(spark, sf_dir),
        consumption=consumption(spark, sf_dir),
        access=access(spark, sf_dir),
        climate_monthly=monthly,
        climate_yearly=yearly,
        mobility=mobility(spark, sf_dir),
    )


def category_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean spending per territory and category.

    Orders are reduced per customer before the join, so a customer with a
    large share of all orders contributes one row per month and category.
    """
    per_customer = (
        scan(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("date"), F.col("o_orderpriority").alias("category"))
        .agg(F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("orders"))
    )
    owner = scan(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_nationkey").cast("string").alias("territory_id"))
    return (
        per_customer.join(owner, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("territory_id", "date", "category")
        .agg((F.sum("total") / F.sum("orders")).alias("consumption"))
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dictionary, stored so that its size is known."""
    return materialize(
        scan(spark, sf_dir, "orders")
        .select(F.col("o_orderpriority").alias("category_name"))
        .distinct()
        .select("category_name", F.concat(F.lit("Priority "), "category_name").alias("description")),
        "categories",
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, year, population`` from yearly order totals."""
    return (
        scan(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("population"))
    )


def indicator_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form facts: one row per order, its priority as the indicator code."""
    return scan(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"),
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderpriority").alias("code"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("value"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity attributes used by reports: region, type, zone flag and size (latest population)."""
    sized = latest_value(population(spark, sf_dir), "entity_id", "population").select("entity_id", "population")
    base = settlements(spark, sf_dir).join(regions(spark, sf_dir), "region_id")
    return base.select(
        "entity_id", "entity_name", "entity_type", "region_name", (F.col("territory_id").cast("int") % 3 == 0).alias("is_zone")
    ).join(sized, "entity_id", "left")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, entity_name, size, lat, lon``."""
    key = F.col("s_suppkey")
    return scan(spark, sf_dir, "supplier").select(
        key.alias("entity_id"),
        F.col("s_name").alias("entity_name"),
        F.col("s_acctbal").alias("size"),
        (F.lit(50.0) + (key * 37 % 300) / F.lit(10.0)).alias("lat"),
        (F.lit(30.0) + (key * 53 % 1500) / F.lit(10.0)).alias("lon"),
    )


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: many entities around few positions."""
    key = F.col("c_custkey")
    return scan(spark, sf_dir, "customer").select(
        key.alias("entity_id"),
        (F.lit(50.0) + (key * 29 % 290) / F.lit(10.0)).alias("lat"),
        (F.lit(30.0) + (key * 31 % 1490) / F.lit(10.0)).alias("lon"),
    )


def landing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing_from_events(scan(spark, sf_dir, "events"))


def landing_from_events(events: DataFrame) -> DataFrame:
    """Landing rows built from events: JSON lists and objects, CSV texts, bad payloads, unknown files."""
    shape = F.col("event_id") % 6
    user = F.col("user_id").cast("string")
    units = F.get_json_object("props", "$.k")
    money = F.format_string("%.2f", "value")
    number = F.col("event_id").cast("string")

    def text(template: str) -> Column:
        parts = {"{user}": user, "{units}": units, "{money}": money}
        pieces, rest = [], template
        while rest:
            at = min((rest.find(k) for k in parts if k in rest), default=-1)
            if at < 0:
                pieces.append(F.lit(rest))
                break
            key = next(k for k in parts if rest.startswith(k, at))
            pieces += [F.lit(rest[:at]), parts[key]]
            rest = rest[at + len(key) :]
        return F.concat(*pieces)

    many = '[{"Country":"U{user}","Units":"{units}","Gross Revenue (USD)":"${money}"},{"Country":"","Units":null},{"Country":"V{user}","Units":"n/a"}]'
    one = '{"country":" U{user} ","detail":{"units_sold":{units}},"gross_usd":{money}}'
    quoted = 'Sales report\\n\\nsep=,\\nCountry,Units,Gross Revenue (USD)\\n"Land, U{user}",{units},"$1,{units}.50"\\nNA,7,\\n\\n'.replace("\\n", "\n")
    shares = "Territory;Additional Revenue Share (USD)\nU{user};${money}\n"
    name = (
        F.when(shape == 0, F.concat(F.lit("sales_January_2024_"), number, F.lit(".csv")))
        .when(shape == 1, F.concat(F.lit("sales-"), number, F.lit(".csv")))
        .when(shape == 3, F.concat(F.lit("RevShare_MAY 2024_"), number, F.lit(".csv")))
        .when(shape == 4, F.concat(F.lit("sales_"), number, F.lit(".csv")))
        .when(shape == 5, F.concat(F.lit("notes_"), number, F.lit(".txt")))
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.lit("events").alias("source_name"),
        name.alias("file_name"),
        F.when(shape == 2, F.concat(F.lit("Sales march-2024 "), number, F.lit(".csv"))).alias("file_path"),
        F.col("event_type").alias("report_type"),
        F.when(F.col("event_id") % 12 == 1, F.lit(" 2023-12 ")).alias("report_period"),
        F.when(shape == 0, text(many)).when(shape == 1, text(one)).when(shape == 2, F.lit("oops{")).when(shape == 4, F.lit("42")).alias("payload"),
        F.when(shape == 2, text(quoted)).when(shape == 3, text(shares)).when(shape == 5, F.lit("free text")).alias("content"),
        F.col("ts").alias("loaded_at"),
        "value",
        units.cast("double").alias("units"),
        user.alias("user"),
    )


RULES = [
    FileRule("revenue_share_monthly", "revshare*.csv", sep=";", skip_rows=0),
    FileRule("sales_monthly", "sales*.csv", sep=",", skip_rows=3),
]
