"""Landing scans, payload parsing, curated loads and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.text import numify, period_from_name, to_number
from terrascore.operators import curated
from terrascore.plans import curation, roles
from terrascore.session import materialize, shared_folder
from terrascore.sources import landing
from terrascore.sources.csv_lines import csv_rows, file_lines, text_lines
from terrascore.sources.tables import write_csv
from terrascore.workloads import register

L0 = """
l0 AS (
  SELECT event_id AS id, event_id % 6 AS shape, 'U' || user_id AS land, 'V' || user_id AS land2, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS units,
         round(value, 2) AS money, ts AS loaded_at, event_type,
         CASE event_id % 6 WHEN 0 THEN 'sales_January_2024_' || event_id || '.csv' WHEN 1 THEN 'sales-' || event_id || '.csv'
           WHEN 2 THEN 'Sales march-2024 ' || event_id || '.csv' WHEN 3 THEN 'RevShare_MAY 2024_' || event_id || '.csv'
           WHEN 4 THEN 'sales_' || event_id || '.csv' ELSE 'notes_' || event_id || '.txt' END AS source_file,
         CASE event_id % 6 WHEN 0 THEN '2024-01' WHEN 2 THEN '2024-03' WHEN 3 THEN '2024-05'
           ELSE CASE WHEN event_id % 12 = 1 THEN '2023-12' ELSE 'unknown' END END AS report_period
  FROM events
),
sales AS (
  SELECT id, report_period, land AS country, units, money AS gross, source_file FROM l0 WHERE shape IN (0, 1)
  UNION ALL SELECT id, report_period, land2, NULL, NULL, source_file FROM l0 WHERE shape = 0
  UNION ALL SELECT id, report_period, 'Land, ' || land, units, CAST('1' || CAST(units AS INT) || '.50' AS DOUBLE), source_file FROM l0 WHERE shape = 2
  UNION ALL SELECT id, report_period, NULL, 7, NULL, source_file FROM l0 WHERE shape = 2
),
revenue AS (SELECT id, report_period, land AS country, money AS share, source_file FROM l0 WHERE shape = 3)"""

_SALES = "SELECT id AS l0_id, 'events' AS source_name, report_period, country, units, gross AS gross_revenue_usd, source_file FROM sales"
_REVENUE = "SELECT id AS l0_id, 'events' AS source_name, report_period, country, share AS additional_revenue_share_usd, source_file FROM revenue"


def _batch(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> curation.CuratedBatch:
    l0 = landing.incremental_scan(roles.landing_rows(spark, sf_dir), start, end)
    return curation.curate(l0, roles.RULES)


@register(
    "l0_incremental_scan",
    """SELECT event_id AS id, ts AS loaded_at, event_type AS report_type FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 500""",
)
def l0_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landing.incremental_scan(roles.landing_rows(spark, sf_dir), "2024-01-10", "2024-01-20", limit=500)
    return out.select("id", "loaded_at", "report_type")


@register(
    "payload_explode",
    f"""WITH {L0} SELECT id, 0 AS record_no, 'k' AS key, CAST(CAST(units AS INT) AS VARCHAR) AS value FROM l0""",
)
def payload_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = landing.payload_records(roles.scan(spark, sf_dir, "events"), F.col("props"), "records")
    rows = landing.explode_records(parsed.select(F.col("event_id").alias("id"), "records"))
    return rows.select("id", "record_no", F.explode("record").alias("key", "value"))


@register(
    "payload_flatten",
    f"""WITH {L0}, cells AS (
      SELECT id, 0 AS record_no, 'country' AS key, ' ' || land || ' ' AS value FROM l0 WHERE shape = 1
      UNION ALL SELECT id, 0, 'detail.units_sold', CAST(CAST(units AS INT) AS VARCHAR) FROM l0 WHERE shape = 1
      UNION ALL SELECT id, 0, 'gross_usd', CAST(money AS VARCHAR) FROM l0 WHERE shape = 1
      UNION ALL SELECT id, 0, 'Country', land FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 0, 'Units', CAST(CAST(units AS INT) AS VARCHAR) FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 0, 'Gross Revenue (USD)', '$' || printf('%.2f', money) FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 1, 'Country', '' FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 1, 'Units', NULL FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 2, 'Country', land2 FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 2, 'Units', 'n/a' FROM l0 WHERE shape = 0)
    SELECT * FROM cells""",
)
def payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = landing.payload_records(roles.landing_rows(spark, sf_dir), F.col("payload"), "records")
    return landing.explode_records(parsed).select("id", "record_no", F.explode("record").alias("key", "value"))


@register(
    "content_csv_explode",
    f"""WITH {L0} SELECT id, 0 AS record_no, 'Country' AS key, 'Land, ' || land AS value FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 0, 'Units', CAST(CAST(units AS INT) AS VARCHAR) FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 0, 'Gross Revenue (USD)', '$1,' || CAST(units AS INT) || '.50' FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 1, 'Country', NULL FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 1, 'Units', '7' FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 1, 'Gross Revenue (USD)', NULL FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 0, 'Territory', land FROM l0 WHERE shape = 3
    UNION ALL SELECT id, 0, 'Additional Revenue Share (USD)', '$' || printf('%.2f', money) FROM l0 WHERE shape = 3""",
)
def content_csv_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landing.match_rule(roles.landing_rows(spark, sf_dir).filter(F.col("content").isNotNull()), roles.RULES)
    parsed = landing.with_records(rows.filter(F.col("rule").isNotNull()))
    return landing.explode_records(parsed).select("id", "record_no", F.explode("record").alias("key", "value"))


@register(
    "csv_text_lines",
    f"""WITH {L0} SELECT id, 0 AS record_no, 'Land, ' || land AS first, CAST(CAST(units AS INT) AS VARCHAR) AS second FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 1, NULL, '7' FROM l0 WHERE shape = 2
    UNION ALL SELECT id, 0, land, '$' || printf('%.2f', money) FROM l0 WHERE shape = 3""",
)
def csv_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV texts of the landing table by lines."""
    ruled = landing.match_rule(roles.landing_rows(spark, sf_dir).filter(F.col("content").isNotNull()), roles.RULES).filter(F.col("rule").isNotNull())
    rows = csv_rows(text_lines(ruled, "id", F.col("content"), F.col("rule")))
    cell = F.map_values("record")
    return rows.select(F.col("file").alias("id"), F.col("record_no").cast("int").alias("record_no"), F.get(cell, F.lit(0)).alias("first"), F.get(cell, F.lit(1)).alias("second"))


@register(
    "csv_file_lines",
    """SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name || chr(10) || '"' || c_mktsegment || '", no. ' || c_custkey AS note, CAST(c_nationkey AS VARCHAR) AS nation
    FROM customer""",
)
def csv_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through CSV files with quotes, separators and line breaks in a cell, read back by lines."""
    path = f"{shared_folder(spark)}/terrascore/csv-{uuid.uuid4().hex}"
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", no. '), F.col("c_custkey").cast("string"))
    write_csv(roles.scan(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), "c_nationkey"), path)
    rows = csv_rows(file_lines(spark, path, [landing.FileRule("customers", "*.csv", skip_rows=0)]))
    return rows.select(*[F.col("record")[c].alias(name) for c, name in (("c_custkey", "custkey"), ("note", "note"), ("c_nationkey", "nation"))])


@register(
    "csv_preface",
    f"WITH {L0} SELECT id, CASE shape WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 5 THEN 1 END AS preface FROM l0 WHERE shape IN (2, 3, 5)",
)
def csv_preface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.landing_rows(spark, sf_dir).filter(F.col("content").isNotNull())
    return rows.select("id", landing.preface_rows(F.col("content")).alias("preface"))


@register(
    "match_rule",
    f"""WITH {L0} SELECT id, source_file, CASE WHEN shape = 3 THEN 'revenue_share_monthly' WHEN shape < 5 THEN 'sales_monthly' END AS rule_id,
      CASE WHEN shape = 3 THEN 'revenue' WHEN shape < 5 THEN 'sales' END AS target FROM l0""",
)
def match_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landing.match_rule(roles.landing_rows(spark, sf_dir), roles.RULES)
    return out.select("id", "source_file", "rule.rule_id", "rule.target")


@register("period_from_name", f"WITH {L0} SELECT id, report_period AS period FROM l0")
def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = landing.match_rule(roles.landing_rows(spark, sf_dir), roles.RULES)
    return rows.select("id", period_from_name(F.col("source_file"), F.col("report_period")).alias("period"))


@register(
    "to_number",
    """SELECT event_id AS id, value AS parsed, CASE WHEN event_id % 3 = 0 THEN value + 1000 END AS thousands, CAST(NULL AS DOUBLE) AS failed FROM events""",
)
def number(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = roles.scan(spark, sf_dir, "events")
    money = F.concat(F.lit(" $"), F.col("value").cast("string"), F.lit(" "))
    thousands = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("$"), F.format_number(F.col("value") + 1000, 2)))
    return events.select(
        F.col("event_id").alias("id"),
        to_number(money).alias("parsed"),
        to_number(thousands).alias("thousands"),
        to_number(F.concat("event_type", F.col("value").cast("string"))).alias("failed"),
    )


@register("numify", "SELECT event_id AS id, -value AS parsed FROM events")
def lenient_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("event_type", F.lit(": USD -"), F.col("value").cast("string"), F.lit(" net"))
    return roles.scan(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numify(text).alias("parsed"))


@register("map_sales", f"WITH {L0} {_SALES}")
def map_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).sales.drop("record_no")


@register("map_revenue_share", f"WITH {L0} {_REVENUE}")
def map_revenue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).revenue.drop("record_no")


@register("l0_to_l1", f"WITH {L0} {_SALES}")
def l0_to_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping loads into one table; the overlap changes nothing."""
    first = curation.upsert_curated(None, _batch(spark, sf_dir, end="2024-01-20").sales)
    return curation.upsert_curated(materialize(first, "l1-sales"), _batch(spark, sf_dir, start="2024-01-10").sales)


@register("l0_to_l1_revenue", f"WITH {L0} {_REVENUE}")
def l0_to_l1_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = curation.upsert_curated(None, _batch(spark, sf_dir, end="2024-01-20").revenue)
    return curation.upsert_curated(materialize(first, "l1-revenue"), _batch(spark, sf_dir, start="2024-01-10").revenue)


@register(
    "l0_load_stats",
    f"""WITH {L0} SELECT count(*) AS l0_read, count(*) FILTER (shape = 5) AS no_rule, count(*) FILTER (shape = 4) AS empty_df,
      (SELECT count(*) FROM sales) AS sales_rows, (SELECT count(*) FROM revenue) AS rev_rows,
      (SELECT count(*) FROM (SELECT DISTINCT id, source_file, country, report_period FROM sales)) AS l1_sales_upserted,
      (SELECT count(*) FROM (SELECT DISTINCT id, source_file, country, report_period FROM revenue)) AS l1_revenue_upserted FROM l0""",
)
def l0_load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).stats()


@register(
    "upsert_counts",
    f"""WITH {L0}, keys AS (SELECT id, min(loaded_at) AS landed FROM revenue JOIN l0 USING (id) GROUP BY id)
    SELECT count(*) FILTER (landed >= TIMESTAMP '2024-01-20') AS inserted, count(*) FILTER (landed < TIMESTAMP '2024-01-20') AS updated
    FROM keys WHERE landed >= TIMESTAMP '2024-01-10'""",
)
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of ten days and more over a table that already holds the first of them."""
    stored = materialize(_batch(spark, sf_dir, end="2024-01-20").revenue, "l1-revenue")
    return curated.upsert_counts(stored, _batch(spark, sf_dir, start="2024-01-10").revenue)


_ROLES = f"""{L0}, inferred AS (
  SELECT id, 'sales' AS kind, 'country' AS role, CASE shape WHEN 1 THEN 'country' ELSE 'Country' END AS column_name FROM l0 WHERE shape IN (0, 1, 2)
  UNION ALL SELECT id, 'sales', 'units', CASE shape WHEN 1 THEN 'detail.units_sold' ELSE 'Units' END FROM l0 WHERE shape IN (0, 1, 2)
  UNION ALL SELECT id, 'sales', 'revenue', CASE shape WHEN 1 THEN 'gross_usd' ELSE 'Gross Revenue (USD)' END FROM l0 WHERE shape IN (0, 1, 2))"""


@register("infer_roles", f"WITH {_ROLES} SELECT * FROM inferred")
def infer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curation.profile(roles.landing_rows(spark, sf_dir))
    return out.select("id", "kind", F.explode("roles").alias("role", "column_name"))


_WON = f"""{_ROLES}, counted AS (SELECT kind, role, column_name, count(*) AS votes FROM inferred GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY kind, role ORDER BY votes DESC, column_name) AS n FROM counted)"""


@register("column_role_votes", f"WITH {_WON} SELECT kind, role, column_name, votes FROM won WHERE n = 1")
def column_role_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.role_votes(curation.profile(roles.landing_rows(spark, sf_dir)))


@register(
    "l0_profile",
    f"""WITH {_WON} SELECT kind, 'l1_gaming_sales' AS target_table,
      CASE role WHEN 'country' THEN 'country_name' WHEN 'units' THEN 'units_sold' ELSE 'net_revenue_usd' END AS field,
      CASE role WHEN 'country' THEN 'string' ELSE 'double' END AS field_type, column_name AS source_column FROM won WHERE n = 1""",
)
def l0_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.suggest_mapping(curated.role_votes(curation.profile(roles.landing_rows(spark, sf_dir))))


@register(
    "role_examples",
    f"""WITH {L0}, cells AS (
      SELECT id, 0 AS n, 'country' AS role, CASE shape WHEN 0 THEN land WHEN 1 THEN ' ' || land || ' ' ELSE 'Land, ' || land END AS example FROM l0 WHERE shape < 3
      UNION ALL SELECT id, 1, 'country', '' FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 2, 'country', land2 FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 0, 'units', CAST(CAST(units AS INT) AS VARCHAR) FROM l0 WHERE shape < 3
      UNION ALL SELECT id, 1, 'units', '7' FROM l0 WHERE shape = 2
      UNION ALL SELECT id, 2, 'units', 'n/a' FROM l0 WHERE shape = 0
      UNION ALL SELECT id, 0, 'revenue', CASE shape WHEN 0 THEN '$' || printf('%.2f', money) WHEN 1 THEN printf('%.2f', money) ELSE '$1,' || CAST(units AS INT) || '.50' END FROM l0 WHERE shape < 3),
    placed AS (SELECT 'sales' AS kind, role, row_number() OVER (PARTITION BY role ORDER BY id, n) AS place, example FROM cells)
    SELECT * FROM placed WHERE place <= 3""",
)
def role_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.role_examples(curation.profile(roles.landing_rows(spark, sf_dir)))
