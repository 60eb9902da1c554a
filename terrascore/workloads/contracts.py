"""Contract, rule, key and reconciliation checks over the test tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.operators import contracts, file_contracts
from terrascore.plans import platforms, roles
from terrascore.plans.composite import composite_index, recomputed_index
from terrascore.session import materialize, shared_folder
from terrascore.sources import ledger
from terrascore.workloads import register
from terrascore.workloads.index import SETTINGS, index_frame
from terrascore.workloads.sql import INDEX, SCORED, rnd

CONTRACTS = {
    "orders": contracts.Contract(
        ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"],
        ["o_orderstatus", "o_orderpriority"],
        {"o_orderkey": "int8", "o_custkey": "bigint", "o_orderdate": "timestamp"},
    ),
    "customer": contracts.Contract(["c_custkey", "c_name", "c_region", "c_acctbal"], ["c_phone"], {"c_acctbal": "numeric", "c_name": "varchar"}),
    "events": contracts.Contract(["event_id", "ts", "props"], ["user_id", "value", "event_type"], {"props": "jsonb", "ts": "timestamptz"}),
    "returns": contracts.Contract(["r_id", "r_reason"]),
}


@register(
    "contract_check",
    """SELECT 'orders' AS table_name, true AS valid, 1.0::DOUBLE AS score, '' AS missing, '' AS extra, '' AS mismatches, 0::BIGINT AS errors,
      count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) + count(*) FILTER (o_custkey IS NULL) AS empty_cells FROM orders
    UNION ALL SELECT 'customer', false, 0.765, 'c_region', 'c_mktsegment,c_nationkey', 'c_acctbal:numeric:double precision', 2, count(*), 0 FROM customer
    UNION ALL SELECT 'events', true, 0.88, '', '', 'props:jsonb:text,ts:timestamptz:timestamp without time zone', 2, count(*), 0 FROM events
    UNION ALL SELECT 'supplier', true, 1.0, '', '', '', 0, count(*), 0 FROM supplier
    UNION ALL SELECT 'returns', false, 0.0, 'r_id,r_reason', '', '', 1, 0, 0""",
)
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as stored: no layout is imposed
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "events", "supplier")}
    return contracts.contract_check_all(spark, tables | {"returns": None}, CONTRACTS)


STORED = ["orders", "customer", "events", "supplier"]
#: Contract type names of the types the SQL engine sees.
_TYPE_NAME = """CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'integer' WHEN data_type = 'VARCHAR' THEN 'text'
  WHEN data_type = 'DOUBLE' THEN 'double precision' WHEN data_type = 'TIMESTAMP' THEN 'timestamp without time zone'
  WHEN data_type = 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp with time zone' ELSE lower(data_type) END"""
_FOOTERS = "footers AS (SELECT table_name, column_name, " + _TYPE_NAME + " AS actual FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, column_type AS data_type FROM (DESCRIBE {t})" for t in STORED
) + "))"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in r) + ")" for r in rows)


ALL_CONTRACTS = CONTRACTS | platforms.CONTRACTS
_DECLARED = [(t, c, c in k.required, k.types.get(c)) for t, k in ALL_CONTRACTS.items() for c in [*k.required, *k.optional]]
_FAMILY = "CASE WHEN {0} LIKE '%numeric%' THEN 'numeric' ELSE coalesce((SELECT any_value(f) FROM families WHERE a = {0}), {0}) END"


def _footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(file_contracts.read_footers(spark, {t: f"{sf_dir}/{t}.parquet" for t in STORED}), "footers")


@register(
    "contract_issues",
    f"""WITH {_FOOTERS}, declared(table_name, column_name, required, expected) AS (VALUES {_values(_DECLARED)}),
    families(a, f) AS (VALUES {_values(list(contracts.FAMILY_OF.items()))}), contracted AS (SELECT DISTINCT table_name FROM declared)
    SELECT table_name, CASE WHEN required THEN 'error' ELSE 'info' END AS severity,
      CASE WHEN required THEN 'missing_column' ELSE 'missing_optional_column' END AS category, column_name, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual
    FROM declared d WHERE table_name IN (SELECT table_name FROM footers) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM footers)
    UNION ALL SELECT table_name, 'warning', 'extra_column', column_name, NULL, NULL FROM footers
    WHERE table_name IN (FROM contracted) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM declared)
    UNION ALL SELECT table_name, 'error', 'type_mismatch', column_name, expected, actual FROM footers JOIN declared USING (table_name, column_name)
    WHERE {_FAMILY.format('expected')} <> {_FAMILY.format('actual')}
    UNION ALL SELECT table_name, 'critical', 'existence', NULL, NULL, NULL FROM contracted WHERE table_name NOT IN (SELECT table_name FROM footers)
    UNION ALL SELECT DISTINCT table_name, 'warning', 'compatibility', NULL, NULL, NULL FROM footers WHERE table_name NOT IN (FROM contracted)""",
)
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue rows of the stored files against the contracts of these tables and of both report platforms."""
    return file_contracts.schema_issues(_footers(spark, sf_dir), ALL_CONTRACTS).drop("file")


EXPECTED = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "supplier": ["s_suppkey", "s_name", "s_region"]}


def _exact_sql(expected: dict[str, list[str]]) -> str:
    wanted = _values([(t, c) for t, cols in expected.items() for c in cols])
    return f"""{_FOOTERS}, wanted(table_name, column_name) AS (VALUES {wanted}),
    compared AS (SELECT coalesce(f.table_name, w.table_name) AS table_name, w.column_name AS w, f.column_name AS f
      FROM (SELECT * FROM footers WHERE table_name IN (SELECT table_name FROM wanted)) f FULL JOIN wanted w ON f.table_name = w.table_name AND f.column_name = w.column_name)"""


@register(
    "exact_columns",
    f"""WITH {_exact_sql(EXPECTED)} SELECT table_name, coalesce(string_agg(w, ',' ORDER BY w) FILTER (f IS NULL), '') AS missing,
      coalesce(string_agg(f, ',' ORDER BY f) FILTER (w IS NULL), '') AS extra, count(*) FILTER (f IS NULL OR w IS NULL) = 0 AS matches FROM compared GROUP BY 1""",
)
def exact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = file_contracts.exact_files(_footers(spark, sf_dir), EXPECTED)
    return out.select("table_name", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "matches")


CORE = {"events": ["event_id", "props"], "customer": ["c_custkey", "c_region"]}


@register(
    "relaxed_columns",
    f"""WITH {_exact_sql(CORE)} SELECT table_name, count(*) FILTER (f IS NULL) = 0 AS compatible, coalesce(string_agg(w, ',' ORDER BY w) FILTER (f IS NULL), '') AS missing,
      CASE WHEN bool_or(coalesce(f = 'batch_id', false)) THEN 'optimized' ELSE 'legacy' END AS layout FROM compared GROUP BY 1""",
)
def relaxed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = file_contracts.relaxed_files(_footers(spark, sf_dir), CORE)
    return out.select("table_name", "compatible", F.array_join("missing", ",").alias("missing"), "layout")


def _rules() -> dict:
    return {
        "payload has k": contracts.must_contain("props", ["k"]),
        "payload has country": contracts.must_contain("props", ["country"]),
        "type follows s*": contracts.should_follow("event_type", "s*"),
        "type is click": contracts.should_be("event_type", "click"),
    }


@register(
    "rule_check",
    """SELECT 'payload has k' AS rule, count(*) AS checked, 0::BIGINT AS violations FROM events
    UNION ALL SELECT 'payload has country', count(*), count(*) FROM events
    UNION ALL SELECT 'type follows s*', count(*), count(*) FILTER (event_type NOT LIKE 's%') FROM events
    UNION ALL SELECT 'type is click', count(*), count(*) FILTER (event_type <> 'click') FROM events""",
)
def rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.rule_check(roles.scan(spark, sf_dir, "events"), _rules())


@register(
    "rule_quarantine",
    """SELECT event_id, concat_ws(',', CASE WHEN NOT coalesce(json_exists(props, '$.k'), false) THEN 'payload has k' END,
      CASE WHEN NOT coalesce(json_exists(props, '$.country'), false) THEN 'payload has country' END,
      CASE WHEN event_type NOT LIKE 's%' THEN 'type follows s*' END, CASE WHEN event_type <> 'click' THEN 'type is click' END) AS broken FROM events""",
)
def rule_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contracts.quarantine(roles.scan(spark, sf_dir, "events"), _rules())
    return out.select("event_id", F.array_join("broken_rules", ",").alias("broken"))


@register(
    "unique_check",
    """SELECT o_custkey, o_orderpriority, count(*) AS occurrences FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
)
def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.unique_check(roles.scan(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@register(
    "fk_check",
    """SELECT l_partkey, count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.fk_check(roles.scan(spark, sf_dir, "lineitem"), "l_partkey", roles.scan(spark, sf_dir, "supplier"), "s_suppkey")


_TABLE = contracts.TableContract(
    "l1_revenue", {"customer": "bigint", "priority": "string", "period": "date", "amount": "decimal(18,2)", "status": "int"}, ("customer", "priority")
)
_MAPPING = contracts.FieldMapping(
    "shop", "l1_revenue", "orders", ("customer", "priority"), 3, {"customer": "o_custkey", "priority": "o_orderpriority", "period": "o_orderdate", "amount": "o_totalprice", "status": "o_orderstatus"}
)


@register(
    "apply_contract",
    """WITH last AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT o_custkey AS customer, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS period,
      CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(NULL AS INTEGER) AS status FROM last WHERE n = 1""",
)
def apply_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contracts.apply_contract(roles.scan(spark, sf_dir, "orders"), _TABLE, _MAPPING, ["o_orderdate", "o_orderkey"])
    return out.withColumn("amount", F.col("amount").cast("double"))


def _reconciled(stored: str, anew: str) -> str:
    columns = {"index_score": ("0.0001", "NULL"), "index_score_100": ("0.01", "100")}
    one = """SELECT '{c}' AS column_name, count(*) FILTER (a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL) AS compared,
      count(*) FILTER (b.entity_id IS NULL) AS only_stored, count(*) FILTER (a.entity_id IS NULL) AS only_recomputed,
      count(*) FILTER (abs(a.{c} - b.{c}) > {tol}) AS beyond, count(*) FILTER (a.entity_id IS NOT NULL AND a.{c} IS NULL) AS nulls,
      count(*) FILTER (a.{c} < 0 AND {top} IS NOT NULL OR a.{c} > {top}) AS out_of_range FROM stored a FULL JOIN anew b USING (entity_id)"""
    rows = " UNION ALL ".join(one.format(c=c, tol=tol, top=top) for c, (tol, top) in columns.items())
    return f"WITH stored AS ({stored}), anew AS ({anew}) {rows}"


_ANEW = f"{SCORED} SELECT entity_id, {rnd('score', 4)} AS index_score, {rnd('score * 100', 2)} AS index_score_100 FROM ranked"
_EARLIER = f"{INDEX} SELECT * FROM index_view".replace("1996-12-31", "1996-06-30").replace("1996-07-01", "1996-01-01")
TOLERANCES = {"index_score": 0.0001, "index_score_100": 0.01}


@register("reconcile", _reconciled(f"{INDEX} SELECT * FROM index_view", _ANEW))
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored view against one computed anew from the fact tables, before any rounding of components."""
    stored = materialize(index_frame(spark, sf_dir), "index")
    anew = recomputed_index(roles.index_roles(spark, sf_dir), SETTINGS)
    return contracts.reconcile(stored, anew, "entity_id", TOLERANCES, {"index_score_100": 100.0})


@register("reconcile_periods", _reconciled(_EARLIER, _ANEW))
def reconcile_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view stored for the first half of the year against the second half: what a stale view would show."""
    first_half = replace(SETTINGS, period=("1996-01-01", "1996-06-30"))
    stored = materialize(composite_index(roles.index_roles(spark, sf_dir), first_half), "index")
    anew = recomputed_index(roles.index_roles(spark, sf_dir), SETTINGS)
    return contracts.reconcile(stored, anew, "entity_id", TOLERANCES, {"index_score_100": 100.0})


@register(
    "watermark_advance",
    """SELECT event_type AS source_name, max(CAST(ts AS DATE)) AS watermark_date, 3::SMALLINT AS grace_days FROM events GROUP BY 1
    UNION ALL SELECT 'idle', DATE '2023-05-01', 3::SMALLINT""",
)
def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = roles.scan(spark, sf_dir, "events")
    idle = events.agg(F.lit("idle").alias("source_name"), F.lit("2023-05-01").cast("date").alias("watermark_date"))
    return contracts.watermark_advance(events, idle, 3, source="event_type", loaded="ts")


INCREMENT = """WITH marks AS (SELECT event_type, max(CAST(ts AS DATE)) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_type <> 'click' GROUP BY 1)
    SELECT event_id, event_type FROM events LEFT JOIN marks USING (event_type) WHERE mark IS NULL OR CAST(ts AS DATE) >= mark - 3"""


def _event_marks(events: DataFrame) -> DataFrame:
    seen = events.filter((F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") != "click"))
    return materialize(contracts.watermark_advance(seen, None, 3, source="event_type", loaded="ts"), "watermarks")


@register("incremental_filter", INCREMENT)
def incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = roles.scan(spark, sf_dir, "events")
    return contracts.incremental_filter(events, _event_marks(events), source="event_type", loaded="ts").select("event_id", "event_type")


@register("incremental_read", INCREMENT)
def incremental_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from files that landed by type and time: the ledger is entered, then only files that are due are opened."""
    events = roles.scan(spark, sf_dir, "events")
    landed = f"{shared_folder(spark)}/terrascore/landed-{uuid.uuid4().hex}"
    events.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "event_type", "ts").write.parquet(f"{landed}/files")
    entries = ledger.update_ledger(spark, f"{landed}/files", f"{landed}/ledger", events.schema, source="event_type", loaded="ts")
    out = ledger.incremental_read(spark, f"{landed}/files", entries, _event_marks(events), events.schema, source="event_type", loaded="ts")
    return out.select("event_id", "event_type")
