from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrascore.operators import changes, contracts
from terrascore.operators.contracts import Contract, contract_check
from terrascore.plans.platforms import CONTRACTS, CORE_COLUMNS
from terrascore.sources import tables

KV = "k string, part int, v double, seen date"


def test_upsert_null_keys_first_seen_and_stamp(spark):
    target = spark.sql("select * from values ('a', 1, 1.0D, date'2020-01-01', cast(null as date)), (null, 1, 2.0D, date'2020-01-01', null), ('c', 1, 3.0D, date'2020-01-01', null) as t(k, part, v, seen, changed)")
    batch = spark.sql("select * from values ('a', 1, 9.0D, date'2021-01-01', 1), ('a', 1, 8.0D, date'2021-01-02', 2), (null, 1, 2.0D, date'2021-01-01', 1), ('d', 1, 4.0D, date'2021-01-01', 1) as t(k, part, v, seen, n)")
    day = F.lit("2022-02-02").cast("date")
    out = changes.upsert_snapshot(target, batch, ["k", "part"], ["n"], keep_first=["seen"], touched=("changed", day))
    rows = {r.k: (r.v, str(r.seen), str(r.changed)) for r in out.collect()}
    assert rows == {
        "a": (8.0, "2020-01-01", "2022-02-02"),
        None: (2.0, "2020-01-01", "None"),
        "c": (3.0, "2020-01-01", "None"),
        "d": (4.0, "2021-01-01", "2022-02-02"),
    }
    again = changes.upsert_snapshot(out, batch, ["k", "part"], ["n"], keep_first=["seen"], touched=("changed", F.lit("2023-03-03").cast("date")))
    assert {r.k: (r.v, str(r.seen), str(r.changed)) for r in again.collect()} == rows


def test_insert_ignore_keeps_known_rows(spark):
    target = spark.createDataFrame([("a", 1.0), (None, 5.0)], "k string, v double")
    batch = spark.createDataFrame([("a", 2.0, 1), ("b", 9.0, 3), ("b", 3.0, 2), (None, 6.0, 4)], "k string, v double, n int")
    assert {(r.k, r.v) for r in changes.insert_ignore(target, batch, ["k"], ["n"]).collect()} == {("a", 1.0), (None, 5.0), ("b", 3.0)}


def test_audit_diff_operations(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "y"), ("c", 1.0, None)], "k string, v double, t string")
    new = spark.createDataFrame([("a", 1.0, "z"), ("b", None, "y"), ("d", 2.0, None)], "k string, v double, t string")
    out = {r.k: (r.operation, r.old_t, r.new_t, r.new_v) for r in changes.audit_diff(old, new, ["k"], ["v", "t"]).collect()}
    assert out == {"a": ("UPDATE", "x", "z", 1.0), "c": ("DELETE", None, None, None), "d": ("INSERT", None, None, 2.0)}


def schema(text):
    return StructType.fromDDL(text)


def test_contract_scores():
    contract = Contract(["a", "b"], ["c"], {"a": "bigint", "b": "numeric(10,2)", "c": "jsonb"})
    good = contract_check(schema("a bigint, b decimal(18,2), c variant"), contract)
    assert (good.valid, good.score, good.issues) == (True, 1.0, [])
    wrong = contract_check(schema("a string, b double, x int"), contract)
    assert wrong.valid and round(wrong.score, 6) == round(0.7 + 0.3 * 0.6, 6) and wrong.extra == ["x"]
    assert {(i.severity, i.category, i.column) for i in wrong.issues} == {
        ("error", "type_mismatch", "a"),
        ("error", "type_mismatch", "b"),
        ("info", "missing_optional_column", "c"),
        ("warning", "extra_column", "x"),
    }
    lacking = contract_check(schema("a bigint"), contract)
    assert not lacking.valid and lacking.missing == ["b"] and round(lacking.score, 6) == 0.65


def test_contract_without_table_or_contract():
    assert contract_check(None, Contract(["z", "a"])).missing == ["a", "z"]
    assert contract_check(None, Contract(["a"])).issues[0].severity == "critical"
    unknown = contract_check(schema("a int"), None)
    assert unknown.valid and unknown.score == 1.0 and unknown.issues[0].severity == "warning"


def test_type_groups():
    assert contracts.types_compatible("TEXT", "character varying") and contracts.types_compatible("decimal(4,1)", "numeric")
    assert not contracts.types_compatible("timestamp with time zone", "timestamp") and not contracts.types_compatible("bigint", "integer")


def test_relaxed_and_exact_checks():
    layout = schema("id bigint, source_name string, payload string, batch_id string")
    assert contracts.relaxed_check(layout, CORE_COLUMNS["l0_steam_raw"]) == {"compatible": True, "missing": [], "layout": "optimized"}
    assert contracts.relaxed_check(schema("id bigint"), CORE_COLUMNS["l0_sony_raw"])["missing"] == ["payload", "source_name"]
    assert contracts.exact_columns(layout, ["id", "x"]) == (["x"], ["batch_id", "payload", "source_name"])


def test_platform_contracts_cover_their_own_columns():
    assert all(set(c.types) <= set(c.required) | set(c.optional) for c in CONTRACTS.values())
    assert CONTRACTS.keys() == CORE_COLUMNS.keys()


def test_rules_and_quarantine(spark):
    df = spark.createDataFrame([(1, '{"country":1,"sku":2}', "steam_batch_7", "steam_api"), (2, '{"sku":1}', "x", None), (3, None, None, "steam_api")], "id int, payload string, batch_id string, source_name string")
    rules = {"fields": contracts.must_contain("payload", ["country", "sku"]), "batch": contracts.should_follow("batch_id", "steam_batch_*"), "source": contracts.should_be("source_name", "steam_api")}
    assert {r.rule: r.violations for r in contracts.rule_check(df, rules).collect()} == {"fields": 2, "batch": 2, "source": 1}
    assert {r.id: r.broken_rules for r in contracts.quarantine(df, rules).collect()} == {2: ["fields", "batch", "source"], 3: ["fields", "batch"]}


def test_unique_and_fk_pass_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert [(r.k, r.occurrences) for r in contracts.unique_check(df, ["k"]).collect()] == [("a", 2)]
    parent = spark.createDataFrame([("b",)], "id string")
    assert [(r.k, r.orphans) for r in contracts.fk_check(df, "k", parent, "id").collect()] == [("a", 2)]


def test_registry_projection(spark):
    config = {
        "l1_contracts": {"revenue_fact": {"columns": {"day": "date", "amount": "numeric(18,2)", "land": "char(2)", "extra": "int"}, "pk": ["day", "land"]}},
        "platform_mappings": {"shop": {"revenue": {"source": "raw", "late_arrivals_days": 3, "map": {"day": "d", "amount": "usd", "land": "country"}}}},
    }
    tables_, mappings = contracts.read_registry(config)
    df = spark.createDataFrame([("2024-01-01", "1.239", "NO", 1), ("2024-01-01", "oops", "NO", 2), ("x", "5", "SE", 3)], "d string, usd string, country string, n int")
    out = contracts.apply_contract(df, tables_["l1_gaming_revenue"], mappings[("shop", "revenue")], ["n"])
    assert dict(out.dtypes) == {"day": "date", "amount": "decimal(18,2)", "land": "string", "extra": "int"}
    assert {(str(r.day), r.amount, r.land) for r in out.collect()} == {("2024-01-01", None, "NO"), ("None", 5, "SE")}
    assert mappings[("shop", "revenue")].late_arrivals_days == 3


def test_reconcile_counts(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None), (4, 200.0)], "id int, s double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.1), (5, 1.0)], "id int, s double")
    row = contracts.reconcile(a, b, "id", {"s": 0.01}, {"s": 100.0}).head()
    assert (row.compared, row.only_stored, row.only_recomputed, row.beyond, row.nulls, row.out_of_range) == (3, 1, 1, 1, 1, 1)


def test_watermark_never_moves_back_and_filters_with_grace(spark):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-10 05:00:00'), ('a', timestamp'2024-01-06 00:00:00'), ('b', timestamp'2020-01-01 00:00:00'), ('new', timestamp'2000-01-01 00:00:00') as t(source_name, loaded_at)")
    before = spark.sql("select * from values ('a', date'2024-02-01'), ('b', date'2019-01-01') as t(source_name, watermark_date)")
    marks = contracts.watermark_advance(rows.filter("source_name <> 'new'"), before, 3)
    assert {r.source_name: str(r.watermark_date) for r in marks.collect()} == {"a": "2024-02-01", "b": "2020-01-01"}
    recent = contracts.watermark_advance(rows.filter("source_name <> 'new'"), None, 3)
    kept = contracts.incremental_filter(rows, recent)
    assert {(r.source_name, str(r.loaded_at)[:10]) for r in kept.collect()} == {("a", "2024-01-10"), ("b", "2020-01-01"), ("new", "2000-01-01")}


def test_sources_and_sinks_round_trip(spark, tmp_path):
    df = spark.sql("select 1 as id, cast(2.50 as decimal(5,2)) as x, cast(null as string) as name union all select 2, null, 'й'")
    tables.write_csv(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/csv", "id int, x double, name string").collect()} == {(1, 2.5, None), (2, None, "й")}
    tables.write_json(df, f"{tmp_path}/json", ["id"])
    lines = [r.value for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert sorted(lines) == ['{"id":1,"x":2.5,"name":null}', '{"id":2,"x":null,"name":"й"}']
    tables.write_facts(df, f"{tmp_path}/facts", ["id"])
    assert "PartitionFilters: [isnotnull(id" in spark.read.parquet(f"{tmp_path}/facts").filter("id = 2")._jdf.queryExecution().executedPlan().toString()
