import json

import pytest
from pyspark.sql import functions as F

from terrascore.functions import text
from terrascore.operators import curated
from terrascore.plans import curation
from terrascore.sources import landing
from terrascore.sources.landing import FileRule

SCHEMA = (
    "id bigint, source_name string, file_name string, file_path string, report_type string, report_period string, "
    "payload string, content string, loaded_at timestamp"
)
RULES = [FileRule("rev_revshare", "*revshare*.csv", sep=";", skip_rows=0), FileRule("sales", "sales?.csv", skip_rows=0), FileRule("late", "s*.csv", skip_rows=1)]


def rows(spark, *items):
    base = {"source_name": "shop", "file_name": None, "file_path": None, "report_type": None, "report_period": None, "payload": None, "content": None, "loaded_at": None}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i} | item)[n] for n in names) for i, item in enumerate(items)], SCHEMA)


def records(df):
    return [r.records for r in df.orderBy("id").select("records").collect()]


def test_first_fitting_rule_wins_any_case(spark):
    df = rows(spark, {"file_name": "Sales1.CSV"}, {"file_name": "sales10.csv"}, {"file_path": "x_RevShare_1.csv"}, {"file_name": "other.txt"}, {})
    out = landing.match_rule(df, RULES).orderBy("id").select("rule.rule_id", "rule.target").collect()
    assert [r.rule_id for r in out] == ["sales", "late", "rev_revshare", None, None]
    assert [r.target for r in out] == ["sales", "sales", "revenue", None, None]


def test_rule_file_fills_defaults(spark, tmp_path):
    config = {"rules": [{"rule_id": "a", "file_pattern": "a*", "processing": {"csv_rules": {"delimiter": ";", "skip_rows": 0}}}, {"id": "b"}, {}]}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(config, indent=1))
    rules = landing.read_rules(spark, str(path))
    assert [(r.rule_id, r.file_pattern, r.sep, r.skip_rows) for r in rules] == [("a", "a*", ";", 0), ("b", "*.csv", ",", 3), ("rule_3", "*.csv", ",", 3)]


def test_json_payload_forms(spark):
    payloads = [
        '[{"z":1,"a":{"c":2.5,"d":{"e":"x"}},"l":[1,2]},{"z":"t","n":null}]',
        '{"b":true}',
        "[]",
        "42",
        '"text"',
        "nope{",
        None,
        '[1, {"a": 2}]',
        '{"raw":"{\\"k\\": 1}"}',
    ]
    df = rows(spark, *[{"payload": p} for p in payloads])
    out = records(landing.payload_records(df, F.col("payload"), "records"))
    assert out[0] == [{"z": "1", "a.c": "2.5", "a.d.e": "x", "l": "[1,2]"}, {"z": "t", "n": None}]
    assert list(out[0][0]) is not None and out[1] == [{"b": "true"}] and out[2] == []
    assert out[3:8] == [None] * 5
    # a string that looks like an object stays a string
    assert out[8] == [{"raw": '{"k": 1}'}]


def test_objects_of_any_depth_and_repeated_keys(spark):
    payloads = ['{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}', '{"a":1,"b":0,"a":2}', '{"a.b":1,"a":{"b":2}}', '{"a":2,"a":{"x":1}}', '{"a":{"x":1},"a":2}', '{"t":"{{{ \\" {"}']
    out = records(landing.payload_records(rows(spark, *[{"payload": p} for p in payloads]), F.col("payload"), "records"))
    assert out == [[{"a.b.c.d.e.f": "1"}], [{"a": "2", "b": "0"}], [{"a.b": "2"}], [{"a.x": "1"}], [{"a": "2"}], [{"t": '{{{ " {'}]]


def test_deep_and_broken_payloads_cost_only_themselves(spark):
    def deep(n):
        return '{"a":' * n + "1" + "}" * n

    payloads = ['{"a":1}', "{" * 200, '{"a":' * 200, deep(60), "[" + deep(7) + ',{"b":2}]']
    parsed = landing.payload_records(rows(spark, *[{"payload": p} for p in payloads]), F.col("payload"), "records")
    assert records(parsed) == [[{"a": "1"}], None, None, [{".".join("a" * 60): "1"}], [{".".join("a" * 7): "1"}, {"b": "2"}]]
    # building the query looks at no data: the plan is the same for any depth
    shallow = landing.payload_records(rows(spark, {"payload": "{}"}), F.col("payload"), "records")
    sizes = [len(d._jdf.queryExecution().analyzed().toString().split("\n")) for d in (parsed, shallow)]
    assert sizes[0] == sizes[1]


def test_header_names_are_free_and_long_rows_whole(spark):
    rule = FileRule("r", "*", skip_rows=0)
    contents = ["a,a,a.1\n1,2,3\n", "a,b\n1,2,3\n4,5,\n", "a,column_3\n1,2,3\n"]
    df = landing.match_rule(rows(spark, *[{"file_name": "x", "content": c} for c in contents]), [rule])
    assert records(landing.with_records(df)) == [
        [{"a": "1", "a.2": "2", "a.1": "3"}],
        [{"a": "1", "b": "2", "column_3": "3"}, {"a": "4", "b": "5"}],
        [{"a": "1", "column_3": "2", "column_3+": "3"}],
    ]


def test_csv_with_quotes_breaks_and_ragged_rows(spark):
    content = 'title\r\nname , qty,name\r\n"a, ""b""",1,x\r\n\r\n"two\nlines",2\r\nNA,,y,extra\r\n'
    df = rows(spark, {"file_name": "s_1.csv", "content": content})
    out = records(landing.with_records(landing.match_rule(df, RULES)))[0]
    assert out == [
        {"name": 'a, "b"', "qty": "1", "name.1": "x"},
        {"name": "two\nlines", "qty": "2", "name.1": None},
        {"name": None, "qty": None, "name.1": "y", "column_4": "extra"},
    ]


def test_csv_without_header_and_with_other_quote(spark):
    rule = FileRule("r", "*", sep="|", skip_rows=0, has_header=False, quotechar="'")
    df = rows(spark, {"file_name": "f", "content": "'a|b'|2\n3|4"})
    assert records(landing.with_records(landing.match_rule(df, [rule])))[0] == [{"0": "a|b", "1": "2"}, {"0": "3", "1": "4"}]


def test_binary_content_is_read_as_text(spark):
    df = rows(spark, {"file_name": "sales1.csv", "content": "Country,Units\nНорвегия,5\n"}).withColumn("content", F.col("content").cast("binary"))
    assert records(landing.with_records(landing.match_rule(df, RULES)))[0] == [{"Country": "Норвегия", "Units": "5"}]


def test_payload_wins_over_content_unless_unusable(spark):
    content = "Country,Units\nX,1\n"
    df = rows(spark, *[{"file_name": "sales1.csv", "payload": p, "content": content} for p in ('{"Country":"P"}', "[]", "7", None)])
    out = records(landing.with_records(landing.match_rule(df, RULES)))
    assert out[0] == [{"Country": "P"}] and out[1] == [] and out[2] == out[3] == [{"Country": "X", "Units": "1"}]


@pytest.mark.parametrize("content, skipped", [("sep=,\nTitle\na,b\n1,2", 2), ("a,b\n1,2", 0), ("\n\nx\ny\nz\na,b", 3), ("a,b\nplain\nc,d", 1), ("one\n", 1)])
def test_preface_sniffing(spark, content, skipped):
    df = spark.createDataFrame([(content,)], "content string")
    assert df.select(landing.preface_rows(F.col("content")).alias("n")).head().n == skipped


def test_picker_falls_back_by_intent(spark):
    # a country-like column never stands in for a missing number column
    df = rows(
        spark,
        {"file_name": "sales1.csv", "content": "Territory name,Net total\nNO,5\n"},
        {"file_name": "sales2.csv", "content": "Country\nSE\n"},
        {"file_name": "sales3.csv", "content": "Country,Units\n,\n , \n"},
    )
    out = curation.curate(df, RULES).sales.orderBy("l0_id").collect()
    assert [(r.l0_id, r.country, r.units, r.gross_revenue_usd) for r in out] == [(0, "NO", 5.0, None), (1, "SE", None, None)]


def test_periods(spark):
    names = ["x_March-2024.csv", "DECEMBER2023", "May 24.csv", None]
    df = spark.createDataFrame([(n, " 2020-02 " if i == 3 else None) for i, n in enumerate(names)], "n string, given string")
    out = [r.p for r in df.select(text.period_from_name(F.col("n"), F.col("given")).alias("p")).collect()]
    assert out[:3] == ["2024-03", "2023-12", "unknown"] and out[3] == "2020-02"


def test_numbers(spark):
    df = spark.createDataFrame([("$1,234.5",), (" 7 ",), ("",), ("n/a",), ("USD -3.50 net",), (None,)], "t string")
    strict = [r.x for r in df.select(text.to_number(F.col("t")).alias("x")).collect()]
    loose = [r.x for r in df.select(text.numify(F.col("t")).alias("x")).collect()]
    assert strict == [1234.5, 7.0, None, None, None, None]
    assert loose == [1234.5, 7.0, None, None, -3.5, None]


def test_type_scores_follow_rule_order(spark):
    kinds = ["пгт", "Рабочий посёлок", "посёлок", "Поселок", "город", "село", "хутор", None]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r.s for r in df.select(text.type_score(F.col("k")).alias("s")).collect()] == [1.0, 1.0, 0.85, 0.85, 1.0, 0.7, 0.6, 0.6]


def test_upsert_is_idempotent_and_last_record_wins(spark):
    df = rows(spark, {"file_name": "sales1.csv", "content": "Country,Units\nA,1\nA,2\n,3\n,4\n"})
    batch = curation.curate(df, RULES).sales
    once = curation.upsert_curated(None, batch)
    twice = curation.upsert_curated(once, batch)
    expect = {("A", 2.0), (None, 4.0)}
    assert {(r.country, r.units) for r in once.collect()} == expect == {(r.country, r.units) for r in twice.collect()}


def test_inferred_roles_and_votes(spark):
    df = rows(
        spark,
        {"payload": json.dumps([{"Market": "A", "Net_Units": 1, "Gross": 2}])},
        {"payload": json.dumps({"Region": "A", "Bonus amount": 3})},
        {"content": "sep=,\nCountry,Units sold,Sales\nA,1,2\n"},
        {"payload": "[]"},
    )
    inferred = curation.profile(df)
    kinds = {r.id: (r.kind, r.roles) for r in inferred.collect()}
    assert kinds[0] == ("sales", {"country": "Market", "units": "Net_Units", "revenue": "Gross"})
    assert kinds[1] == ("revenue_share", {"country": "Region", "share": "Bonus amount"})
    assert kinds[2] == ("sales", {"country": "Country", "units": "Units sold", "revenue": "Sales"}) and 3 not in kinds
    votes = {(r.kind, r.role): (r.column_name, r.votes) for r in curated.role_votes(inferred).collect()}
    assert votes[("sales", "country")] == ("Country", 1)
    fields = {(r.kind, r.field): r.source_column for r in curated.suggest_mapping(curated.role_votes(inferred)).collect()}
    assert fields[("revenue_share", "revenue_share_usd")] == "Bonus amount"
    assert curated.role_examples(inferred).filter("kind = 'revenue_share' and role = 'share'").head().example == "3"


def test_incremental_scan_is_half_open(spark):
    df = rows(spark, {}, {}, {}).withColumn("loaded_at", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))"))
    assert [r.id for r in landing.incremental_scan(df, "2024-01-01", "2024-01-03").orderBy("id").collect()] == [0, 1]
    assert [r.id for r in landing.incremental_scan(df, limit=2).collect()] == [0, 1]
