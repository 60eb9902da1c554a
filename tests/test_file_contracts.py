"""Schemas of stored files against contracts and against each other."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from terrascore.operators import file_contracts
from terrascore.operators.contracts import Contract


@pytest.fixture
def footers(spark, tmp_path):
    def write(table, number, **columns):
        (tmp_path / table).mkdir(exist_ok=True)
        pq.write_table(pa.table(columns), tmp_path / table / f"part-{number}.parquet")

    for number in range(3):
        write("sales", number, id=pa.array([1]), name=pa.array(["x"]), amount=pa.array([1.5]))
    write("sales", 3, id=pa.array([1], pa.int32()), name=pa.array(["y"]), extra=pa.array([True]))
    write("stock", 0, id=pa.array([], pa.int64()), price=pa.array([], pa.decimal128(10, 2)), at=pa.array([], pa.timestamp("us", "UTC")), batch_id=pa.array([], pa.string()))
    (tmp_path / "empty").mkdir()
    return file_contracts.read_footers(spark, {t: str(tmp_path / t) for t in ("sales", "stock", "empty")}).cache()


def rows(df):
    short = [(r.table_name, (r.file or "").split("/")[-1], r.severity, r.category, r.column_name, r.expected, r.actual) for r in df.collect()]
    return sorted(short, key=str)


def test_a_drifted_file_gives_issues(footers):
    contracts = {
        "sales": Contract(["id", "name"], ["amount"], {"id": "int8", "name": "varchar"}),
        "empty": Contract(["id"]),
    }
    assert rows(file_contracts.schema_issues(footers, contracts, ["stock", "gone"])) == sorted(
        [
            ("sales", "part-3.parquet", "info", "missing_optional_column", "amount", None, None),
            ("sales", "part-3.parquet", "warning", "extra_column", "extra", None, None),
            ("sales", "part-3.parquet", "error", "type_mismatch", "id", "int8", "integer"),
            ("sales", "part-3.parquet", "warning", "drift", "id", "bigint", "integer"),
            ("sales", "part-3.parquet", "warning", "drift", "amount", "double precision", None),
            ("empty", "", "critical", "existence", None, None, None),
            ("gone", "", "critical", "existence", None, None, None),
            ("stock", "", "warning", "compatibility", None, None, None),
        ],
        key=str,
    )


def test_types_of_footers_and_compatible_families(footers):
    contract = Contract(["id", "price", "at"], ["batch_id"], {"id": "bigserial", "price": "decimal(18,4)", "at": "timestamptz", "batch_id": "text"})
    assert rows(file_contracts.schema_issues(footers.filter("table_name = 'stock'"), {"stock": contract})) == []
    wrong = Contract(["id", "price", "at", "batch_id"], (), {"at": "timestamp", "price": "bigint"})
    found = rows(file_contracts.schema_issues(footers.filter("table_name = 'stock'"), {"stock": wrong}))
    assert {(r[4], r[5], r[6]) for r in found} == {("at", "timestamp", "timestamp with time zone"), ("price", "bigint", "numeric(10,2)")}


def test_exact_and_relaxed_columns(footers):
    exact = {(r.table_name, r.file[-9]): (r.missing, r.extra, r.matches) for r in file_contracts.exact_files(footers, {"sales": ["id", "name", "amount"]}).collect()}
    assert exact == {("sales", n): ([], [], True) for n in "012"} | {("sales", "3"): (["amount"], ["extra"], False)}
    core = {"sales": ["id", "amount"], "stock": ["batch_id", "sku"]}
    relaxed = {(r.table_name, r.file[-9]): (r.compatible, r.missing, r.layout) for r in file_contracts.relaxed_files(footers, core).collect()}
    assert relaxed[("sales", "0")] == (True, [], "legacy") and relaxed[("sales", "3")] == (False, ["amount"], "legacy")
    assert relaxed[("stock", "0")] == (False, ["sku"], "optimized")


def test_no_tables_at_all(spark):
    none = file_contracts.read_footers(spark, {})
    assert rows(file_contracts.schema_issues(none, {"a": Contract(["x"])})) == [("a", "", "critical", "existence", None, None, None)]
