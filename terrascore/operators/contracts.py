"""Table contracts, row rules, key checks, contract projection, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrascore.functions.text import glob_regex
from terrascore.operators.changes import last_wins

# Type names that count as the same, by family.
TYPE_FAMILIES = {
    "int8": ("bigint", "bigserial", "int8"),
    "int4": ("integer", "int", "int4", "serial"),
    "text": ("text", "varchar", "character varying", "character"),
    "timestamptz": ("timestamp with time zone", "timestamptz"),
    "timestamp": ("timestamp without time zone", "timestamp"),
    "json": ("jsonb", "json"),
}
FAMILY_OF = {alias: family for family, aliases in TYPE_FAMILIES.items() for alias in aliases}

# Contract type name of each Spark type.
SPARK_TYPES = {
    "bigint": "bigint",
    "int": "integer",
    "smallint": "smallint",
    "string": "text",
    "date": "date",
    "timestamp": "timestamp with time zone",
    "timestamp_ntz": "timestamp without time zone",
    "variant": "jsonb",
    "double": "double precision",
    "float": "real",
    "boolean": "boolean",
    "binary": "bytea",
}


@dataclass(frozen=True)
class Contract:
    """What a consumer expects of a table."""

    required: Sequence[str]
    optional: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Issue:
    severity: str  # critical, error, warning, info
    category: str
    column: str | None = None
    expected: str | None = None
    actual: str | None = None


@dataclass(frozen=True)
class ContractReport:
    valid: bool
    score: float
    missing: list[str]
    extra: list[str]
    mismatches: list[tuple[str, str, str]]
    issues: list[Issue]


def contract_type(spark_type: str) -> str:
    """Contract name of a Spark type; decimals keep precision and scale."""
    return spark_type.replace("decimal", "numeric") if spark_type.startswith("decimal") else SPARK_TYPES.get(spark_type, spark_type)


def type_family(name: str) -> str:
    """What a type name is compared by; a decimal of any precision is numeric."""
    name = name.lower().strip()
    return "numeric" if "numeric" in name or "decimal" in name else FAMILY_OF.get(name, name)


def types_compatible(expected: str, actual: str) -> bool:
    return type_family(expected) == type_family(actual)


def contract_check(schema: StructType | None, contract: Contract | None) -> ContractReport:
    """Compare a schema with a contract. Metadata only: no rows are read.

    No contract means valid with a warning; no table is critical. Wrong types
    lower the score but only missing columns make a table invalid.
    """
    if contract is None:
        return ContractReport(True, 1.0, [], [], [], [Issue("warning", "compatibility")])
    if schema is None:
        return ContractReport(False, 0.0, sorted(contract.required), [], [], [Issue("critical", "existence")])
    actual = {f.name: contract_type(f.dataType.simpleString()) for f in schema}
    required, optional = set(contract.required), set(contract.optional)
    missing = sorted(required - actual.keys())
    extra = sorted(actual.keys() - required - optional)
    wrong = [(c, t, actual[c]) for c, t in contract.types.items() if c in actual and not types_compatible(t, actual[c])]
    issues = [Issue("error", "missing_column", c) for c in missing]
    issues += [Issue("info", "missing_optional_column", c) for c in sorted(optional - actual.keys())]
    issues += [Issue("warning", "extra_column", c) for c in extra]
    issues += [Issue("error", "type_mismatch", c, t, a) for c, t, a in wrong]
    score = 1.0
    if required:
        score = 0.7 * (len(required) - len(missing)) / len(required) + 0.3 * max(0.0, 1.0 - 0.2 * len(wrong))
    return ContractReport(not missing, score, missing, extra, wrong, issues)


def contract_check_all(spark: SparkSession, tables: Mapping[str, DataFrame | None], contracts: Mapping[str, Contract]) -> DataFrame:
    """One row per table: verdict, score, column lists, row count and empty required cells."""
    out = None
    for name, df in tables.items():
        contract = contracts.get(name)
        report = contract_check(df.schema if df is not None else None, contract)
        verdict = {
            "table_name": F.lit(name),
            "valid": F.lit(report.valid),
            "score": F.lit(round(report.score, 6)),
            "missing": F.lit(",".join(report.missing)),
            "extra": F.lit(",".join(report.extra)),
            "mismatches": F.lit(",".join(f"{c}:{e}:{a}" for c, e, a in report.mismatches)),
            "errors": F.lit(sum(i.severity in ("error", "critical") for i in report.issues)).cast("bigint"),
        }
        if df is None:
            counted = spark.range(1).select(F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("empty_cells"))
        else:
            held = [c for c in (contract.required if contract else []) if c in df.columns]
            empty = F.lit(0).cast("bigint")
            for c in held:
                empty = empty + F.count_if(F.col(c).isNull())
            counted = df.agg(F.count(F.lit(1)).alias("n_rows"), empty.alias("empty_cells"))
        row = counted.select(*[v.alias(k) for k, v in verdict.items()], "n_rows", "empty_cells")
        out = row if out is None else out.unionByName(row)
    return out


def exact_columns(schema: StructType, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns missing and columns too many; both empty for an exact match."""
    actual = set(schema.names)
    return sorted(set(expected) - actual), sorted(actual - set(expected))


def relaxed_check(schema: StructType | None, core: Sequence[str] | None) -> dict:
    """Core columns only, tagged by whether the table carries batch ids."""
    if schema is None:
        return {"compatible": False, "missing": [], "layout": None}
    missing = sorted(set(core or ()) - set(schema.names))
    return {"compatible": not missing, "missing": missing, "layout": "optimized" if "batch_id" in schema.names else "legacy"}


# -- row rules ----------------------------------------------------------------------


def must_contain(payload: str, fields: Sequence[str]) -> Column:
    """The JSON payload is an object with all ``fields``."""
    keys = F.json_object_keys(payload)
    held = F.lit(True)
    for f in fields:
        held = held & F.coalesce(F.array_contains(keys, f), F.lit(False))
    return held


def should_follow(column: str, pattern: str) -> Column:
    """The text fits a ``*`` / ``?`` pattern."""
    return F.coalesce(F.col(column).rlike(glob_regex(pattern)), F.lit(False))


def should_be(column: str, value: str) -> Column:
    return F.col(column).eqNullSafe(F.lit(value))


def rule_check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, checked, violations``: all rules in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(~ok).alias(name) for name, ok in rules.items()])
    return counts.unpivot(["checked"], list(rules), "rule", "violations").select("rule", "checked", "violations")


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)


# -- keys ---------------------------------------------------------------------------


def unique_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null part never clash."""
    whole = df.dropna(subset=list(keys))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def fk_check(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Referenced values the parent lacks and how many rows use them; nulls pass.

    Child rows are counted per value first, so a value that fills the table is
    one row in the join.
    """
    used = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("orphans"))
    return used.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


# -- registry -----------------------------------------------------------------------

# Registry type names and their Spark types.
REGISTRY_TYPES = {"date": "date", "text": "string", "int": "int", "numeric(18,2)": "decimal(18,2)", "char(2)": "string", "char(3)": "string"}


# Contracts whose table is not named after them.
TABLE_NAMES = {"revenue_fact": "l1_gaming_revenue"}


@dataclass(frozen=True)
class TableContract:
    """Declared columns and key of a curated table; ``key`` in the metadata is the name in the registry file."""

    name: str
    columns: Mapping[str, str] = field(default_factory=dict)
    primary_key: Sequence[str] = field(default=(), metadata={"key": "pk"})


@dataclass(frozen=True)
class FieldMapping:
    """How one platform fills one table."""

    platform: str
    table: str
    source: str = ""
    dedupe_keys: Sequence[str] = ()
    late_arrivals_days: int = 0
    fields: Mapping[str, str] = field(default_factory=dict, metadata={"key": "map"})


Bound = TypeVar("Bound")


def bind(kind: type[Bound], entry: Mapping, **given: object) -> Bound:
    """A dataclass from a mapping: each declared field by its name in the file, what is absent keeps its default."""
    named = {f.name: f.metadata.get("key", f.name) for f in fields(kind)}
    return kind(**given, **{name: entry[key] for name, key in named.items() if name not in given and entry.get(key) is not None})


def read_registry(registry: Mapping) -> tuple[dict[str, TableContract], dict[tuple[str, str], FieldMapping]]:
    """Table contracts by table, and field mappings by platform and table, of a parsed registry file."""
    declared = [bind(TableContract, entry, name=TABLE_NAMES.get(name, f"l1_{name}")) for name, entry in registry.get("l1_contracts", {}).items()]
    typed = [replace(t, columns={c: REGISTRY_TYPES.get(k, k) for c, k in t.columns.items()}) for t in declared]
    by_platform = registry.get("platform_mappings", {})
    mapped = [bind(FieldMapping, entry, platform=platform, table=table) for platform in by_platform for table, entry in by_platform[platform].items()]
    return {t.name: t for t in typed}, {(m.platform, m.table): m for m in mapped}


def apply_contract(df: DataFrame, table: TableContract, mapping: FieldMapping, order: Sequence[str] = ()) -> DataFrame:
    """Rename by the field map, cast to the declared types, keep the last row per key.

    A value that does not fit its type becomes null; a column the source lacks is null.
    """
    source = {c: mapping.fields.get(c, c) for c in table.columns}
    typed = [(F.col(s) if s in df.columns else F.lit(None)).try_cast(table.columns[c]).alias(c) for c, s in source.items()]
    keys = list(mapping.dedupe_keys or table.primary_key)
    out = df.select(*typed, *[F.col(o).alias(f"_order_{o}") for o in order])
    if not keys:
        return out.select(*table.columns)
    ranked = [f"_order_{o}" for o in order] or [c for c in table.columns if c not in keys]
    return last_wins(out, keys, ranked).select(*table.columns)


# -- reconciliation -----------------------------------------------------------------


def reconcile(stored: DataFrame, recomputed: DataFrame, key: str, tolerances: Mapping[str, float], top: Mapping[str, float] | None = None) -> DataFrame:
    """Per column: rows compared, beyond tolerance, null, out of range; and rows on one side only."""
    left = stored.select(F.col(key).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in tolerances])
    right = recomputed.select(F.col(key).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in tolerances])
    both = left.join(right, F.col("_l") == F.col("_r"), "full_outer")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    out = None
    aggs = [
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNull()).alias("only_stored"),
        F.count_if(F.col("_l").isNull() & F.col("_r").isNotNull()).alias("only_recomputed"),
        F.count_if(matched).alias("compared"),
    ]
    for c, tol in tolerances.items():
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        high = (top or {}).get(c)
        aggs.append(
            F.struct(
                F.count_if(matched & (F.abs(a - b) > tol)).alias("beyond"),
                F.count_if(F.col("_l").isNotNull() & a.isNull()).alias("nulls"),
                F.count_if((a < 0) | (a > high) if high is not None else F.lit(False)).alias("out_of_range"),
            ).alias(c)
        )
    out = both.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in tolerances])).alias("r")
    return out.select("compared", "only_stored", "only_recomputed", rows).select(
        "r.column_name", "compared", "only_stored", "only_recomputed", "r.x.beyond", "r.x.nulls", "r.x.out_of_range"
    )


# -- watermarks ---------------------------------------------------------------------


def watermark_advance(rows: DataFrame, previous: DataFrame | None, grace_days: int, source: str = "source_name", loaded: str = "loaded_at") -> DataFrame:
    """``source_name, watermark_date, grace_days``: the newest load date per source, never moving back."""
    newest = rows.groupBy(F.col(source).alias("source_name")).agg(F.max(F.to_date(loaded)).alias("watermark_date"))
    if previous is not None:
        newest = newest.unionByName(previous.select("source_name", "watermark_date"))
    return newest.groupBy("source_name").agg(F.max("watermark_date").alias("watermark_date")).withColumn("grace_days", F.lit(grace_days).cast("smallint"))


def load_starts(watermarks: DataFrame) -> DataFrame:
    """``_source, _from``: the first date to load again of each source."""
    return watermarks.select(F.col("source_name").alias("_source"), F.date_sub("watermark_date", F.col("grace_days").cast("int")).alias("_from"))


def incremental_filter(rows: DataFrame, watermarks: DataFrame, source: str = "source_name", loaded: str = "loaded_at") -> DataFrame:
    """Rows at or after their source's watermark less its grace days; unknown sources pass whole.

    ``watermarks`` has one row per source and should be a stored table, so that its size decides how it is joined. The earliest date of
    all sources is a plain bound on the load time, which reaches the scan of the known sources. For unknown ones all of ``rows`` is read;
    ``sources.ledger.incremental_read`` opens only the files that can hold rows to load.
    """
    marks = load_starts(watermarks)
    unknown = rows.join(marks, F.col(source) == F.col("_source"), "left_anti")
    floor = marks.agg(F.min("_from")).first()[0]
    if floor is None:
        return unknown
    recent = rows.filter(F.col(loaded) >= F.lit(floor).cast(rows.schema[loaded].dataType))
    known = recent.join(marks, F.col(source) == F.col("_source")).filter(F.to_date(loaded) >= F.col("_from")).drop("_source", "_from")
    return known.unionByName(unknown)
