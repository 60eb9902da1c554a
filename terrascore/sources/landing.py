"""Landing rows to records: JSON payloads and CSV text held in columns.

Every landing row becomes an array of ``map<string, string>`` records with
built-in array and map functions; nothing is parsed per file on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.text import glob_regex, present, report_target

# Private marks for a line break and a separator inside quotes.
_BREAK, _SEP = "\u0001", "\u0002"


@dataclass(frozen=True)
class FileRule:
    """How files with a matching name are read."""

    rule_id: str
    file_pattern: str = "*.csv"
    sep: str = ","
    skip_rows: int = 3
    has_header: bool = True
    quotechar: str = '"'


#: Layout of a rule file.
RULE_FILE = """rules array<struct<rule_id string, id string, file_pattern string,
    processing struct<csv_rules struct<sep string, delimiter string, skip_rows int, has_header boolean, quotechar string>>>>"""


def read_rules(spark: SparkSession, path: str) -> list[FileRule]:
    """The rules of a JSON rule file in order; what an entry leaves out or empty has the default of ``FileRule``."""
    listed = spark.read.schema(RULE_FILE).option("multiLine", True).json(path).select(F.posexplode("rules").alias("at", "r"))
    given = {
        "rule_id": [F.col("r.rule_id"), F.col("r.id"), F.concat(F.lit("rule_"), (F.col("at") + 1).cast("string"))],
        "file_pattern": [F.col("r.file_pattern")],
        "sep": [F.col("r.processing.csv_rules.sep"), F.col("r.processing.csv_rules.delimiter")],
        "skip_rows": [F.col("r.processing.csv_rules.skip_rows")],
        "has_header": [F.col("r.processing.csv_rules.has_header")],
        "quotechar": [F.col("r.processing.csv_rules.quotechar")],
    }
    defaults = {f.name: f.default for f in fields(FileRule)}
    kinds = {str: "string", int: "int", bool: "boolean"}
    columns = []
    for name, options in given.items():
        if name != "rule_id":
            options = [*options, F.lit(defaults[name])]
        filled = [F.when(o.cast("string") != "", o) for o in options]
        columns.append(F.coalesce(*filled).cast(kinds[type(defaults[name])] if name != "rule_id" else "string").alias(name))
    return [FileRule(**r.asDict()) for r in listed.orderBy("at").select(*columns).collect()]


def incremental_scan(l0: DataFrame, start: str | None = None, end: str | None = None, limit: int = 0) -> DataFrame:
    """Rows loaded in ``[start, end)``; with a limit the first ones by load time and id."""
    out = l0
    kind = l0.schema["loaded_at"].dataType.simpleString()
    if start:
        out = out.filter(F.col("loaded_at") >= F.lit(start).cast(kind))
    if end:
        out = out.filter(F.col("loaded_at") < F.lit(end).cast(kind))
    return out.orderBy("loaded_at", "id").limit(limit) if limit > 0 else out


def match_rule(l0: DataFrame, rules: Sequence[FileRule]) -> DataFrame:
    """Add ``source_file`` and ``rule``: the first rule whose pattern fits the name (else the path)."""
    name = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.col("file_path"), F.lit(""))
    chosen = None
    for r in rules:
        fields = F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            report_target(F.lit(r.rule_id)).alias("target"),
            F.lit(r.sep).alias("sep"),
            F.lit(r.skip_rows).alias("skip_rows"),
            F.lit(r.has_header).alias("has_header"),
            F.lit(r.quotechar).alias("quotechar"),
        )
        chosen = (F if chosen is None else chosen).when(F.col("source_file").rlike(glob_regex(r.file_pattern)), fields)
    return l0.withColumn("source_file", name).withColumn("rule", chosen)


def as_text(content: Column, kind: str) -> Column:
    """Binary content as UTF-8 text; bytes that are no text become replacement marks."""
    return content.cast("string") if kind == "binary" else content


# -- JSON ---------------------------------------------------------------------------

_OBJECT = "map<string,string>"
_NODES = "map<string,variant>"


def object_depth(payload: Column) -> Column:
    """How many braces are open at most, outside of quoted text: no object lies deeper."""
    bare = F.regexp_replace(payload, r'"(?:[^"\\]|\\.)*"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, brace: Column) -> Column:
        now = acc["open"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("open"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda acc: acc["most"])


def payload_records(df: DataFrame, payload: Column, out: str) -> DataFrame:
    """Add ``out``: a JSON list gives its objects as records, an object one, anything else null.

    Nested objects are flattened until none is left, their keys joined by dots; of a repeated key the last value counts. Each payload
    is unfolded as often as its own braces nest, in a loop within one expression: the plan is the same for any depth, and a deep or broken
    payload costs itself alone. The stages are columns of their own, so each is computed once per row.
    """
    # a repeated key is legal JSON
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    staged = df.withColumn("_payload", payload).withColumn("_node", F.try_parse_json("_payload"))
    kind = F.schema_of_variant("_node")
    is_list, is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    staged = staged.withColumns(
        {
            "_texts": F.when(is_list, F.from_json("_payload", f"array<{_OBJECT}>")).when(is_object, F.array(F.from_json("_payload", _OBJECT))),
            "_nodes": F.when(is_list, F.col("_node").try_cast("array<variant>")).when(is_object, F.array("_node")),
        }
    )
    # text that is no JSON holds no objects, however many braces are open in it
    rounds = F.when(is_list | is_object, F.greatest(object_depth(F.col("_payload")) - 1, F.lit(0))).otherwise(0)
    staged = staged.withColumn("_rounds", F.array_repeat(F.lit(True), rounds))
    objects = F.transform(F.arrays_zip("_texts", "_nodes"), lambda p: _entries(F.lit(""), p["_texts"], p["_nodes"]))
    staged = staged.withColumn("_entries", objects)
    staged = staged.withColumn("_entries", F.transform("_entries", _unfold_all))
    records = F.transform("_entries", lambda entries: F.map_from_entries(F.transform(_last_of_each(entries), lambda e: F.struct(e["key"], e["text"]))))
    clean = ~F.exists("_texts", lambda t: t.isNull())
    return staged.withColumn(out, F.when(clean, records)).drop("_payload", "_node", "_texts", "_nodes", "_rounds", "_entries")


def _last_of_each(entries: Column) -> Column:
    """One entry per key, where the key first stands, with its last value."""
    keys = F.transform(entries, lambda e: e["key"])
    firsts = F.array_distinct(keys)
    last = F.transform(firsts, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.when(F.size(firsts) == F.size(keys), entries).otherwise(last)


def _entries(prefix: Column, texts: Column, node: Column) -> Column:
    """``(key, text, node)`` of one object in written order."""
    nodes = node.try_cast(_NODES)
    written = F.transform(F.map_entries(texts), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
    return F.transform(
        _last_of_each(written),
        lambda e: F.struct(F.concat(prefix, e["key"]).alias("key"), e["text"].alias("text"), F.try_element_at(nodes, e["key"]).alias("node")),
    )


def _unfold_all(entries: Column) -> Column:
    """The entries of a record once no object is left in them; a record that holds none is done at once."""
    unfolded = F.aggregate("_rounds", entries, lambda held, _: F.when(F.exists(held, _holds_object), F.flatten(F.transform(held, _unfold))).otherwise(held))
    return F.when(F.exists(entries, _holds_object), unfolded).otherwise(entries)


def _holds_object(e: Column) -> Column:
    return F.coalesce(F.schema_of_variant(e["node"]).startswith("OBJECT"), F.lit(False))


def _unfold(e: Column) -> Column:
    """The entry itself, or the entries of the object it holds."""
    inner = _entries(F.concat(e["key"], F.lit(".")), F.from_json(e["text"], _OBJECT), e["node"])
    return F.when(_holds_object(e), inner).otherwise(F.array(F.struct(e["key"].alias("key"), e["text"].alias("text"), e["node"].alias("node"))))


# -- CSV ----------------------------------------------------------------------------


def csv_lines(text: Column, sep: Column, quote: Column) -> Column:
    """Physical lines, with breaks and separators inside quotes masked."""
    clean = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(clean, F.concat(F.lit("\\Q"), quote, F.lit("\\E")))
    masked = F.transform(
        parts,
        lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("\n"), F.lit(_BREAK)), sep, F.lit(_SEP))).otherwise(p),
    )
    return F.split(F.call_function("array_join", masked, quote), "\n")


def csv_cells(line: Column, sep: Column, quote: Column) -> Column:
    """Cells of one masked line, unquoted."""

    def cell(c: Column) -> Column:
        quoted = (F.length(c) >= 2) & F.startswith(c, quote) & F.endswith(c, quote)
        inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.concat(quote, quote), quote)
        plain = F.when(quoted, inner).otherwise(c)
        return F.replace(F.replace(plain, F.lit(_BREAK), F.lit("\n")), F.lit(_SEP), sep)

    return F.transform(F.split(line, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), cell)


def csv_records(df: DataFrame, text: Column, sep: Column, skip_rows: Column, has_header: Column, quote: Column, out: str) -> DataFrame:
    """Add ``out``: records of a CSV text, or null without any line.

    The preface is skipped, the header trimmed, short rows padded, empty cells
    null, cells beyond the header kept as ``column_<number>``. Lines, cells and header are columns of their own, so that each is
    computed once per text and not once per record.
    """
    staged = df.withColumns({"_sep": sep, "_skip": skip_rows, "_head": has_header, "_quote": quote})
    staged = staged.withColumn("_lines", csv_lines(text, F.col("_sep"), F.col("_quote")))
    body = F.slice("_lines", F.col("_skip") + 1, F.greatest(F.size("_lines") - F.col("_skip"), F.lit(0)))
    rows = F.transform(F.filter(body, lambda line: F.trim(line) != ""), lambda line: csv_cells(line, F.col("_sep"), F.col("_quote")))
    staged = staged.withColumn("_rows", rows).withColumn("_names", F.transform(F.get("_rows", F.lit(0)), lambda c: F.trim(c)))
    data = F.when(F.col("_head"), F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).otherwise(F.col("_rows"))
    staged = staged.withColumns({"_header": csv_header("_names", F.col("_head")), "_data": data})
    return staged.withColumn(out, F.when(F.col("_header").isNotNull(), F.transform("_data", csv_record))).drop(
        "_sep", "_skip", "_head", "_quote", "_lines", "_rows", "_names", "_header", "_data"
    )


def csv_header(first: str, has_header: Column) -> Column:
    """Column names from the trimmed cells of the first row: the cells themselves, or their numbers."""
    return F.when(has_header, free_names(F.col(first))).otherwise(F.transform(first, lambda c, i: i.cast("string")))


def csv_record(cells: Column) -> Column:
    """The cells of a row by the names in the column ``_header``."""
    named = F.transform("_header", lambda name, i: F.struct(name.alias("key"), present(F.get(cells, i)).alias("value")))
    beyond = F.slice(cells, F.size("_header") + 1, F.greatest(F.size(cells) - F.size("_header"), F.lit(0)))
    spare = F.transform(beyond, lambda c, i: F.struct(_spare_name(i).alias("key"), present(c).alias("value")))
    return F.map_from_entries(F.concat(named, F.filter(spare, lambda e: e["value"].isNotNull())))


def _spare_name(i: Column) -> Column:
    """Name of the cell i places beyond the header: ``column_`` and its number, marked until no header has it."""
    plain = F.concat(F.lit("column_"), (F.size("_header") + i + 1).cast("string"))
    marked = F.transform(F.sequence(F.lit(0), F.size("_header")), lambda k: F.concat(plain, F.repeat(F.lit("+"), k)))
    return F.get(F.filter(marked, lambda name: ~F.array_contains(F.col("_header"), name)), F.lit(0))


def free_names(names: Column) -> Column:
    """The names of a header; a repeated one gets the first of ``.1``, ``.2``, ... that is no other name."""

    def add(done: Column, name: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat(name, F.lit("."), k.cast("string")))
        free = F.filter(numbered, lambda n: ~F.array_contains(done, n) & ~F.array_contains(names, n))
        return F.concat(done, F.array(F.when(F.array_contains(done, name), F.get(free, F.lit(0))).otherwise(name)))

    return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(F.aggregate(names, F.array().cast("array<string>"), add))


def preface_rows(text: Column) -> Column:
    """How many of the first three lines are preface: ``sep=`` lines or lines without a comma."""
    clean = F.regexp_replace(F.regexp_replace(F.ltrim(text), "\r\n?", "\n"), "\n\\z", "")
    lines = F.split(clean, "\n")
    loose = F.filter(F.slice(lines, 1, 3), lambda line: F.startswith(F.lower(line), F.lit("sep=")) | ~F.contains(line, F.lit(",")))
    return F.size(loose)


# -- records ------------------------------------------------------------------------


def explode_records(parsed: DataFrame, records: str = "records") -> DataFrame:
    """One row per record with ``record_no`` and ``record``.

    The outer form: an inner explode would make Catalyst push a size filter
    through the parsing stages and inline them all into one expression.
    """
    rest = [c for c in parsed.columns if c not in (records, "columns")]
    rows = parsed.select(*rest, F.posexplode_outer(records).alias("record_no", "record"))
    return rows.filter(F.col("record").isNotNull())


def with_records(matched: DataFrame) -> DataFrame:
    """Add ``records`` and ``columns``; CSV text counts only where the payload is unusable."""
    rule = F.col("rule")
    text = F.nullif(as_text(F.col("content"), matched.schema["content"].dataType.typeName()), F.lit(""))
    parsed = payload_records(matched, F.col("payload"), "_json")
    text = F.when(F.col("_json").isNull(), text)
    read = csv_records(parsed, text, rule["sep"], rule["skip_rows"], rule["has_header"], rule["quotechar"], "_csv")
    out = read.withColumn("records", F.coalesce("_json", "_csv")).drop("_json", "_csv")
    return out.withColumn("columns", record_columns(F.col("records")))


def record_columns(records: Column) -> Column:
    """Column names of a row's records in order of first appearance."""
    return F.array_distinct(F.flatten(F.transform(records, lambda r: F.map_keys(r))))


def sniffed_records(l0: DataFrame) -> DataFrame:
    """As ``with_records`` without rules: comma separated, preface length sniffed."""
    text = F.ltrim(as_text(F.col("content"), l0.schema["content"].dataType.typeName()))
    parsed = payload_records(l0, F.trim(F.col("payload")), "_json")
    text = F.when(F.col("_json").isNull(), text)
    read = csv_records(parsed, text, F.lit(","), preface_rows(text), F.lit(True), F.lit('"'), "_csv")
    out = read.withColumn("records", F.coalesce("_json", "_csv")).drop("_json", "_csv")
    return out.withColumn("columns", record_columns(F.col("records")))
