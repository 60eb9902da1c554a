"""Secret scan with multipart credential linking.

Base spans (assignments of secrets, access identifiers, long hexadecimal runs) are reported as they are found. Weak candidates (login
names, endpoints, mixed 40-character blobs) mean nothing alone: each is a part with a role (identifier, secret, endpoint), and an
interval join over positions reports it only if a complementary part, a secret for the others and an identifier or an endpoint for a
secret, lies within ``scope`` code points of it in the same text, and if no base span covers it already.

Positions come from built-in functions alone: the pieces between matches and the matches themselves give alternating lengths, and their
running sum (a window per text and kind, over the matches only) gives the offsets in code points. The join is an equi-join on text
and position bin, so a text with very many parts makes work in proportion to them.

Defined results: null or empty text: no spans, the hash of the empty string. Every row comes back, also repeated ones (rows are told
apart by a number that is stored with them). A base match that fails its length is dropped and what it has consumed stays consumed.
Equal spans of one kind cannot occur. Other columns are ignored. Long texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` is the part that has to have ``least`` code points (0: the whole match)."""

    name: str
    pattern: str
    role: str
    base: bool
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()  # patterns the match has to contain


#: Base patterns. A run of at least n characters is the same as a maximal run that is dropped when shorter.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", SECRET, True, group=2, least=8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", IDENTIFIER, True),
    Kind("hex", r"[0-9a-f]{32,}", SECRET, True),
    Kind("login", r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", IDENTIFIER, False, group=1, least=3),
    Kind("endpoint", r"""(?i:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[^\x20\x09-\x0D"'<>]+""", ENDPOINT, False),
    Kind("blob", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", SECRET, False, needs=("[A-Z]", "[a-z]", "[0-9]")),
)
#: Which roles complete a role.
COMPLEMENTS = {IDENTIFIER: (SECRET,), ENDPOINT: (SECRET,), SECRET: (IDENTIFIER, ENDPOINT)}


def found_parts(docs: DataFrame, kinds: tuple[Kind, ...], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, parts): per match its kind, number, distance from the previous match of the kind, length, and whether it counts."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    matched = base.select("*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"whole_{k.name}") for k in kinds])
    some = [F.size(f"whole_{k.name}") > 0 for k in kinds]
    # only texts with a match are cut or matched again
    cut = matched.select(
        "*",
        *[F.when(s, F.split("text", k.pattern, -1)).alias(f"gaps_{k.name}") for k, s in zip(kinds, some)],
        *[F.when(s, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group))).alias(f"value_{k.name}") for k, s in zip(kinds, some) if k.group],
    )

    def parts(number: int, k: Kind) -> Column:
        def part(x: Column) -> Column:
            counts = F.lit(True)
            if k.least:
                counts = F.char_length(x.getField("value")) >= k.least
            for pattern in k.needs:
                counts = counts & x.getField("whole").rlike(pattern)
            return F.struct(F.lit(number).alias("kind"), F.char_length(x.getField("gap")).alias("gap"), F.char_length(x.getField("whole")).alias("size"), counts.alias("counts"))

        whole = F.col(f"whole_{k.name}")
        value = F.col(f"value_{k.name}") if k.group else whole
        gaps = F.slice(f"gaps_{k.name}", F.lit(1), F.size(whole))
        return F.coalesce(F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), part), F.array())

    return cut.select("row", "doc_id", F.concat(*[parts(i, k) for i, k in enumerate(kinds)]).alias("parts"))


def positions(parts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the matches that count."""
    each = parts.select("row", F.posexplode("parts").alias("i", "part")).select("row", "i", "part.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i"))
    return each.withColumn("end", end).where("counts").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(spans: DataFrame, kinds: tuple[Kind, ...], scope: int) -> DataFrame:
    """The weak spans that a complementary part completes."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    role = F.element_at(F.array(*[F.lit(k.role) for k in kinds]), F.col("kind") + 1)
    is_base = F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("kind") + 1)
    parts = spans.withColumn("role", role).withColumn("base", is_base)
    weak = parts.where(~F.col("base")).withColumn("bin", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    near = parts.select("row", F.col("role").alias("p_role"), F.col("base").alias("p_base"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), bins(F.col("start"), F.col("end")).alias("bin"))
    pairs = weak.join(near, ["row", "bin"]).where((F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") + scope >= F.col("start")))
    completes = F.lit(False)
    for own, others in COMPLEMENTS.items():
        completes = completes | ((F.col("role") == own) & F.col("p_role").isin(*others))
    covers = F.col("p_base") & (F.col("p_start") < F.col("end")) & (F.col("p_end") > F.col("start"))
    seen = pairs.groupBy("row", "kind", "start", "end").agg(F.max(completes).alias("complete"), F.max(covers).alias("covered"))
    return seen.where("complete and not covered").select("row", "kind", "start", "end")


def secret_scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id and all_spans, an array of (start, kind number, end, kind, base) in order."""
    scratch = Scratch(docs.sparkSession, "secrets")
    parts = scratch.store(found_parts(docs, kinds, id_col, text_col), "parts")
    spans = scratch.store(positions(parts), "spans")
    is_base = F.element_at(F.array(*[F.lit(k.base) for k in kinds]), F.col("kind") + 1)
    everything = spans.where(is_base).union(linked(spans, kinds, scope))
    name = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.col("kind") + 1)
    per_row = everything.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", name.alias("name"), is_base.alias("base")))).alias("all_spans"))
    return parts.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", "all_spans")


def digest(scan: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    spans = F.coalesce("all_spans", F.array())
    texts = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.getField("name"), x.getField("start"), x.getField("end"))), ",")
    count = lambda name: F.size(F.filter(spans, lambda x: x.getField("name") == name)).cast("long")
    counts = [count(name).alias(f"n_{name}") for name in ("assign", "access", "hex")]
    base = F.filter(spans, lambda x: x.getField("base"))
    return scan.select("doc_id", *counts, F.sha2(texts(base), 256).alias("base_sha256"), texts(spans).alias("spans"))
