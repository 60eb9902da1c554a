"""Benchmark decontamination by template canonicalisation.

The words of documents and benchmark items become templates: numbers, units and names turn into typed placeholders, other words are
lowered and stripped of punctuation. Windows of template words are hashed and equi-joined with the windows of the benchmark, so a
question with other numbers or names still meets its item. Matches on one diagonal (document position minus item position) form an
alignment, and its slots are checked: every value of the item has to stand for one value of the document throughout. An item is leaked
into a document if the consistent alignments cover ``least_cover`` of its windows.

The benchmark side is broadcast only if it has at most ``broadcast_windows`` windows; beyond that the same join shuffles. Windows of the
benchmark that consist of placeholders for more than half are left out, as they say nothing.

This is the rule of the SQL of ``op9_decontamination``. With ``literal`` the windows are matched by their lower-cased words as well, so a
verbatim copy in another case is found though its capitals make other names; a window counts as matched by either, and the slots of a
window whose words are equal need no check. With ``least_run`` an item is leaked as well if so many of its words in a row (all of a shorter
item) stand in the document on one consistent alignment, whatever their share of the item; placeholders with other values do not count. With
``literal`` windows of mostly placeholders are matched by their words too: they count for runs, and for the cover of an item that has no
others (number series, lists of names).

Defined results: null or empty texts and items match nothing. Items shorter than a window form one shorter window. Repeated rows of
documents give one result row per document id and item; repeated items each count. Documents without a leak give no row. A document
is known by its id and text, so a null id or an id with several texts is no problem. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch
from terrascore.llm.rules import SPACE

#: Characters stripped from both ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}…«»“”‘’"
#: Number words and units that become placeholders.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents "
    "percent % $ € degree degrees kmh mph watt watts volt volts"
).split()
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


@dataclass(frozen=True)
class DecontaminationSettings:
    window: int = 8
    least_cover: float = 0.5
    broadcast_windows: int = 1_000_000
    literal: bool = False
    least_run: int | None = None
    least_words: int = 3  # shorter items would be found wherever their one or two words stand


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bare_word(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def low_words(words: str) -> Column:
    """The words of an array column stripped and lowered; a column of its own, so that it is computed once per word."""
    return F.transform(words, lambda w: F.lower(bare_word(w)))


def template_word(words: str, low: Column, i: Column) -> Column:
    """The template word of the word at ``i`` of the array column ``words``; ``low`` is its stripped and lowered form.

    Most words fail the first test of every branch, which is a plain comparison.
    """
    raw = F.get(F.col(words), i)
    first = F.substring(bare_word(raw), 1, 1)
    inside = (i > 0) & ~F.get(F.col(words), i - 1).rlike(r"""[.!?:]["')»”’]*$""")
    return (
        F.when((low >= "0") & (low < ":") & low.rlike(r"^[0-9][0-9.,/]*$"), NUMBER)
        .when(low.isin(NUMBER_WORDS + UNITS), F.when(low.isin(UNITS), UNIT).otherwise(NUMBER))
        .when((raw != low) & (first != F.lower(first)) & inside, NAME)
        .otherwise(low)
    )


def window_hashes(hashes: str, size: int) -> Column:
    return F.when(
        F.size(hashes) >= size,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def short_items(benchmark: DataFrame, settings: DecontaminationSettings = DecontaminationSettings(), text_col: str = "text") -> DataFrame:
    """The items that have too few words to be looked for."""
    return benchmark.where(F.size(words_of(F.col(text_col).cast("string"))) < settings.least_words)


def item_tokens(benchmark: DataFrame, id_col: str, text_col: str, least_words: int = 1) -> DataFrame:
    """(item_id, item_key, tokens): the words of each item of at least ``least_words`` with their template word."""
    words = benchmark.select(F.col(id_col).alias("item_id"), F.xxhash64(id_col, text_col).alias("item_key"), words_of(F.col(text_col).cast("string")).alias("words"))
    words = words.where(F.size("words") >= least_words).withColumn("lows", low_words("words"))
    tokens = F.transform("lows", lambda low, i: F.struct(bare_word(F.get("words", i)).alias("raw"), template_word("words", low, i).alias("word"), low.alias("low")))
    return words.select("item_id", "item_key", tokens.alias("tokens")).distinct()


def item_windows(tokens: DataFrame, size: int, literal: bool = False) -> DataFrame:
    """(item_key, n_words, n_windows, at, size, hash, literal, counts, same) of the windows that say something; with ``literal`` all by their plain words as well.

    ``counts``: the window is one of the ``n_windows`` of the cover. ``same`` tells of every place of the window whether a match has the word of the item there.
    """
    n = F.size("tokens")
    hashes = [F.transform(f"tokens.{c}", lambda w: F.xxhash64(w)).alias(c) for c in ("word", "low")]
    hashed = tokens.select("item_key", "tokens", *hashes, F.least(n, F.lit(size)).alias("size"))
    spans = F.transform(
        F.sequence(F.lit(0), n - F.col("size")),
        lambda i: F.struct(i.alias("at"), F.size(F.filter(F.slice("tokens", i + 1, F.col("size")), lambda t: t.getField("word").isin(NUMBER, UNIT, NAME))).alias("slots")),
    )
    telling = F.filter("spans", lambda s: 2 * s.getField("slots") <= F.col("size"))
    spanned = hashed.withColumn("spans", spans).withColumn("telling", telling)
    # an item of which no window says something is covered by its plain words
    base = F.when(F.size("telling") > 0, F.col("telling")).otherwise(F.col("spans"))
    rows = spanned.select("item_key", "tokens", "word", "low", n.alias("n_words"), "size", F.size("telling").alias("n_telling"), F.size(base).alias("n_windows"), F.explode("spans").alias("span")).select("*", "span.*")
    rows = rows.withColumn("tells", 2 * F.col("slots") <= F.col("size")).withColumn("counts", F.col("tells") | (F.col("n_telling") == 0))

    def windows(frame: DataFrame, field: str) -> DataFrame:
        hash_ = F.lit(None).cast("bigint")
        for k in range(1, size + 1):
            hash_ = F.when(F.col("size") == k, F.xxhash64(*[F.get(field, F.col("at") + j) for j in range(k)])).otherwise(hash_)
        own = F.slice("tokens.word", F.col("at") + 1, F.col("size"))
        same = F.transform(own, lambda w: F.lit(field == "low") | ~w.isin(NUMBER, UNIT, NAME))
        return frame.select("item_key", "n_words", "n_windows", "at", "size", hash_.alias("hash"), F.lit(field == "low").alias("literal"), "counts", same.alias("same"))

    # without a slot both are the same window
    return windows(rows.where("tells and slots > 0"), "word").union(windows(rows, "low")) if literal else windows(rows.where("tells"), "word")


def matches(docs: DataFrame, windows: DataFrame, settings: DecontaminationSettings, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, item_key, n_words, n_windows, at, shift, size, literal, counts, same) of every window of a document that the benchmark has."""
    about = {r["size"]: r.n for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    side = F.broadcast(windows) if sum(about.values()) <= settings.broadcast_windows else windows
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc_key"), words_of(F.col(text_col).cast("string")).alias("words"))
    words = words.withColumn("lows", low_words("words"))
    hashed = words.select("doc_id", "doc_key", F.transform("lows", lambda low, i: F.xxhash64(template_word("words", low, i))).alias("hashes"), F.transform("lows", lambda low: F.xxhash64(low)).alias("plain"))
    out = None
    for size in sorted(about) or [settings.window]:
        found = window_hashes("hashes", size)
        if settings.literal:
            either = F.zip_with(found, window_hashes("plain", size), lambda t, w: F.when(t == w, F.array(t)).otherwise(F.array(t, w)))
            each = hashed.select("doc_id", "doc_key", F.posexplode(either).alias("position", "hashes")).withColumn("hash", F.explode("hashes"))
        else:
            each = hashed.select("doc_id", "doc_key", F.posexplode(found).alias("position", "hash"))
        own = side.where(F.col("size") == size) if len(about) > 1 else side
        hit = each.join(own, "hash").select("doc_id", "doc_key", "item_key", "n_words", "n_windows", "at", (F.col("position") - F.col("at")).alias("shift"), "size", "literal", "counts", "same")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def inconsistent(found: DataFrame, tokens: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame | None:
    """(doc_key, item_key, shift) of alignments in which a value of the item stands for several of the document; None if no item has slots."""
    slots = tokens.select("item_key", F.posexplode("tokens").alias("place", "token")).select("item_key", "place", "token.*").where(F.col("word").isin(NUMBER, UNIT, NAME))
    seen = found.select("doc_key", "item_key", "shift", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("place")).distinct()
    wanted = seen.join(slots, ["item_key", "place"]).withColumn("position", F.col("place") + F.col("shift"))
    wanted = scratch.store(wanted.groupBy("doc_key").agg(F.collect_list(F.struct("item_key", "shift", "position", "word", "raw")).alias("slots")), "slots")
    if wanted.isEmpty():
        return None
    texts = docs.select(F.xxhash64(id_col, text_col).alias("doc_key"), F.col(text_col).cast("string").alias("text")).join(wanted, "doc_key")
    filled = texts.select("doc_key", "slots", words_of(F.col("text")).alias("words"))
    value = F.transform("slots", lambda s: F.struct(*[s.getField(c).alias(c) for c in ("item_key", "shift", "word", "raw")], bare_word(F.get("words", s.getField("position"))).alias("value")))
    rows = filled.select("doc_key", F.explode(value).alias("s")).select("doc_key", "s.*")
    kinds = rows.groupBy("doc_key", "item_key", "shift", "word", "raw").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return kinds.where("low <> high").select("doc_key", "item_key", "shift").distinct()


def longest_runs(found: DataFrame) -> DataFrame:
    """(doc_key, item_key, run): most words in a row matched on one alignment, without placeholders of other values."""
    alignment = ["doc_key", "item_key", "shift"]
    places = found.select(*alignment, "at", F.posexplode("same").alias("k", "same")).groupBy(*alignment, (F.col("at") + F.col("k")).alias("place")).agg(F.max("same").alias("same"))
    island = F.col("place") - F.row_number().over(Window.partitionBy(*alignment).orderBy("place"))
    runs = places.withColumn("island", island).groupBy(*alignment, "island").agg(F.count_if("same").alias("run"))
    return runs.groupBy("doc_key", "item_key").agg(F.max("run").alias("run"))


def leaks(docs: DataFrame, benchmark: DataFrame, settings: DecontaminationSettings = DecontaminationSettings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, doc_key (xxhash64 of id and text), item_id, n_matched, n_windows and cover of every leaked item of every document."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    tokens = scratch.store(item_tokens(benchmark, item_col, item_text_col, settings.least_words), "tokens")
    windows = scratch.store(item_windows(tokens, settings.window, settings.literal), "windows")
    found = scratch.store(matches(docs, windows, settings, id_col, text_col), "found")
    wrong = inconsistent(found.where("not literal"), tokens, docs, scratch, id_col, text_col)
    if wrong is not None:
        found = found.where("literal").union(found.where("not literal").join(wrong, ["doc_key", "item_key", "shift"], "left_anti").select(*found.columns))
    per_item = found.groupBy("doc_id", "doc_key", "item_key", "n_words", "n_windows").agg(F.count_distinct(F.when(F.col("counts"), F.col("at"))).alias("n_matched"))
    cover = F.col("n_matched") / F.col("n_windows")
    leaked = per_item.withColumn("cover", cover)
    if settings.least_run is None:
        leaked = leaked.where(F.col("cover") >= settings.least_cover)
    else:
        whole = F.col("run") >= F.least(F.lit(settings.least_run), F.col("n_words"))
        leaked = leaked.join(longest_runs(found), ["doc_key", "item_key"]).where((F.col("cover") >= settings.least_cover) | whole)
    names = tokens.select("item_key", "item_id").distinct()
    return leaked.join(names, "item_key").select("doc_id", "doc_key", "item_id", F.col("n_matched").cast("long").alias("n_matched"), F.col("n_windows").cast("long").alias("n_windows"), "cover")
