"""Language identification with interpolated Kneser-Ney character models.

Counts of character n-grams of the highest order are gathered from every text that may be learned from and summed by Spark; lower
orders use continuation counts (in how many different n-grams a suffix occurs), which follow from the same table. Discounts come from
the counts of counts of each language and order. The estimates are Spark joins of each order with the one below. No n-gram is left out,
so what is gathered grows with the kinds of n-grams in the texts, and a model sent to the workers has a row of values for each kind.
``least_share`` above 0 bounds it to ``1 / least_share`` kinds per order and language: rarer ones are then left to the lower order.

A worker keeps one hash-sorted array per order with a row of log probabilities, one per language, and looks up all characters of a
run of texts at once. The language with the lowest cross-entropy per character is chosen. The score is the posterior at a temperature
fitted on the learning fold, and a text whose cross-entropy is beyond the ``reject_quantile`` of the texts of its language in that fold
is marked as not ``accepted``. Both come from every text of the fold: mean losses and exact quantiles are Spark aggregates.

Letters are lowered, everything else counts as a space; a run of spaces is read as one per character. Defined results: null text or one
without a letter: ``und``, score 0, not accepted. Equal cross-entropy: the language first in order. Null languages teach nothing. No
labelled text at all: every text is ``und``. Repeated rows count as often as they occur. Long texts are read whole, in segments that
carry their left context. Other columns are ignored. Letters beyond the basic plane share codes with each other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch, char_runs, held_out, mix
from terrascore.operators.quantiles import exact_quantiles

#: Packed n-grams a task holds before they are counted together.
HELD_GRAMS = 1_500_000
#: Temperatures of the posterior that are tried.
TEMPERATURES = [2.0**k for k in range(9)]


@dataclass(frozen=True)
class LanguageSettings:
    order: int = 4  # four codes of 16 bits fill a long
    least_share: float = 0.0
    reject_quantile: float = 0.995


def letter_codes() -> np.ndarray:
    """Code of 16 bits of every code point: itself for a letter, a space for anything else.

    Letters beyond the basic plane share the 6,400 private codes, which no letter has, so none of them meets the space.
    """
    codes = np.arange(0x110000, dtype=np.uint64)
    codes[0x10000:] = 0xE000 + codes[0x10000:] % 6_400
    codes[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] != "L"]] = 0x20
    return codes


def packed(codes: np.ndarray, order: int) -> np.ndarray:
    """At every position the last ``order`` codes in one number, the latest in the lowest bits."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(order):
        out[k:] |= codes[: len(codes) - k] << np.uint64(16 * k)
    return out


def gram_counts(train: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over a frame (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = letter_codes()
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            grams, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in sums:
                before = sums[lang]
                both, place = np.unique(np.concatenate([before[0], grams]), return_inverse=True)
                grams, n = both, np.bincount(place, np.concatenate([before[1], n])).astype(np.int64)
            sums[lang] = grams, n

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for rows, codes, first, end in char_runs(batch.column("text"), order - 1, lower=True):
                grams = packed(code[codes], order)
                by_lang: dict[str, list[int]] = {}
                for i, row in enumerate(rows.tolist()):
                    by_lang.setdefault(langs[row], []).append(i)
                for lang, members in by_lang.items():
                    held.setdefault(lang, []).append(np.concatenate([grams[first[i] : end[i]] for i in members]))
            for lang in [k for k, v in held.items() if sum(map(len, v)) > HELD_GRAMS]:
                fold(lang)
        for lang in list(held):
            fold(lang)
        for lang, (grams, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return train.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1))


def kneser_ney(counts: DataFrame, order: int, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 .. order: (lang, gram, n, p) and (lang, gram of the context, back), ``back`` being the weight of the lower order."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", _suffix(k + 1).alias("gram")).agg(F.count("*").alias("n"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        table = scratch.store(tables[k], f"counts{k}")
        # counts of counts give the discount of the order
        rare = table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
        discount = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
        table = table.withColumn("context", F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long"))
        contexts = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(rare.select("lang", discount.alias("d")), "lang")
        contexts = scratch.store(contexts.withColumn("back", F.col("d") * F.col("kinds") / F.col("total")), f"contexts{k}")
        grams = table.join(contexts, ["lang", "context"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if k == 1:
            # below the single characters every one of the 65,536 codes is as likely
            grams = grams.select("lang", "gram", "n", (own + F.col("back") / 65_536).alias("p"))
        else:
            lower = out[-1][0].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            grams = grams.withColumn("suffix", _suffix(k)).join(lower, ["lang", "suffix"]).select("lang", "gram", "n", (own + F.col("back") * F.col("lower")).alias("p"))
        out.append((scratch.store(grams, f"grams{k}"), contexts.select("lang", F.col("context").alias("gram"), "back", F.col("total").alias("n"))))
    return out


@dataclass
class HashArray:
    """Values of 64-bit keys, sorted by the hash of the key, with a directory over its leading bits."""

    keys: np.ndarray
    values: np.ndarray
    directory: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)
    deepest: int = field(init=False)

    def __post_init__(self) -> None:
        with np.errstate(over="ignore"):
            hashed = mix(self.keys.astype(np.uint64) + np.uint64(1))
        order = np.argsort(hashed)
        self.keys, self.values = hashed[order], np.ascontiguousarray(self.values[order])
        bits = max(int(len(self.keys)).bit_length() + 1, 1)
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.directory).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        with np.errstate(over="ignore"):
            hashed = mix(keys + np.uint64(1))
        slot = (hashed >> self.shift).astype(np.int64)
        at, stop = self.directory[slot].astype(np.int64), self.directory[slot + 1]
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == hashed
        out = np.where(hit, at, -1)
        left = np.flatnonzero(~hit & (at + 1 < stop))
        for _ in range(1, self.deepest):
            if not len(left):
                break
            at[left] += 1
            hit = self.keys[at[left]] == hashed[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (at[left] + 1 < stop[left])]
        return out


@dataclass
class LanguageModel:
    settings: LanguageSettings
    langs: list[str]
    grams: list[HashArray]  # order 1, 2, ...: log p of every language
    backs: list[HashArray]  # log weight of the lower order by context, for orders 2, 3, ...
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def log_p(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Log probability of the last code of each n-gram in every language."""
        if not order:
            return np.full((len(grams), len(self.langs)), -np.log(65_536.0), np.float32)
        at = self.grams[order - 1].find(grams)
        out = self.grams[order - 1].values[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            low = grams[new] & np.uint64((1 << (16 * (order - 1))) - 1)
            lower = self.log_p(low, order - 1)
            context = self.backs[order - 1].find(grams[new] >> np.uint64(16))
            weight = self.backs[order - 1].values[context]
            out[new] = lower + np.where((context >= 0)[:, None], weight, 0)
        return out

    def entropies(self, column: pa.Array, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in every language, and whether there is a letter."""
        order = self.settings.order
        sums = np.zeros((len(column), len(self.langs)))
        sizes, letters = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for rows, codes, first, end in char_runs(column, order - 1, lower=True):
            plain = code[codes]
            run = np.zeros((len(codes) + 1, len(self.langs)))
            np.cumsum(self.log_p(packed(plain, order), order), axis=0, dtype=np.float64, out=run[1:])
            letter = np.concatenate([[0], np.cumsum(plain != 0x20)])
            np.add.at(sums, rows, run[end] - run[first])
            np.add.at(sizes, rows, end - first)
            np.add.at(letters, rows, letter[end] - letter[first])
        return -sums / np.maximum(sizes, 1)[:, None], letters > 0

    def posterior(self, entropies: np.ndarray) -> np.ndarray:
        z = -self.temperature * (entropies - entropies.min(axis=1, keepdims=True))
        return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, held_out, lang_pred, score, cross_entropy and accepted of every row of docs."""
        model = self
        source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
        kind = source.schema["doc_id"].dataType.simpleString()

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = letter_codes()
            for batch in batches:
                n = batch.num_rows
                if model.langs:
                    entropy, known = model.entropies(batch.column("text"), code)
                    best = entropy.argmin(axis=1)
                    lowest = entropy[np.arange(n), best]
                    score = np.where(known, model.posterior(entropy)[np.arange(n), best], 0.0)
                    accepted = known & (lowest <= model.limits[best])
                    names = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
                else:
                    names, score, lowest, accepted = ["und"] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
                arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(lowest), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

        return source.mapInArrow(apply, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")


def _wide(table: DataFrame, langs: list[str], value: str, least_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the entries above the share in some language, and their log values by language (nan where there is none)."""
    total = table.groupBy("lang").agg(F.sum("n").alias("all"))
    kept = table.join(total, "lang").where(F.col("n") >= least_share * F.col("all")).select("lang", "gram", F.log(value).alias("value"))
    rows = kept.toPandas()
    keys = np.unique(rows.gram.to_numpy())
    values = np.full((len(keys), len(langs)), np.nan, np.float32)
    place = {lang: i for i, lang in enumerate(langs)}
    values[np.searchsorted(keys, rows.gram.to_numpy()), rows.lang.map(place).to_numpy(np.int64)] = rows.value.to_numpy()
    return keys.view(np.uint64), values


def fit_language(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Learn from docs (doc_id, text, lang) outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "language")
    train = docs.where("text is not null and lang is not null").where(~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    orders = kneser_ney(gram_counts(train.select("lang", "text"), settings.order), settings.order, scratch)
    langs = sorted(r.lang for r in orders[0][0].select("lang").distinct().collect())
    model = LanguageModel(settings, langs, [], [])
    for k, (grams, contexts) in enumerate(orders, 1):
        back_keys, backs = _wide(contexts, langs, "back", settings.least_share)
        model.backs.append(HashArray(back_keys, np.nan_to_num(backs, nan=0.0)))
        keys, values = _wide(grams, langs, "p", settings.least_share)
        # an entry of one language is resolved through the lower orders for the others
        low = model.log_p(keys & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)
        at = model.backs[-1].find(keys >> np.uint64(16))
        low = low + np.where((at >= 0)[:, None], model.backs[-1].values[at], 0) if len(model.backs[-1].keys) else low
        model.grams.append(HashArray(keys, np.where(np.isnan(values), low, values).astype(np.float32)))
    if langs:
        calibrate(model, train, scratch)
        scratch.drop("measured")
    for k in range(1, settings.order + 1):
        for name in ("counts", "contexts", "grams"):
            scratch.drop(f"{name}{k}")
    return model


def calibrate(model: LanguageModel, train: DataFrame, scratch: Scratch) -> None:
    """Temperature of the posterior and the largest accepted cross-entropy of each language, from all texts of a frame (lang, text)."""
    losses = [f"loss{k}" for k in range(len(TEMPERATURES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = letter_codes()
        for batch in batches:
            entropy, known = model.entropies(batch.column("text"), code)
            keep = np.flatnonzero(known)
            entropy, langs = entropy[keep], batch.column("lang").take(pa.array(keep))
            n, true = np.arange(len(keep)), np.searchsorted(model.langs, np.array(langs.to_pylist(), str))
            best, gaps = entropy.argmin(axis=1), entropy - entropy.min(axis=1, keepdims=True)
            lost = [np.log(np.exp(-t * gaps).sum(axis=1)) + t * gaps[n, true] for t in TEMPERATURES]
            own = pa.array(entropy[n, best], mask=best != true)
            yield pa.RecordBatch.from_arrays([langs, own, *map(pa.array, lost)], names=["lang", "own", *losses])

    kinds = ", ".join(f"{c} double" for c in losses)
    rows = scratch.store(train.select("lang", "text").mapInArrow(measure, f"lang string, own double, {kinds}"), "measured")
    model.limits = np.full(len(model.langs), np.inf)
    means = rows.agg(*[F.avg(c).alias(c) for c in losses]).head()
    if means[0] is None:
        return
    model.temperature = min(zip(TEMPERATURES, means), key=lambda pair: pair[1])[0]
    # one row per language
    for r in exact_quantiles(rows, ["lang"], "own", {"limit": model.settings.reject_quantile}).collect():
        model.limits[model.langs.index(r["lang"])] = r["limit"]
