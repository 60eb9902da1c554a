"""Language, toxicity and quality models: estimates against brute force, gradients, held-out accuracy."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch, char_runs, held_out
from terrascore.llm.descent import minimise
from terrascore.llm.language import HashArray, LanguageSettings, fit_language, gram_counts, kneser_ney
from terrascore.llm.quality import cumulative_link, fit_quality, graded, thresholds
from terrascore.llm.toxicity import ToxicitySettings, fit_toxicity, log_count_ratios, weighted_logistic

TEXTS = [("x", "abab bab abba"), ("x", "ab ba bab"), ("y", "ccdc dcd dd"), ("y", "cd dc")]

logistic = weighted_logistic(np.ones(2))


def kneser_ney_by_hand(texts, order):
    """p(gram) of every seen n-gram, by the textbook."""
    counts = Counter()
    for text in texts:
        padded = " " * (order - 1) + text
        counts.update(padded[i : i + order] for i in range(len(text)))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    p = {}

    def prob(gram):
        if not gram:
            return 1 / 65_536
        table = tables[len(gram)]
        ones, twos = (sum(1 for n in table.values() if n == c) for c in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return prob(gram[1:])
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * prob(gram[1:])

    for table in tables.values():
        for gram in table:
            p[gram] = prob(gram)
    return p, prob


def pack(gram):
    out = 0
    for c in gram:
        out = out << 16 | ord(c)
    return out - (1 << 64) if out >= 1 << 63 else out


def test_kneser_ney_estimates(spark):
    order = 3
    frame = spark.createDataFrame(TEXTS, "lang string, text string")
    orders = kneser_ney(gram_counts(frame, order), order, Scratch(spark, "test"))
    for lang in ("x", "y"):
        p, _ = kneser_ney_by_hand([t for k, t in TEXTS if k == lang], order)
        found = {(k, r.gram): r.p for k, (grams, _) in enumerate(orders, 1) for r in grams.where(F.col("lang") == lang).collect()}
        assert found == pytest.approx({(len(g), pack(g)): v for g, v in p.items()})


def test_cross_entropy_backs_off_like_the_estimates(spark):
    rows = [(k, lang, t) for k, (lang, t) in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    model = fit_language(docs, LanguageSettings(order=3, least_share=0))
    learned = {r.doc_id for r in docs.where(~held_out()).collect()}
    asked = ["abba cab", "dcdx", "b"]
    out = {r.doc_id: r for r in model.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).collect()}
    for i, text in enumerate(asked):
        entropy = {}
        for lang in ("x", "y"):
            _, prob = kneser_ney_by_hand([t for k, own, t in rows if own == lang and k in learned], 3)
            padded = "  " + text
            entropy[lang] = -sum(np.log(prob(padded[j : j + 3])) for j in range(len(text))) / len(text)
        assert out[i].lang_pred == min(entropy, key=entropy.get)
        assert out[i].cross_entropy == pytest.approx(min(entropy.values()), rel=1e-4)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = fit_language(docs).predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.98
    assert sum(r.accepted for r in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 for r in out)


def test_limits_come_from_every_learning_text(spark):
    """Far more texts than a sample of 4,000 would take: the limit of each language is the exact quantile over all of them."""
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcd" if i % 2 else "cdef"), 6)), "x" if i % 2 else "y") for i in range(9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(docs, LanguageSettings(order=2, reject_quantile=0.75))
    learned = docs.where(~held_out())
    found = model.predict(learned).join(docs.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").collect()
    for i, lang in enumerate(model.langs):
        assert model.limits[i] == pytest.approx(np.quantile([r.cross_entropy for r in found if r.lang == lang], 0.75), abs=1e-12)


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(TEXTS * 4)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3"), (4, "ab")], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.accepted) for r in fit_language(docs).predict(asked).collect()}
    assert [out[i][0] for i in (1, 2, 3)] == ["und"] * 3 and out[4][0] == "x"
    assert not any(out[i][1] for i in (1, 2, 3))


def test_hash_array_finds_keys_and_only_these():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    array = HashArray(keys[::2].copy(), np.arange(len(keys[::2]))[:, None])
    at = array.find(keys)
    assert (at[1::2] == -1).all()
    assert (array.values[at[::2]][:, 0] == np.arange(len(keys[::2]))).all()
    assert (HashArray(keys[:0].copy(), np.zeros((0, 1))).find(keys[:3]) == -1).all()


def test_long_texts_come_in_segments_with_their_context(monkeypatch):
    import pyarrow as pa

    from terrascore.llm import common

    column = pa.array(["abcé" * 40, None, "x", "ÀB" * 50])
    whole = [[] for _ in range(4)]
    for rows, codes, first, end in char_runs(column, 2, lower=True):
        for r, a, b in zip(rows, first, end):
            whole[r] += [tuple(codes[i - 2 : i + 1]) for i in range(a, b)]
    monkeypatch.setattr(common, "PASS_BYTES", 32)
    cut = [[] for _ in range(4)]
    for rows, codes, first, end in char_runs(column, 2, lower=True):
        for r, a, b in zip(rows, first, end):
            cut[r] += [tuple(codes[i - 2 : i + 1]) for i in range(a, b)]
    assert cut == whole and [len(x) for x in whole] == [160, 0, 1, 100]


def numeric(loss, w, *args):
    out = np.zeros(len(w))
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        out[i] = (loss(up, *args)[0] - loss(down, *args)[0]) / 2e-6
    return out


def test_gradients():
    rng = np.random.default_rng(2)
    sizes, ids, values = np.array([2, 3, 1, 0]), np.array([0, 2, 1, 2, 3, 0]), rng.normal(size=6)
    for loss, label, w in (
        (logistic, np.array([0, 1, 1, 0]), rng.normal(size=5)),
        (cumulative_link(4, np.array([1.0, 0.5, 2.0, 1.5])), np.array([0, 3, 1, 2]), np.concatenate([rng.normal(size=4), [-0.5, 0.1, -0.3]])),
    ):
        args = (label, sizes, ids, values)
        assert loss(w, *args)[1] == pytest.approx(numeric(loss, w, *args), abs=1e-5)


def test_thresholds_are_ordered():
    assert (np.diff(thresholds(np.array([-1.0, -5.0, 0.0, 2.0]))) > 0).all()


def test_descent_finds_the_minimum(spark):
    rows = [(int(k % 3 == 0), [k % 4, 4], [1.0, 0.5]) for k in range(240)]
    frame = spark.createDataFrame(rows, "label int, ids array<int>, values array<float>").repartition(3)
    w = minimise(frame, logistic, np.zeros(6), np.full(6, 0.01), 240, steps=60)
    label = np.array([r[0] for r in rows])
    sizes, ids, values = np.full(240, 2), np.array([i for r in rows for i in r[1]]), np.array([v for r in rows for v in r[2]])
    _, grad = logistic(w, label, sizes, ids, values)
    assert np.abs(grad / 240 + 0.01 * w).max() < 1e-3


def test_log_count_ratios(spark):
    frame = spark.createDataFrame([(1, "zzz bad"), (1, "zzz"), (0, "good"), (0, "good zz"), (0, "fine")], "label int, text string")
    settings = ToxicitySettings(orders=(3,), bits=20, least_texts=1, least_ratio=0.0)
    found = Counter(round(r.ratio, 9) for r in log_count_ratios(frame, settings).collect())
    seen = {0: defaultdict(int), 1: defaultdict(int)}
    for label, text in ((1, "zzz bad"), (1, "zzz"), (0, "good"), (0, "good zz"), (0, "fine")):
        padded = "  " + text
        for gram in {padded[i : i + 3] for i in range(len(text))}:
            seen[label][gram] += 1
    expected = Counter(round(np.log((seen[1][g] + 1) / 4) - np.log((seen[0][g] + 1) / 5), 9) for g in {*seen[0], *seen[1]})
    assert found == expected


def test_toxic_held_out_texts_score_higher(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = fit_toxicity(docs, labels).score(docs).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.8
    assert sum(g >= 0.5 for g in good) <= 0.02 * len(good)


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for toxic, expected in ((1, 1.0), (0, 0.0), (None, 0.0)):
        labels = spark.createDataFrame([(1, toxic)], "doc_id long, toxic int")
        assert [round(r.score, 6) for r in fit_toxicity(docs, labels).score(docs).collect()] == [expected] * 2


def test_expected_grade_orders_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = fit_quality(docs, graded(labels)).score(docs).join(labels, "doc_id").where("held_out").collect()
    poor, good = [r.expected_grade for r in out if not r.quality], [r.expected_grade for r in out if r.quality]
    assert np.mean([[p < g for g in good] for p in poor]) > 0.8
    assert np.mean([r.kept for r in out if r.quality]) > 0.97
    for r in out:
        assert r.expected_grade == pytest.approx(sum(r.tails)) and r.tails == sorted(r.tails, reverse=True)


def test_letters_beyond_the_basic_plane(spark):
    """A text of such letters alone has a language, also where the low bits of a letter are those of a space."""
    rows = [(i, chr(0x20020) * 20 + chr(0x10428) * 5, "x") for i in range(40)] + [(100 + i, "plain words of a text", "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, chr(0x20020)), (2, "words"), (3, "\U0001F600 12")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in fit_language(docs).predict(asked).collect()} == {1: "x", 2: "y", 3: "und"}


def test_the_size_of_the_sample_does_not_move_the_scores(spark):
    """With fewer rows taken of the common class the scores near one half stay where they are."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words, 12)) + (" vile" if i % 8 == 0 and rng.random() < 0.7 or rng.random() < 0.05 else ""), int(i % 8 == 0)) for i in range(2400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    means = [fit_toxicity(docs, labels, ToxicitySettings(sample_rows=n)).score(docs).agg({"score": "avg"}).first()[0] for n in (100_000, 600)]
    assert abs(means[0] - 1 / 8) < 0.03 and abs(means[0] - means[1]) < 0.03
