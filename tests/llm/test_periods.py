"""Runs of repeated words against a brute-force search, and the digest query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascore.llm.periods import PrefixRanks, RunSettings, WaveletTree, periodic_runs, run_digest, with_repeats
from terrascore.llm.queries import QUERIES


def runs_by_hand(words, least=6, copies=4):
    found, n = set(), len(words)
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, copies * q) and not any(r[0] == i and r[1] == length and q % r[2] == 0 for r in found):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repeated_by_hand(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest_by_hand(doc_id, text):
    words = repeated_by_hand(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = runs_by_hand(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha(lines), sha(collapsed_by_hand(words, runs)))


def random_words(rng):
    out = []
    while len(out) < rng.randrange(1, 120):
        root = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 9))]
        out += (root * rng.randrange(1, 7))[: rng.randrange(1, 50)]
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(1500)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for row in periodic_runs(frame).collect():
        words = texts[row.doc_id]
        want = runs_by_hand(words)
        assert [tuple(r) for r in row.runs] == want, words
        assert row.collapsed == collapsed_by_hand(words, want)


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periods"](spark, small).collect()}
    assert got == {d.doc_id: digest_by_hand(d.doc_id, d.text) for d in docs}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_defined_results(spark):
    long_one = "w " * 50_000
    pair = " ".join(["alpha", "beta"] * 30_000)
    far = " ".join(f"u{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a a a a a a"), (5, "a a a a a a"), (6, "a a a a a"), (None, "x y x y x y x y"), (7, long_one), (8, pair), (9, far), (10, "A a A a A a A a"), (11, "é é é é é é é é é é é é")]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, runs int, start string")
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame).collect()]
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [], "one"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"), (6, [], "a a a a a"), (None, [(0, 8, 2)], "x y"),
            (7, [(0, 50_000, 1)], "w"), (8, [(0, 60_000, 2)], "alpha beta"), (9, [], far), (10, [(0, 8, 2)], "A a"), (11, [(0, 6, 1)], "é é")]
    assert sorted(found, key=str) == sorted(want, key=str)
    digests = run_digest(periodic_runs(frame)).where("doc_id = 5 or doc_id = 1").distinct().orderBy("doc_id").collect()
    assert tuple(digests[0])[:6] == (1, 0, None, None, None, None) and tuple(digests[1])[:6] == (5, 1, 0, 6, 1, 6000)
    assert run_digest(periodic_runs(frame.limit(0))).collect() == []
    assert with_repeats(frame.where("doc_id is null")).collect()[0].text == "x y x y x y x y"


def test_equal_exponents_take_the_first(spark):
    frame = spark.createDataFrame([(1, "p q p q p q p q p q p q z a a a a a a")], "doc_id long, text string")
    row = run_digest(periodic_runs(frame)).collect()[0]
    assert (row.n_runs, row.start, row.period, row.exponent_milli) == (2, 0, 2, 6000)


def test_fewer_copies_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), settings=RunSettings(least_copies=3))


def test_wavelet_tree_and_ranks():
    rng = np.random.default_rng(3)
    values = rng.permutation(777)
    tree = WaveletTree(values)
    for _ in range(300):
        s, e = sorted(rng.integers(0, 778, 2))
        limit = int(rng.integers(0, 777))
        part = np.sort(values[s:e])
        assert tree.below(np.array([s]), np.array([e]), np.array([limit]))[0] == (part < limit).sum()
        if e > s:
            k = int(rng.integers(0, e - s))
            assert tree.pick(np.array([s]), np.array([e]), np.array([k]))[0] == part[k]
    words = np.concatenate([rng.integers(0, 3, 400), [99]])
    order = PrefixRanks(words, len(words)).order
    assert order.tolist() == sorted(range(401), key=lambda i: words[i:].tolist())


def test_no_shuffle(spark, small):
    plan = QUERIES["op11_periods"](spark, small)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert QUERIES["op11_periods"](spark, small).where(F.col("runs_sha256").isNull() | F.col("collapsed_sha256").isNull()).count() == 0
