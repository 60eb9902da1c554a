"""The n-gram Jaccard join against comparing all pairs."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from terrascore.llm import ngram_join as module
from terrascore.llm.ngram_join import ngram_join


def sets_of(texts):
    out = {}
    for i, text in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        out[i] = frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    return out


def brute(texts):
    sets, owners = sets_of(texts), defaultdict(list)
    for i, s in sets.items():
        for g in s:
            owners[g].append(i)
    common = defaultdict(int)
    for ids in owners.values():
        for a, b in combinations(ids, 2):
            common[a, b] += 1
    links, root = defaultdict(int), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in texts}


def corpus(seed):
    """Copies, chains of near copies around the threshold, shared passages, and texts of common words only."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(40)]
    texts, base = [], [word() for _ in range(120)]
    for k in range(260):  # one large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    for _ in range(40):
        own = [word() for _ in range(rng.randrange(1, 160))]
        at = rng.randrange(len(own))
        texts.append(own[:at] + passage + own[at:])
    for _ in range(30):
        chain = [word() for _ in range(100)]
        for _ in range(4):
            texts.append(list(chain))
            chain = chain[rng.randrange(1, 12) :] + [word() for _ in range(rng.randrange(1, 12))]
    for _ in range(40):
        texts.append([rng.choice("abc") for _ in range(rng.randrange(1, 12))])
    texts += texts[:20]
    rng.shuffle(texts)
    return {i: " ".join(t).capitalize() if t else "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components_of_every_text(spark, monkeypatch, seed):
    # small groups and blocks, so that large ones are really split
    monkeypatch.setattr(module, "GROUP_SETS", 16)
    monkeypatch.setattr(module, "BUCKET_SHINGLES", 2_000)
    monkeypatch.setattr(module, "HELD_SHINGLES", 1_000)
    monkeypatch.setattr(module, "MATRIX_COLUMNS", 64)
    texts = corpus(seed) | {-1: None, -2: "", -3: "Only four words here", -4: "only FOUR words here"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join(df).collect()}
    assert found == brute(texts)


def test_long_words_hash_alike_wherever_they_stand(spark, monkeypatch):
    from terrascore.llm import common

    monkeypatch.setattr(common, "PASS_BYTES", 64)
    long = "z" * 200
    texts = {1: f"a b {long} c d e f", 2: f"{'q ' * 50}a b {long} c d e f", 3: f"a b {long} c d e f", 4: f"a b {long}z c d e f"}
    found = {r.doc_id: r for r in ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found[1].component_id == found[3].component_id == 1
    assert {i: found[i].component_id for i in (2, 4)} == {2: 2, 4: 4}
    assert [found[i].n_shingles for i in (1, 2, 3, 4)] == [3, 8, 3, 3]
