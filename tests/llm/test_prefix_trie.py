"""The trie of conversation prefixes against a dictionary in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from terrascore.llm.prefix_trie import TrieSettings, prefix_trie, turn_sequences, with_shared_starts
from terrascore.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences_by_hand(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((-1 if t is None else t, role or "", text or ""))
    return {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in out.items()}


def shared_by_hand(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = sequences.get(c - c % 20, [])[:h] + own[h:]
    return out


def nodes_by_hand(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        own = (len(m) - 1) * len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in kids
    out = []
    for path, m in members.items():
        ends = sorted(c for c in m if len(sequences[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), kids[path], leaves[path], saved[path], sha))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def random_rows(rng, n, longest):
    rows = []
    for c in rng.sample(range(5 * n), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t if t else rng.choice([None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "ç d e f"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, panel, longest", [(1, 64, 8), (8, 64, 8), (40, 3, 12), (7, 1, 5)])
def test_against_a_dictionary(spark, partitions, panel, longest):
    rows = random_rows(random.Random(partitions), 300, longest)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", words int, turns string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = rows_of(prefix_trie(turn_sequences(frame), TrieSettings(panel=panel)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == nodes_by_hand(sequences_by_hand(rows))


def test_query_against_a_dictionary(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(QUERIES["op12_prefix_trie"](spark, small))
    assert got == nodes_by_hand(shared_by_hand(sequences_by_hand(rows))) and "op12_prefix_trie" in ORACLES


def test_one_conversation_copied_many_times(spark):
    """The copies end in one node that spans most shards; a long conversation stands beside them."""
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(3)] + [(5000 + c, t, "user", f"other {c} {t}") for c in range(500) for t in range(2)]
    rows += [(9000, t, "user", f"same {t}") for t in range(1500)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie(turn_sequences(frame), TrieSettings(shard_turns=300))) == nodes_by_hand(sequences_by_hand(rows))


def test_a_conversation_without_turns(spark):
    """A short conversation whose block has no first one loses all its turns and ends in the root."""
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "only one"), (None, 0, "user", "no id"), (60, None, "user", "null first"), (60, 0, "user", "second"), (61, 1, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    built = with_shared_starts(turn_sequences(frame))
    assert {r.conv_id: len(r.turns) for r in built.collect()}[short] == 0
    assert rows_of(prefix_trie(built)) == nodes_by_hand(shared_by_hand(sequences_by_hand(rows)))


def test_empty(spark):
    assert prefix_trie(with_shared_starts(turn_sequences(spark.createDataFrame([], SCHEMA)))).collect() == []
