"""The registered query of every operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrascore.llm.content_sort import exact_copies
from terrascore.llm.decontamination import NAME, NUMBER, NUMBER_WORDS, PUNCTUATION, UNIT, UNITS, leaks
from terrascore.llm.language import fit_language
from terrascore.llm.mixing import mix_to_targets
from terrascore.llm.ngram_join import ngram_join
from terrascore.llm.periods import periodic_runs, run_digest, with_repeats
from terrascore.llm.prefix_trie import prefix_trie, turn_sequences, with_shared_starts
from terrascore.llm.quality import fit_quality, graded
from terrascore.llm.rules import STOP_WORDS, quality_rules
from terrascore.llm.secrets import digest, secret_scan
from terrascore.llm.sharding import shards
from terrascore.llm.tokens import token_counts
from terrascore.llm.toxicity import fit_toxicity

Query = Callable[[SparkSession, str], DataFrame]

#: Largest shard in bytes of text.
SHARD_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return fit_quality(docs, graded(table(spark, folder, "labels"))).score(docs)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return fit_toxicity(docs, table(spark, folder, "labels")).score(docs)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_to_targets(table(spark, folder, "documents"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules(table(spark, folder, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards(table(spark, folder, "documents"), SHARD_BYTES, keep=["doc_id"])
    return placed.select("row.doc_id", "bytes", "shard", "depth", "shard_bytes")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return digest(secret_scan(table(spark, folder, "documents")))


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("doc_key")


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return fit_language(docs).predict(docs)


def op11_periods(spark: SparkSession, folder: str) -> DataFrame:
    return run_digest(periodic_runs(with_repeats(table(spark, folder, "documents"))))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(with_shared_starts(turn_sequences(table(spark, folder, "conversations"))))


def op13_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_copies(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_toxicity,
        op3_mixing,
        op4_ngram_join,
        op5_quality_rules,
        op6_sharding,
        op7_secrets,
        op8_tokens,
        op9_decontamination,
        op10_language,
        op11_periods,
        op12_prefix_trie,
        op13_exact_copies,
    )
}

#: Words of the contracts in SQL: A-Z lowered, split on the six white-space bytes.
WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '')"

OP4 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i : list_aggregate(w[i:i + 4], 'string_agg', ' '))
    WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT sizes.doc_id, sizes.n AS n_shingles, min(r) AS component_id, any_value(coalesce(k.links, 0)) AS n_links
FROM sizes JOIN reach USING (doc_id) LEFT JOIN (SELECT x, count(*) AS links FROM links GROUP BY x) k ON k.x = sizes.doc_id GROUP BY ALL
"""

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP5 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
windows AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g FROM p, unnest(range(1, len(w) - 6)) u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
m AS (SELECT p.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x : lower(x) IN ({STOP}))) AS stops,
    len(regexp_extract_all(text, '[A-Z]')) AS uppers, len(list_filter(l, lambda x : regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots,
    len(list_filter(l, lambda x : regexp_matches(x, '^\s*[-*•]\s'))) AS bullets
    FROM p LEFT JOIN covered USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.01
    AND uppers / word_chars <= 0.5 AND n_dup_lines / n_lines <= 0.5 AND dots / n_lines <= 0.3 AND bullets / n_lines <= 0.9 AS kept
FROM v
"""

OP6 = f"""
WITH keys AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h,
    coalesce(octet_length(encode(text)), 0) AS b FROM documents),
levels AS (SELECT d::INTEGER AS d, h >> (60 - d) AS p, sum(b)::BIGINT AS s FROM keys, range(0, 61) r(d) GROUP BY ALL),
first AS (SELECT k.doc_id, min(l.d) AS depth FROM keys k JOIN levels l ON l.p = k.h >> (60 - l.d) WHERE l.s <= {SHARD_BYTES} GROUP BY k.doc_id)
SELECT k.doc_id, k.b::BIGINT AS bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(l.p), depth, '0') END || '.0' AS shard, depth, l.s AS shard_bytes
FROM keys k JOIN first USING (doc_id) JOIN levels l ON l.d = depth AND l.p = k.h >> (60 - depth)
"""

SQL_PUNCTUATION = PUNCTUATION.replace("'", "''")


def _template(words: str) -> str:
    bare = f"trim(x, '{SQL_PUNCTUATION}')"
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    return rf"""list_transform({words}, lambda x, i : CASE WHEN regexp_matches(lower({bare}), '^[0-9][0-9.,/]*$') OR lower({bare}) IN ({listed(NUMBER_WORDS)}) THEN '{NUMBER}'
    WHEN lower({bare}) IN ({listed(UNITS)}) THEN '{UNIT}'
    WHEN {bare} <> lower({bare}) AND substr({bare}, 1, 1) <> lower(substr({bare}, 1, 1)) AND i > 1 AND NOT regexp_matches({words}[i - 1], '[.!?:]["'')»”’]*$') THEN '{NAME}'
    ELSE lower({bare}) END)"""


OP9 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM benchmark),
dt AS (SELECT doc_id, w, {_template('w')} AS t FROM d),
bt AS (SELECT item_id, w, {_template('w')} AS t, least(len(w), 8) AS size FROM b WHERE len(w) >= 3),
dw AS (SELECT doc_id, i AS pos, size, list_aggregate(t[i:i + size - 1], 'string_agg', chr(1)) AS g FROM dt, (SELECT DISTINCT size FROM bt), unnest(range(1, len(t) - size + 2)) u(i)),
bw AS (SELECT item_id, i AS place_at, size, list_aggregate(t[i:i + size - 1], 'string_agg', chr(1)) AS g FROM bt, unnest(range(1, len(t) - size + 2)) u(i)
    WHERE 2 * len(list_filter(t[i:i + size - 1], lambda x : x IN ('{NUMBER}', '{UNIT}', '{NAME}'))) <= size),
total AS (SELECT item_id, count(*) AS n FROM bw GROUP BY item_id),
hits AS (SELECT DISTINCT doc_id, item_id, place_at, pos - place_at AS shift, size FROM dw JOIN bw USING (g, size)),
places AS (SELECT DISTINCT doc_id, item_id, shift, place_at + k AS place FROM hits, unnest(range(0, size)) u(k)),
slots AS (SELECT doc_id, item_id, shift, bt.t[place] AS word, trim(bt.w[place], '{SQL_PUNCTUATION}') AS raw, trim(dt.w[place + shift], '{SQL_PUNCTUATION}') AS value
    FROM places JOIN bt USING (item_id) JOIN dt USING (doc_id) WHERE bt.t[place] IN ('{NUMBER}', '{UNIT}', '{NAME}')),
wrong AS (SELECT DISTINCT doc_id, item_id, shift FROM slots GROUP BY doc_id, item_id, shift, word, raw HAVING min(value) <> max(value)),
good AS (SELECT doc_id, item_id, count(DISTINCT place_at) AS n_matched FROM hits ANTI JOIN wrong USING (doc_id, item_id, shift) GROUP BY ALL)
SELECT doc_id, item_id, n_matched, n AS n_windows, n_matched / n AS cover FROM good JOIN total USING (item_id) WHERE n_matched / n >= 0.5
"""

#: The crc32 of a decimal id, bit by bit.
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x : ascii(x)::BIGINT)),
    lambda crc, b : list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"""

OP12 = rf"""
WITH o AS (SELECT conv_id, list({{'k': coalesce(role, '') || chr(1) || coalesce(text, ''), 'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}}
    ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, t, conv_id - conv_id % 20 AS first_id, {CRC} % 4 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(f.t, [])[1:h], c.t[h + 1:]) AS t FROM c LEFT JOIN o f ON f.conv_id = first_id),
p AS (SELECT conv_id, len(t) AS size, d, list_transform(t[1:d], lambda x : x.k) AS path, CASE WHEN d > 0 THEN t[d].w END AS w FROM r, unnest(range(0, len(t) + 1)) u(d)),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(w), 0) AS saved,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM p GROUP BY d, path),
k AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, path)),
s AS (SELECT a AS d, path[1:a] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM m, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (d, path) LEFT JOIN n up ON up.d = m.d - 1 AND up.path = m.path[1:m.d - 1]
"""

OP13 = r"""
WITH b AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY body) AS group_size
    FROM b WINDOW w AS (PARTITION BY body ORDER BY size DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM g
"""

ORACLES: dict[str, str] = {"op4_ngram_join": OP4, "op5_quality_rules": OP5, "op6_sharding": OP6, "op9_decontamination": OP9, "op12_prefix_trie": OP12, "op13_exact_copies": OP13}
