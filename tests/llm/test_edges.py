"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest

import corpus_pipeline
from terrascore.llm.decontamination import leaks
from terrascore.llm.language import fit_language
from terrascore.llm.mixing import mix_to_targets
from terrascore.llm.ngram_join import ngram_join
from terrascore.llm.quality import fit_quality, graded
from terrascore.llm.rules import quality_rules
from terrascore.llm.secrets import digest, secret_scan
from terrascore.llm.sharding import shards
from terrascore.llm.tokens import token_counts
from terrascore.llm.toxicity import fit_toxicity

CLASHES = ["row", "hash", "bytes", "cell", "depth", "bucket", "set_key", "text_key", "n", "words", "kept", "label", "score", "shard", "draw", "tokens", "_id", "_key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)
PROSE = "The quick brown fox and the lazy dog of the house walk to the river in the morning and look for it all day long."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, PROSE), (5, PROSE), (None, PROSE + " again"), (None, None), (7, "a"), (8, "word " * 40_000), (9, "x" * 300_000), (10, "é中😀 " * 30), (11, "one two three four"), (12, "one two three four")]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, *[k] * len(CLASHES)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (5, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "some question that is in no text at all here"), (None, None), (3, "")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "quality": lambda d: fit_quality(d, graded(labels)).score(d),
        "toxicity": lambda d: fit_toxicity(d, labels).score(d),
        "mixing": mix_to_targets,
        "ngram_join": ngram_join,
        "rules": quality_rules,
        "sharding": lambda d: shards(d, 1000),
        "secrets": lambda d: digest(secret_scan(d)),
        "tokens": lambda d: token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        "language": lambda d: fit_language(d).predict(d),
        "leaks": lambda d: leaks(d, benchmark),
    }


NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_every_row(docs, labels, benchmark, name):
    out = operators(labels, benchmark)[name](docs).collect()
    assert len(out) == (0 if name == "leaks" else docs.count())


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_an_empty_result(docs, labels, benchmark, name):
    assert operators(labels, benchmark)[name](docs.limit(0)).count() == 0


def test_stages_keep_the_columns(spark, docs, small, tmp_path):
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, small).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        else:
            assert set(docs.columns) <= set(after.columns) and "shard" in after.columns
        now = after


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_input(spark, docs, small, number):
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, docs, small).count() <= docs.count()
    assert stage(spark, docs.limit(0), small).count() == 0


def test_near_copies_leave_one_of_equal_rows(spark, docs, small):
    left = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in corpus_pipeline.drop_near_copies(spark, docs, small).collect())
    # 1, 5, 5 and the null id share a text nearly; 11 and 12 share one; texts without words stay
    assert [i for i, _ in left] == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
