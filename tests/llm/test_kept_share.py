"""Rare levels do not decide how much of all the pipeline keeps."""

import logging

import pytest

import corpus_pipeline
from terrascore.llm.common import Scratch
from terrascore.llm.mixing import MixingSettings, cell_weights, measured, mix_to_targets, shares_kept


@pytest.fixture
def skewed(spark):
    rows = [(i, "river " * 3000, "en", "hot" if i % 3 else "web") for i in range(120)] + [(1000 + i, "river", "en", f"rare{i}") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_half_of_the_tokens_stay_whatever_is_rare(skewed, caplog):
    with caplog.at_level(logging.INFO):
        rows = mix_to_targets(skewed, corpus_pipeline.MIXING).toPandas()
    assert (rows.n_tokens * rows.probability).sum() / rows.n_tokens.sum() == pytest.approx(0.5, rel=1e-3)
    assert set(rows.probability[rows.source.str.startswith("rare")]) == {1.0}
    assert "50.0% of the tokens are kept, 5 levels fall short" in caplog.text and "source rare0" in caplog.text
    exact = mix_to_targets(skewed).toPandas()
    assert (exact.n_tokens * exact.probability).sum() / exact.n_tokens.sum() < 0.4


def test_levels_that_fall_short_are_told(spark, skewed):
    dimensions = list(corpus_pipeline.MIXING.targets)
    cells = cell_weights(measured(skewed, dimensions, "doc_id", "text"), corpus_pipeline.MIXING, Scratch(spark, "shares"))
    shares = {r.level: r.share / r.target for r in shares_kept(cells, dimensions).where("dimension = 'source'").collect()}
    assert len(shares) == 7 and all(shares[f"rare{i}"] < 0.99 for i in range(5)) and shares["hot"] == pytest.approx(shares["web"], rel=1e-3)


def test_a_column_named_topic_is_not_the_topic(spark):
    rows = [(i, f"plain words {i}", "en", "s", "own") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    topics = lambda settings: {r.topic for r in mix_to_targets(docs, settings).collect()}
    assert topics(MixingSettings()) != {"own"} and topics(MixingSettings(topic_column="topic")) == {"own"}


def test_sweeps_that_do_not_suffice_are_told(spark, skewed, caplog):
    mix_to_targets(skewed, MixingSettings(sweeps=1, tolerance=0.0)).count()
    assert "after 1 sweeps a margin is still off" in caplog.text
