"""Leaks beyond the templates: literal copies, as the pipeline drops them."""

import pytest
from test_native import QUESTION

import corpus_pipeline
from terrascore.llm.decontamination import leaks


@pytest.fixture
def found(spark):
    def run(texts, items):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        return sorted((r.doc_id, r.item_id) for r in leaks(docs, benchmark, corpus_pipeline.LEAKS).collect())

    return run


def test_copies_in_another_case_are_leaks(found):
    renamed = "A train leaves Denver at 7 pm and drives 90 miles to reach Dallas where Ann waits with Ann and 7 friends today"
    other = "A train leaves Denver at 7 pm and drives 90 miles to reach Dallas where Ann waits with Bob and 7 friends today"
    assert found([QUESTION.upper(), QUESTION.lower(), QUESTION, renamed, other, "nothing of it"], [QUESTION]) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_one_edited_slot_leaves_the_literal_windows(found):
    assert found([QUESTION.replace("with Tom", "with Sam")], [QUESTION]) == [(0, 0)]


@pytest.mark.parametrize("n_words, n_copied", [(52, 26), (52, 13), (200, 100)])
def test_a_long_passage_of_a_longer_item_is_a_leak(found, n_words, n_copied):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n_words)]
    passage, short = " ".join(words[5 : 5 + n_copied]), " ".join(words[5:17])
    assert found([f"before it {passage} after it", f"before it {short} after it"], [" ".join(words)]) == [(0, 0)]
    # the passage has to be in a row
    broken = " and ".join(" ".join(words[k : k + 8]) for k in (0, 8, 16))
    assert found([broken], [" ".join(words)]) == []


@pytest.mark.parametrize("item", ["1 1 2 3 5 8 13 21 34 55 89 144", "Dear Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jana", "3 kg 4 kg 5 kg 6 kg 7 kg"])
def test_an_item_of_placeholders_is_found_as_it_stands(found, item):
    other = "7 1 9 3 2 8 10 20 30 50 90 100 Dear Karl Lena Max Nina Olaf Paul Rosa Sven Tina Ulla 9 kg 8 kg 1 kg 2 kg 3 kg"
    assert found([f"so it begins. {item} and so on", other], [item]) == [(0, 0)]


def test_items_of_one_or_two_words_are_listed_and_not_looked_for(spark):
    from terrascore.llm.decontamination import leaks, short_items

    benchmark = spark.createDataFrame([(1, "Paris"), (2, "the river"), (3, "which river crosses it"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"text {i} of Paris and the river") for i in range(5)] + [(9, "say which river crosses it now")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(docs, benchmark).collect()] == [(9, 3)]
    assert sorted(r.item_id for r in short_items(benchmark).collect()) == [1, 2, 4]
