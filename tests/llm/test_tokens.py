"""Token counts against the library."""

import random

import public_tokenizers
import tokenizers

from terrascore.llm import tokens as module
from terrascore.llm.tokens import MergeTable, pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n):
    rng = random.Random(3)
    letters = "ab cd 'sllDT é中\n\t\x1c\x85\xa0  😀12½²'_-aaaa  ̀Ωß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(n)]
    return texts + ["a" * 3000, "the" * 500 + " " * 99, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "  hello   \n\n world's ", "", " "]


def test_counts_are_those_of_the_library(spark, small, monkeypatch):
    monkeypatch.setattr(module, "PIECE_CHARS", 500)
    monkeypatch.setattr(module, "REMEMBERED", 300)
    texts = odd_texts(1500) + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    library = tokenizers.Tokenizer.from_file(PATH)
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    for row in token_counts(df, PATH).collect():
        text = "" if row.doc_id < 0 else texts[row.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512), text


def test_runs_of_one_letter_merge_from_the_left():
    library, table = tokenizers.Tokenizer.from_file(PATH), MergeTable(PATH)
    words = ["a" * n for n in range(1, 60)] + ["ab" * n for n in range(1, 30)] + ["l" * n for n in range(1, 40)]
    assert table.counts(words).tolist() == [len(library.encode(w).ids) for w in words]


def test_pieces_make_up_the_text(monkeypatch):
    monkeypatch.setattr(module, "PIECE_CHARS", 7)
    for text in odd_texts(200):
        assert "".join(pieces(text)) == text
