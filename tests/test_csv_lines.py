"""CSV by lines against CSV by texts, with quotes, breaks, prefaces and files cut into many splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from terrascore.sources import csv_lines, landing

RULE = "struct<sep string, skip_rows int, has_header boolean, quotechar string>"


def by_texts(df):
    rule = F.col("rule")
    read = landing.csv_records(df, F.col("text"), rule["sep"], rule["skip_rows"], rule["has_header"], rule["quotechar"], "records")
    return {(r.id, r.record_no): r.record for r in landing.explode_records(read.select("id", "records")).collect()}


def by_lines(df):
    return {(r.file, r.record_no): r.record for r in csv_lines.csv_rows(csv_lines.text_lines(df, "id", F.col("text"), F.col("rule"))).collect()}


@pytest.mark.parametrize("chunk", [3, csv_lines.CHUNK_LINES])
def test_lines_give_what_texts_give(spark, monkeypatch, chunk):
    monkeypatch.setattr(csv_lines, "CHUNK_LINES", chunk)
    draw = random.Random(11)
    texts = ["", None, "\n\n", "a,b\r\n1,2\r\n", 'a,"b\nc"\n"1\n\n2",3\n4', 'a,a,b\n1,2,3,4,5\n"open,1\n2,3\n', " \na;b\n\n1;2"]
    texts += ["".join(draw.choice(["a", "1", ",", ",", "\n", "\n", '"', '""', " ", ";", "\r\n"]) for _ in range(draw.randrange(80))) for _ in range(60)]
    rules = [(",", 0, True, '"'), (",", 2, True, '"'), (";", 0, False, '"'), (",", 1, False, "'")]
    df = spark.createDataFrame([(i, t, rules[i % 4 if i > 6 else 0]) for i, t in enumerate(texts)], f"id int, text string, rule {RULE}")
    ours, expected = by_lines(df), by_texts(df)
    assert len(expected) > 100 and ours == expected


def test_a_file_is_read_in_splits(spark, tmp_path):
    rows = [(str(i), f'say "{i}",\nline two' if i % 3 == 0 else f"plain {i}", "x" * (i % 50)) for i in range(3_000)]
    with open(tmp_path / "report.csv", "w", newline="") as out:
        out.write("Report\n\n")
        csv.writer(out, lineterminator="\n").writerows([("n", "note", "pad"), *rows])
    (tmp_path / "other.txt").write_text("not asked for")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = csv_lines.file_lines(spark, str(tmp_path), [landing.FileRule("reports", "report*.csv", skip_rows=2)])
        assert lines.select("chunk._block").distinct().count() > 5
        got = csv_lines.csv_rows(lines).orderBy("record_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.record_no for r in got] == list(range(len(rows)))
    assert [(r.record["n"], r.record["note"], r.record["pad"]) for r in got] == [(a, b, c or None) for a, b, c in rows]
