"""Exact copies against plain Python, one group with a third of all rows, and the plan."""

import hashlib
import random
import re

from terrascore.llm.content_sort import exact_copies
from terrascore.llm.queries import ORACLES, QUERIES


def by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out, seen = [], set()
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        first = min(groups[body], key=lambda r: (r[0], r[1], r[2] or 0))
        out.append((i, first[2], len(groups[body]), (-len(t or ""), i is None, i) == first and body not in seen, hashlib.sha256(body.encode()).hexdigest()))
        if out[-1][3]:
            seen.add(body)
    return sorted(out, key=str)


def test_against_plain_python(spark):
    rng = random.Random(2)
    base = ["", "a", "a b", "ab", "é😀 x", "same start and then one", "same start and then two", "long " * 20_000, "A b", "\t", "a\x0bb\x0c", "a b", "a\x1cb"]
    rows = [(i, rng.choice([*base, None])) for i in range(400)]
    rows += [(1000 + i, " hot text" + " " * (i % 7)) for i in range(300)] + [(None, "hot text       "), (None, "alone"), (5, rows[5][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, size int, salt int, body string").repartition(7)
    assert sorted((tuple(r) for r in exact_copies(frame).collect()), key=str) == by_hand(rows)
    assert exact_copies(frame.limit(0)).collect() == []


def test_ids_of_another_type(spark):
    frame = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y y"), ("d", "yy")], "key string, body string")
    assert sorted(tuple(r)[:4] for r in exact_copies(frame, "key", "body").collect()) == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 2, True), ("d", "c", 2, False)]


def test_a_hot_group_is_spread(spark):
    """Every third row has one text: no range of the sort and no key of the join holds more than a few of them."""
    frame = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text for all', concat('text ', id)) as text")
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = exact_copies(frame)
        assert out.where("kept").count() == 20_001 and out.agg(F.max("group_size")).first()[0] == 10_000
        salt = F.pmod(F.xxhash64("doc_id", F.length("text").cast("long")), F.lit(1024))
        ranges = frame.withColumn("salt", salt).repartitionByRange(F.substring(F.replace("text", F.lit(" "), F.lit("")), 1, 16), F.sha2("text", 256), "salt")
        sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_exchange_of_texts_and_no_python(spark, small):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    plan = QUERIES["op13_exact_copies"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = spark.range(10).selectExpr("id as a", "id % 3 as b", "cast(id as string) as body").repartitionByRange("a", "b")
    ranged = rows.select(F.lag("body").over(Window.partitionBy("a", "b").orderBy("body")))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in ranged and "hashpartitioning" not in ranged
    assert "op13_exact_copies" in ORACLES
