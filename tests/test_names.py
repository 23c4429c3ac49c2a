"""Names in texts against plain search, and work that does not grow with pairs of names and texts."""

from __future__ import annotations

import random

from sparkloom.operators.names import LONG, name_counts


def shuffled_rows(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    lists = lambda: spark._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, sc._gateway.new_array(spark._jvm.double, 0), lists())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def counted(spark, names, texts) -> dict:
    return {r["name"]: r["n"] for r in name_counts(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in texts], "content string")).collect()}


def test_counts_equal_plain_search(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé😀 1\n") for _ in range(n))
    texts = [word(rng.randrange(0, 60)) for _ in range(300)] + ["aab" * 200, "aab" * 200, "b" * 700_000 + "é1", "", None] + ["x" * 300 + "y" + "x" * 300]
    names = {word(rng.randrange(1, 9)) for _ in range(400)} | {"a", "é", "😀", "aab" * 85, "aab" * 86, "aab" * 201, "bé1", "x" * LONG, "x" * 301, "x" * 299 + "y", "x" * 300 + "yx", "absent", "", None}
    want = {n: k for n in names if n and (k := sum(t is not None and n in t for t in texts))}
    assert counted(spark, names, texts) == want and len(want) > 150


def test_names_of_one_beginning_do_not_meet_all_texts(spark):
    names = [f"almond {i:05d}" for i in range(3000)]
    texts = [f"text {i} almond {i * 7:05d}" for i in range(3000)]
    before = shuffled_rows(spark)
    got = counted(spark, names, texts)
    assert got == {f"almond {i * 7:05d}": 1 for i in range(429)}
    assert shuffled_rows(spark) - before < 100_000
