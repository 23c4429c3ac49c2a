"""The persistent text index: what each operation makes seen, and what a search reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.search import matching
from sparkloom.operators import textindex
from sparkloom.operators.textindex import TextIndex

SCHEMA = "id string, content string"
ROWS = [("a", "The quick brown fox, the quick fox"), ("b", "quick quick brown"), ("c", "brown the fox"), ("d", None), ("e", ""), ("f", "Fox THE fox"), ("f", "another text of one id")]


def ids(found):
    return sorted(r["id"] for r in found.collect())


def test_lifecycle(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4, parts=2)
    assert index.search("fox", 9).collect() == []
    index.commit()
    index.insert(spark.createDataFrame([*ROWS, ROWS[0]], SCHEMA))
    assert index.search("fox", 9).collect() == []  # not committed
    index.commit()
    assert ids(index.search("fox", 9)) == ["a", "c", "f"] and index.head()["n_docs"] == 7
    index.delete(spark.createDataFrame([("c", 1), (None, 1), ("zz", 1)], "id string, stamp int"))
    index.replace(spark.createDataFrame([("b", "a fox now")], SCHEMA))
    assert ids(index.search("fox", 9)) == ["a", "c", "f"]
    index.commit()
    again = TextIndex(spark, f"file://{tmp_path}/i", buckets=4, parts=2)  # opened anew
    for _ in range(2):  # before and after a merge
        assert ids(again.search("fox", 9)) == ["a", "b", "f"] and ids(again.search("quick", 9)) == ["a"]
        assert (again.head()["n_docs"], again.head()["n_words"]) == (6, 7 + 3 + 3 + 5)
        again.merge()
    assert len(again.head()["stamps"]) == 1 and again.head()["marks"] == []
    again.insert(spark.createDataFrame([ROWS[0]], SCHEMA))  # an equal row of another insert is a document of its own
    again.merge()
    assert ids(again.search("quick", 9)) == ["a", "a"]
    again.delete(spark.createDataFrame([("a",)], "id string"))
    again.commit()
    assert again.search("quick", 9).collect() == [] and again.head()["n_docs"] == 5


def test_queries_equal_a_scan(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}", c) for i, (_, c) in enumerate(ROWS)], SCHEMA)
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=3, parts=1)
    index.insert(rows)
    index.commit()
    for query in ('"quick brown"', '"quick fox" brown', "+the -quick", '"the quick fox"', '"fox the fox"', "NOT fox", "fox AND brown", "", '"quick quick"', "unknown", 'text "one id"'):
        assert ids(index.search(query, 99)) == ids(matching(rows, query)), query


def test_a_search_reads_its_terms_partitions(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=16, parts=1)
    index.insert(spark.createDataFrame(ROWS, SCHEMA))
    index.commit()
    plan = index.postings(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(term,fox)" in plan.split("PushedFilters")[1]
    assert "content" not in plan and len({p.name for p in (tmp_path / "i" / "postings").glob("*/*") if p.is_dir()}) > 3


def test_tasks_that_write_postings_grow_with_the_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "WORDS_A_TASK", 100)
    docs = spark.range(100).select("id", F.repeat(F.lit("the one "), 20).alias("content"))
    index = textindex.TextIndex(spark, f"file://{tmp_path}/grown", buckets=2, parts=1)
    index.insert(docs)
    index.merge()
    for stamp in (tmp_path / "grown/postings").glob("stamp=*"):
        assert max(len(list(b.glob("*.parquet"))) for b in stamp.glob("bucket=*")) >= 15  # up to 20: 4,000 words by 2 folders and 100 a task
    assert index.postings(["the"]).count() == 100
