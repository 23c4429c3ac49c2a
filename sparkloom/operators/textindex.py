"""A persistent inverted index in a folder: segments of postings, marks of deletion, commits.

A segment's postings lie in folders by stamp and by a hash of the term, sorted by term in each file, with positions and the
document's length, so that a search reads the partitions of its own terms, and of these the row groups that can hold them, and no
texts. Every insert and delete has a stamp; a mark kills what has an earlier one. A commit is one small file that names the
stamps it holds; readers see whole commits only, and of an interrupted write nothing. One writer at a time.
"""

from __future__ import annotations

import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import WORD, parsed

POSTINGS = "id string, doc long, term string, tf int, len int, positions array<int>, stamp long, bucket int"
DOCS = "id string, doc long, len int, stamp long"
MARKS = "id string, stamp long"
COMMITS = "number long, stamps array<long>, marks array<long>, n_docs long, n_words long"
DOC = ["id", "doc", "stamp"]
#: Words that one task writes the postings of, so that tasks are as many as an insert or a merge needs.
WORDS_A_TASK = 1_000_000


class TextIndex:
    """buckets: folders of terms, an index's own for good; parts: tasks that write one of them at least, so that a frequent term is not one
    task's. Where a segment has more than WORDS_A_TASK words a task, there are more."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, parts: int = 8):
        self.spark, self.path, self.buckets, self.parts = spark, path.rstrip("/"), buckets, parts
        self._pending: list[tuple[str, int]] = []
        self._last = 0

    def _stamp(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def insert(self, rows: DataFrame) -> None:
        """Adds rows (id, content); null content is empty. Equal rows of one insert are one document; rows of one id and other
        content, or of another insert, are documents each."""
        stamp = self._stamp()
        words = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(WORD), F.lit(0))
        # Texts are dealt by id, not by file; a document's words then meet in its task, so that they are not shuffled.
        dealt = rows.select(F.col("id").cast("string").alias("id"), "content").repartition("id")
        own = dealt.select("id", F.xxhash64("content").alias("doc"), words.alias("words")).withColumn("len", F.size("words"))
        each = own.select("id", "doc", "len", F.posexplode("words").alias("at", "term"))
        terms = each.groupBy("id", "doc", "len", "term").agg(F.array_sort(F.collect_set("at")).alias("positions"))
        own.select("id", "doc", "len").distinct().withColumn("stamp", F.lit(stamp)).write.mode("append").partitionBy("stamp").parquet(f"{self.path}/docs")
        self._write_postings(terms.withColumn("tf", F.size("positions")), stamp)
        self._pending.append(("segment", stamp))

    def _write_postings(self, terms: DataFrame, stamp: int) -> None:
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int")
        rows = terms.select("id", "doc", "term", "tf", "len", "positions", F.lit(stamp).alias("stamp"), bucket.alias("bucket"))
        words = self._read("docs", DOCS).where(F.col("stamp") == stamp).agg(F.sum("len")).first()[0] or 0
        parts = max(self.parts, -(-words // (self.buckets * WORDS_A_TASK)))
        dealt = rows.repartitionById(self.buckets * parts, (F.col("bucket") * parts + F.pmod(F.xxhash64("id", "doc"), F.lit(parts))).cast("int"))
        dealt.sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("stamp", "bucket").parquet(f"{self.path}/postings")

    def delete(self, ids: DataFrame) -> None:
        """Marks all earlier documents of ids (id) as gone."""
        stamp = self._stamp()
        ids.select(F.col("id").cast("string").alias("id"), F.lit(stamp).alias("stamp")).where("id is not null").distinct().write.mode("append").partitionBy("stamp").parquet(f"{self.path}/marks")
        self._pending.append(("mark", stamp))

    def replace(self, rows: DataFrame) -> None:
        self.delete(rows)
        self.insert(rows)

    def head(self) -> dict:
        """The last commit."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return {"number": 0, "stamps": [], "marks": [], "n_docs": 0, "n_words": 0}
        return self._read("commits", COMMITS).orderBy(F.desc("number")).first().asDict()

    def commit(self) -> None:
        """Makes what was inserted and deleted since the last commit seen."""
        head = self.head()
        stamps, marks = ([*head[f], *[s for kind, s in self._pending if kind == k]] for f, k in (("stamps", "segment"), ("marks", "mark")))
        self._commit(head["number"] + 1, stamps, marks)

    def _commit(self, number: int, stamps: list[int], marks: list[int]) -> None:
        n_docs = n_words = 0
        if stamps:
            live = self._live(self._read("docs", DOCS).where(F.col("stamp").isin(stamps)), marks)
            n_docs, n_words = live.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        row = self.spark.createDataFrame([(number, stamps, marks, n_docs, n_words)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self._pending = []

    def _live(self, rows: DataFrame, marks: list[int]) -> DataFrame:
        if not marks:
            return rows
        dead = self._read("marks", MARKS).where(F.col("stamp").isin(marks)).groupBy("id").agg(F.max("stamp").alias("dead_at"))
        return rows.join(dead, "id", "left").where("dead_at is null or dead_at < stamp").drop("dead_at")

    def merge(self) -> None:
        """Commits, then writes all that is live as one segment without marks."""
        self.commit()
        head = self.head()
        if not head["stamps"]:
            return
        stamp = self._stamp()
        of = lambda name, schema: self._live(self._read(name, schema).where(F.col("stamp").isin(head["stamps"])), head["marks"])
        # The old stamp stays in a document's key, as equal rows of two inserts are two documents.
        key = F.xxhash64("doc", "stamp").alias("doc")
        of("docs", DOCS).select("id", key, "len", F.lit(stamp).alias("stamp")).write.mode("append").partitionBy("stamp").parquet(f"{self.path}/docs")
        self._write_postings(of("postings", POSTINGS).select("id", key, "term", "tf", "len", "positions"), stamp)
        self._commit(head["number"] + 1, [stamp], [])

    def postings(self, terms: list[str], *more: str) -> DataFrame:
        """Live postings of terms, from their partitions alone."""
        head = self.head()
        if not head["stamps"] or not terms:
            return self.spark.createDataFrame([], POSTINGS).select(*DOC, "term", "tf", "len", *more)
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        rows = self._read("postings", POSTINGS).where(F.col("stamp").isin(head["stamps"]) & F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return self._live(rows.select(*DOC, "term", "tf", "len", *more), head["marks"])

    def search(self, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The k documents (id, score) of greatest BM25 score over the words that a query asks for, of those it allows: all that
        is needed, nothing that is excluded, and of the rest one word or phrase at least where nothing is needed."""
        clauses, head = parsed(query), self.head()
        asked = sorted({w for kind, words in clauses if kind != "not" for w in words})
        terms = sorted({w for _, words in clauses for w in words})
        long = [(i, words) for i, (_, words) in enumerate(clauses) if len(words) > 1]
        rows = self.postings(terms, *["positions"] * bool(long))
        found = rows.select(*DOC, F.explode(F.array_compact(F.array(*[F.when(F.col("term") == w[0], F.lit(i)) for i, (_, w) in enumerate(clauses) if len(w) == 1], F.lit(None).cast("int")))).alias("clause"))
        for i, words in long:
            starts = F.array_compact(F.array(*[F.when(F.col("term") == w, F.lit(j)) for j, w in enumerate(words)]))
            # A phrase stands where all its words point to one start.
            each = rows.where(F.col("term").isin(words)).select(*DOC, F.explode(starts).alias("j"), "positions").select(*DOC, "j", F.explode("positions").alias("at"))
            whole = each.groupBy(*DOC, (F.col("at") - F.col("j")).alias("start")).agg(F.count_distinct("j").alias("n")).where(F.col("n") == len(words))
            found = found.unionByName(whole.select(*DOC, F.lit(i).alias("clause")).distinct())
        allowed = found.groupBy(*DOC).agg(F.collect_set("clause").alias("met")).where(_allows(clauses))
        df = rows.where(F.col("term").isin(asked)).groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
        n, mean = head["n_docs"], head["n_words"] / max(head["n_docs"], 1)
        idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
        scored = rows.where(F.col("term").isin(asked)).join(F.broadcast(df), "term").groupBy(*DOC).agg(F.sum(part).alias("score"))
        return allowed.join(scored, DOC).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _allows(clauses: list[tuple[str, list[str]]]) -> Column:
    has = lambda i: F.array_contains("met", i)
    must, should = ([has(i) for i, (kind, _) in enumerate(clauses) if kind == x] for x in ("must", "should"))
    ok = F.lit(bool(must or should))
    for c in must:
        ok = ok & c
    for c in [has(i) for i, (kind, _) in enumerate(clauses) if kind == "not"]:
        ok = ok & ~c
    if should and not must:
        one = F.lit(False)
        for c in should:
            one = one | c
        ok = ok & one
    return ok
