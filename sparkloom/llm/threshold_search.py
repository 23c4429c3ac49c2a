"""Ranked lexical search by Fagin's threshold algorithm.

A first pass over the documents counts, for the terms of the queries, the documents that hold them, and the totals of
the corpus. A second one ranks: a shard is a run of whole documents (some megabytes) with an impact-sorted list for each
query term and a forward index by document. Lists are read round-robin; a document met for the first time is looked up
in the forward index and scored whole; a query stops when its threshold, the sum of the impacts last read, falls strictly
below its kth score, so no unread document could even tie. A task keeps its best k of a query from shard to shard, so
later shards stop the sooner. Tasks give at most k rows a query; these are ranked within groups of tasks and then
over all, so nothing is cut that could be in a result.

Scores use integers but for the weight's logarithm and are the same whatever the shards. Queries are read in blocks of
at most BLOCK_BYTES of text (or one query); each block is sent, searched and written before the next, so that bounds
what the driver and a task hold of them. Terms are compared by 64-bit hashes.

Defined cases: null, empty or termless documents count in nothing and are never found; null, empty or termless queries have no
rows; a term that a query repeats counts each time; a query id on several rows is searched once for each, with ranks of its
own; equal scores go by ascending doc_id, a null one last; repeated documents are documents each, so a doc_id can be in a result
twice; a term in all documents can weigh 0 and then scores nothing; a very long text is a shard of its own, at some 60 bytes a term;
empty tables give no rows. Columns beside doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext as V
from .base import discard, materialize, spread, table, task_count

K = 10
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
#: Postings that a list gives in a query's first round; each round reads twice as many as the one before.
FIRST_READ = 16
SCALE = 1_000_000_000


class Queries:
    """A block of queries: their terms' hashes, and for each query its terms (as places in these) and how often."""

    def __init__(self, texts: list[str]):
        data, offs = V.buffer_of(pa.array(texts, pa.large_string()))
        h, _, _, upto = V.word_hashes(data, offs, V.ALNUM)
        self.terms, at = np.unique(h, return_inverse=True)
        self.of = [np.unique(at[a:b], return_counts=True) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


class Shard:
    """Postings of one run of documents for the terms of a block, by term (impact-sorted) and by document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, terms: np.ndarray):
        h, _, _, upto = V.word_hashes(data, offs, V.ALNUM)
        self.lengths = np.diff(upto).astype(np.int64)
        at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
        known = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
        doc = np.searchsorted(upto, known, "right") - 1
        keys, self.tf = np.unique(doc * max(len(terms), 1) + at[known], return_counts=True)
        self.doc, self.term = keys // max(len(terms), 1), keys % max(len(terms), 1)
        self.n_terms = len(terms)

    def holders(self) -> np.ndarray:
        """In how many documents each term is."""
        return np.bincount(self.term, minlength=self.n_terms)

    def index(self, weights: np.ndarray, n_docs: int, n_all: int) -> None:
        """Impacts, lists and the forward index, given the weights of terms and the totals of the corpus."""
        m = 100 - 75 + (75 * self.lengths * n_docs) // n_all
        self.impact = weights[self.term] * ((SCALE * self.tf.astype(np.int64)) // (1000 * self.tf + 8 * m[self.doc]))
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = self.doc[order], self.impact[order]
        self.list_start = np.searchsorted(self.term[order], np.arange(self.n_terms + 1))
        self.doc_start = np.searchsorted(self.doc, np.arange(len(self.lengths) + 1))

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Random lookups: whole scores of documents for a query, whose terms' counts are in wanted."""
        begins, sizes = self.doc_start[docs], self.doc_start[docs + 1] - self.doc_start[docs]
        firsts = np.cumsum(sizes) - sizes
        rows = np.repeat(begins - firsts, sizes) + np.arange(sizes.sum())
        sums = np.concatenate(([0], np.cumsum(self.impact[rows] * wanted[self.term[rows]])))
        return sums[firsts + sizes] - sums[firsts]

    def search(self, terms: np.ndarray, counts: np.ndarray, best: tuple[np.ndarray, np.ndarray], names: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The best k of best and this shard, as (scores, names), and how many postings were read. names are the
        documents' ranks in ties: of equal scores the smaller one wins."""
        wanted = np.zeros(self.n_terms, np.int64)
        wanted[terms] = counts
        at, stop = self.list_start[terms].copy(), self.list_start[terms + 1]
        seen = np.zeros(len(self.lengths), bool)
        size, n_read = FIRST_READ, 0
        while (at < stop).any():
            upto = np.minimum(at + size, stop)
            took = upto - at
            firsts = np.cumsum(took) - took
            met = np.unique(self.list_doc[np.repeat(at - firsts, took) + np.arange(took.sum())])
            n_read += int(took.sum())
            met = met[~seen[met]]
            seen[met] = True
            if len(met):
                score = self.scores(met, wanted)
                good = score > 0
                best = top(np.concatenate((best[0], score[good])), np.concatenate((best[1], names[met[good]])), k)
            at, size = upto, size * 2
            # What a document that no list has shown yet could have: the impacts last read, 0 of a list at its end.
            threshold = int((counts * np.where(at < stop, self.list_impact[np.maximum(at - 1, 0)], 0)).sum())
            if len(best[0]) == k and threshold < best[0][-1]:
                break
        return best, n_read


def top(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, highest score first, equal ones by smaller name."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= floor
        scores, names = scores[keep], names[keep]
    order = np.lexsort((names, -scores))[:k]
    return scores[order], names[order]


#: doc_id of a null row inside a task: after all others.
NO_ID = np.iinfo(np.int64).max


def _texts(batches):
    """Ids (null as NO_ID), bytes and offsets of runs of whole documents."""
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        real = np.asarray(ids.is_valid())
        ids = np.where(real, np.asarray(ids.fill_null(0)), NO_ID)
        for a, b, data, offs in V.chunks(batch.column("text"), SHARD_BYTES):
            yield ids[a:b], data, offs


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each of the given terms is."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        n_docs, n_all, df = 0, 0, np.zeros(len(sent.value), np.int64)
        for _, data, offs in _texts(batches):
            shard = Shard(data, offs, sent.value)
            n_docs, n_all, df = n_docs + int((shard.lengths > 0).sum()), n_all + int(shard.lengths.sum()), df + shard.holders()
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], held))), pa.array(np.concatenate(([n_docs, n_all], df[held])))], ["term", "n"])

    counts = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    df = np.zeros(len(terms), np.int64)
    held = counts[counts["term"] >= 0]
    df[held["term"]] = held["n"]
    total = dict(zip(counts["term"], counts["n"]))
    return int(total.get(-2, 0)), int(total.get(-1, 0)), df


def weights_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _search_block(docs: DataFrame, block: list[tuple[int, str]], k: int):
    """(query, doc_id, score, part) of each task's best k, and the broadcast that this needs until it was run."""
    queries = Queries([text for _, text in block])
    n_docs, n_all, df = statistics(docs, queries.terms)
    sent = docs.sparkSession.sparkContext.broadcast((queries, weights_of(n_docs, df), n_docs, n_all))
    names = [n for n, _ in block]

    def run(batches):
        queries, weights, n_docs, n_all = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [none] * len(queries.of)
        heavy = [(t[weights[t] > 0], c[weights[t] > 0]) for t, c in queries.of]
        for ids, data, offs in _texts(batches):
            shard = Shard(data, offs, queries.terms)
            if len(shard.term):
                shard.index(weights, n_docs, n_all)
                for q, (terms, counts) in enumerate(heavy):
                    best[q], _ = shard.search(terms, counts, best[q], ids, k)
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            found = np.concatenate([n for _, n in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, sizes), pa.int64()), pa.array(found, mask=found == NO_ID), pa.array(np.concatenate([s for s, _ in best]))],
                ["query", "doc_id", "score"],
            )

    return docs.mapInArrow(run, "query long, doc_id long, score long").withColumn("part", F.spark_partition_id()), sent


def _ranked(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query", *more).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, limit: int):
    """Queries (their row's number and text) in blocks of at most limit bytes of text, or one."""
    block, n = [], 0
    for r in queries.select("query", "text").toLocalIterator():
        size = 4 * len(r["text"])
        if block and n + size > limit:
            yield block
            block, n = [], 0
        block.append((r["query"], r["text"]))
        n += size
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of items."""
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    groups = max(1, math.isqrt(task_count(texts)))
    texts = materialize(spread(texts, "doc_id"), "texts")
    queries = materialize(items.where(F.col("text").isNotNull()).select("item_id", "text", F.monotonically_increasing_id().alias("query")), "queries")
    out = docs.sparkSession.createDataFrame([], "query long, doc_id long, score long, rank int")
    for block in _blocks(queries, block_bytes):
        found, sent = _search_block(texts, block, k)
        found = _ranked(_ranked(found.withColumn("part", F.col("part") % groups), k, "part"), k)
        out = out.unionByName(materialize(found.select("query", "doc_id", "score", "rank"), "found"))
        sent.destroy()
    discard(texts)
    return out.join(queries.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_threshold_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same for DuckDB, by scoring every document that shares a term.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
b AS (SELECT i, item_id, w, count(*)::BIGINT AS c FROM (SELECT i, item_id, unnest(w) AS w FROM (SELECT row_number() OVER () AS i, item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS w FROM d) WHERE w IN (SELECT w FROM b) GROUP BY ALL),
f AS (SELECT w, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS wt FROM (SELECT w, count(*)::BIGINT AS df FROM p GROUP BY w), t),
s AS (SELECT b.i, b.item_id, d.doc_id, p.r, sum(c * wt * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.w) * n) // l))))::BIGINT AS score
  FROM b JOIN p USING (w) JOIN f USING (w) JOIN d USING (r), t GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
