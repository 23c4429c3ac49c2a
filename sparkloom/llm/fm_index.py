"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of whole documents (some megabytes). Its text is turned into word ids. Words that no test
item has can't be inside an occurrence, so they end a run, and runs shorter than the shortest phrase are
left out: an exact prefilter, after which most shards have little to index. The rest is indexed whole: suffix
array, Burrows-Wheeler transform, wavelet tree for ranks, and sampled suffix positions. All test phrases search
backward at once; occurrences are located by walking to a sampled suffix, compared with the phrase byte by byte,
and their spans merged.

Phrases are the windows of the test items. Items are read in blocks of at most block_words words (or one item),
and each block is broadcast on its own, so that bounds what is sent at once. A task searches the shards of a batch
for one block after the other, so documents are read and moved once, however many items there are, and a worker holds
the phrases of one block at a time.

Defined cases: a null or empty text or item has no words; an item of fewer words than a window is one window;
items of equal text each count; an item id on several rows counts once; the windows of a null item id are hit and
cut like others but named in no list; rows of a null doc_id are searched like others; repeated documents give
repeated rows; a very long text is a shard of its own, at some 100 bytes of memory for each of its words that items
have; an empty benchmark leaves all documents clean; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .base import spread, table

WINDOW = 10
BLOCK_WORDS = 500_000
SAMPLE_EVERY = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of non-negative ids, by prefix doubling; a shorter suffix comes first."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < n and rank.max() < n:
        key = rank * (n + 1)
        key[: n - k] += rank[k:]
        order = np.argsort(key, kind="stable")
        got = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], (got[1:] != got[:-1]).astype(np.int64))))
        k *= 2
    return order


class WaveletTree:
    """Ranks of symbols below 2**bits: one level a bit, each with running counts of ones."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        s = s.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int(len(s) - self.ones[-1][-1]))
            s = s[np.argsort(bit, kind="stable")]  # a wavelet matrix: zeros of a level before its ones

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first upto."""
        low, high = np.zeros_like(upto), upto.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[level], ((symbol >> b) & 1).astype(bool)
            low = np.where(bit, self.zeros[level] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[level] + ones[high], high - ones[high])
        return high - low

    def at(self, where: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros_like(where)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[where + 1] - ones[where]
            out = out * 2 + bit
            where = np.where(bit == 1, self.zeros[level] + ones[where], where - ones[where])
        return out


class FMIndex:
    """Index of a sequence of ids below n_symbols: 1 separates runs, words are above, 0 ends it all."""

    def __init__(self, s: np.ndarray, n_symbols: int, every: int = SAMPLE_EVERY):
        s = np.append(s, 0)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.tree = WaveletTree(bwt, max(1, int(n_symbols - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n_symbols))))
        sampled = (sa % every == 0) | (sa == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = sa[sampled]
        self.size = len(s)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once (rows are padded at the right): suffix ranges."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (low < high))
            c = phrases[live, lengths[live] - 1 - step]
            low[live], high[live] = (self.first[c] + self.tree.rank(c, x[live]) for x in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the left until a sampled one."""
        rows, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            hit = self.sampled[r + 1] > self.sampled[r]
            out[live[hit]] = self.samples[self.sampled[r[hit]]] + walked[live[hit]]
            live, r = live[~hit], r[~hit]
            c = self.tree.at(r)
            rows[live] = self.first[c] + self.tree.rank(c, r)
            walked[live] += 1
        return out


class Phrases:
    """The windows of one block of test items, with the vocabulary of their words."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        data, offs = V.buffer_of(pa.array([t for _, t in items], pa.large_string()))
        h, starts, ends, upto = V.word_hashes(data, offs, V.ALNUM)
        low = V.LOWER[data]
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h) + 2
        seen: dict[tuple, set[int]] = {}
        for (item, _), a, b in zip(items, upto[:-1].tolist(), upto[1:].tolist()):
            size = min(window, b - a)
            for i in range(a, b - size + 1) if size else ():
                key = (tuple(ids[i : i + size].tolist()), b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + size)))
                names = seen.setdefault(key, set())
                if item is not None:
                    names.add(item)
        self.words = [w for _, w in seen]
        self.items = [sorted(x) for x in seen.values()]
        self.lengths = np.array([len(p) for p, _ in seen], np.int64)
        self.padded = np.zeros((len(seen), int(self.lengths.max(initial=0))), np.int64)
        for i, (p, _) in enumerate(seen):
            self.padded[i, : len(p)] = p
        self.shortest = int(self.lengths.min(initial=window))


_KEPT: dict[tuple, Phrases] = {}


def phrases_of(block, window: int) -> Phrases:
    """The phrases of a broadcast block; a worker keeps those of the last one for further shards."""
    key = (block[0], window)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Phrases(list(block[1].value), window)
    return _KEPT[key]


def scan_shard(data: np.ndarray, offs: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words in each document, and for those hit: merged spans of word positions, and items."""
    h, starts, ends, upto = V.word_hashes(data, offs, V.ALNUM)
    counts = np.diff(upto)
    found: dict[int, tuple[list, set]] = {}
    if not len(phrases.lengths) or not len(h):
        return counts, found
    at = np.searchsorted(phrases.vocabulary, h)
    at[at == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[at] == h
    # Runs of known words within a document.
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    inner = upto[1:-1][upto[1:-1] < len(h)]
    begin[inner] = known[inner]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    before = inner[inner > 0] - 1
    stop[before] = known[before]
    runs = np.column_stack((np.flatnonzero(begin), np.flatnonzero(stop) + 1))
    runs = runs[runs[:, 1] - runs[:, 0] >= phrases.shortest]
    if not len(runs):
        return counts, found
    sizes = runs[:, 1] - runs[:, 0] + 1
    seq_start = np.cumsum(sizes) - sizes
    source = np.repeat(runs[:, 0] - seq_start, sizes) + np.arange(sizes.sum())  # word of each index position
    s = at[np.minimum(source, len(at) - 1)] + 2
    s[seq_start + sizes - 1] = 1
    index = FMIndex(s, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.padded, phrases.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    begins = source[index.locate(rows)]
    docs = np.searchsorted(upto, begins, "right") - 1
    folded = V.LOWER[data]
    for p, b, d in zip(which.tolist(), begins.tolist(), docs.tolist()):
        e = b + int(phrases.lengths[p])
        if b" ".join(folded[starts[j] : ends[j]].tobytes() for j in range(b, e)) == phrases.words[p]:
            spans, items = found.setdefault(d, ([], set()))
            spans.append((b - int(upto[d]), e - int(upto[d])))
            items.update(phrases.items[p])
    return counts, {d: (merge(spans), items) for d, (spans, items) in found.items()}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    starts, ends, _ = V.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), V.ALNUM)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def item_blocks(benchmark: DataFrame, block_words: int):
    """Lists of items of at most block_words words (or one item)."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id"), F.col("text")).toLocalIterator():
        size = len(r["text"] or "") // 2 + 1
        if block and n + size > block_words:
            yield tuple(block)
            block, n = [], 0
        block.append((r["item_id"], r["text"]))
        n += size
    yield tuple(block)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, own: list[str], more: dict, made) -> DataFrame:
    """own columns of docs and further ones (more: their types), which made() gives for the rows of a shard from their
    batch, counts of words, merged spans and items."""
    schema = T.StructType([docs.schema[c] for c in own])
    for name, kind in more.items():
        schema = schema.add(name, kind)
    context = docs.sparkSession.sparkContext
    blocks = [(uuid.uuid4().hex, context.broadcast(items)) for items in item_blocks(benchmark, block_words)]

    def run(batches):
        for batch in batches:
            shards = list(V.chunks(batch.column("text"), 4 << 20))
            counts, spans, items = [None] * len(shards), [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for block in blocks:  # outside, so that a block's phrases are made once for a batch of shards
                phrases = phrases_of(block, window)
                for n, (a, _, data, offs) in enumerate(shards):
                    counts[n], found = scan_shard(data, offs, phrases)
                    for i, (s, names) in found.items():
                        spans[a + i] = merge(spans[a + i] + s)
                        items[a + i] |= names
            for n, (a, b, _, _) in enumerate(shards):
                part = batch.slice(a, b - a)
                given = made(part, counts[n], spans[a:b], items[a:b])
                yield pa.RecordBatch.from_arrays([given.get(c) if c in given else part.column(c) for c in schema.names], schema.names)

    return spread(docs.select(*dict.fromkeys([*own, "text"])), "doc_id").mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: list[str] = ()) -> DataFrame:
    """For each document its count of words, the spans of hit words and the items with windows in it. carry
    names columns to keep."""

    def made(part, counts, spans, items):
        return {
            "n_words": pa.array(counts, pa.int64()),
            "starts": pa.array([[x for x, _ in s] for s in spans], pa.list_(pa.int64())),
            "ends": pa.array([[y for _, y in s] for s in spans], pa.list_(pa.int64())),
            "items": pa.array([sorted(map(str, i)) for i in items], pa.list_(pa.string())),
        }

    kinds = {"n_words": T.LongType(), "starts": T.ArrayType(T.LongType()), "ends": T.ArrayType(T.LongType()), "items": T.ArrayType(T.StringType())}
    return _searched(docs, benchmark, window, block_words, list(dict.fromkeys(["doc_id", *carry])), kinds, made)


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, texts without the spans of test items, and whether a row's text was_cut."""

    def made(part, counts, spans, items):
        was = [bool(s) for s in spans]
        texts = part.column("text")
        if any(was):
            texts = pa.array([cut_words(t, s) if s else t for t, s in zip(texts.to_pylist(), spans)], texts.type)
        return {"text": texts, "was_cut": pa.array(was)}

    return _searched(docs, benchmark, window, block_words, docs.columns, {"was_cut": T.BooleanType()}, made)


def op6_fm_index(spark, sf_dir: str) -> DataFrame:
    hits = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS ph
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS ph FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s WHERE len(w) >= k)),
m AS (SELECT r, i, g.k AS k, item_id FROM g JOIN p ON g.ph = p.ph AND g.k = p.k),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
