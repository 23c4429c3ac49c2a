"""Exact removal of strings of LENGTH bytes that start anywhere else too, by merged Burrows-Wheeler transforms.

1. Every window of LENGTH bytes has a minimizer: its GRAM-byte string of least hash, the leftmost of equals. The
   windows in a row with one minimizer form a segment. Equal windows have equal minimizers, so a minimizer that
   occurs once has no repeated window, and only segments of one minimizer need to be compared.
2. Of segments of equal content (by 128 bits of hash, minimizer and length) one copy, with their count, goes to a bucket of
   some BUCKET_BYTES.
3. A minimizer whose contents exceed MOST_BYTES is split, so that no task gets more: its contents are cut into segments
   again, by minimizers of another hash function, twice if need be, and then into single windows. Equal windows stay together
   in each cut.
4. A bucket's segments are dealt into shards. Each shard's Burrows-Wheeler transform is built, and the
   transforms are merged by iterative refinement of their interleave: a round orders all suffixes by q more
   bytes by one stable sort of the interleave by the q-byte strings before them; suffixes are not sorted again.
   A round also tells which neighbours differ in these bytes or did before, so after rounds of LENGTH bytes in all the
   intervals of common prefixes of LENGTH bytes are known, and one that counts two windows or more is repeated. Bytes
   are compared by their order throughout, never by hash. Before that, windows go that can't be repeated: a window
   has the bytes on both sides of its minimizer, and if no other segment has those on one side there is no other such window.
5. The repeated windows of each text are joined to spans, and what is left of the text is hashed.

Texts lie in a table in the shared folder, bucketed by key, so that the later joins don't ship them again.

Defined cases: a null text is empty; rows of a null doc_id are documents like others; a text shorter than LENGTH loses nothing; equal rows are documents of
their own, so all their windows are repeated; spans that touch are one; a removed span may begin or end inside a
character; a very long text takes some 100 bytes of memory a byte while it is cut into segments; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .base import bucketed, discard, materialize, table

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # grams in a window
BUCKET_BYTES, MOST_BYTES, SHARD_BYTES, MOST_SHARDS = 1 << 20, 1 << 20, 1 << 19, 8
#: Bytes by which each round of the refinement goes on; LENGTH in all.
ROUNDS = (8, 32, 32, 32, 32, 32, 32)
#: Bytes by which the sides of a minimizer are lengthened when windows are told that can't be repeated.
STEP = 12
#: Cuts by further minimizers before single windows.
CUTS = 2


def text_table(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), text and no_id, bucketed by the first two: joins on these don't move texts.
    A null doc_id is 0 here, as joins need a value; its row tells it from that of a document 0."""
    df = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.isnull("doc_id").alias("no_id"))
    return bucketed(df, ["doc_id", "row"], "texts")


_OTHER = V.splitmix(99, 256)
_BASE = 0xC2B2AE3D27D4EB4F | 1


def _other_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a second polynomial, one more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_OTHER[data] * V.powers(_BASE, len(data)), out=out[1:])
    return out


def _other_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return V.mix((sums[ends] - sums[starts]) * V.powers(pow(_BASE, -1, 1 << 64), len(sums))[starts])


def cut(data: np.ndarray, offs: np.ndarray, level: int = 0) -> tuple[np.ndarray, ...]:
    """Segments of the rows of data: row, minimizer, two hashes of content and place, first window in its row, and
    number of windows. Each level has its own minimizers; beyond CUTS a segment is one window."""
    none = (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3, *[np.zeros(0, np.int64)] * 2)
    n = len(data) - GRAM + 1
    if n < SPAN:
        return none
    sums = V.prefix_sums(data)
    last = np.repeat(offs[1:], np.diff(offs))[: n - SPAN + 1] - LENGTH
    p = np.flatnonzero(np.arange(len(last)) <= last)
    if not len(p):
        return none
    if level > CUTS:
        first, own = p, np.ones(len(p), np.int64)
        m, least = first, V.span_hashes(sums, first, first + LENGTH)
    else:
        at = np.arange(n)
        h = V.span_hashes(sums, at, at + GRAM)
        key = ((V.mix(h + np.uint64(level)) if level else h) & np.uint64(0xFFFFFFFF << 32)) | at.astype(np.uint64)
        size = 1
        while size < SPAN:
            step = min(size, SPAN - size)
            key = np.minimum(key[:-step], key[step:])
            size += step
        m = (key[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1))))
        first, m = p[edge], m[edge]
        own = p[np.append(edge[1:], len(p)) - 1] - first + 1
        least = h[m]
    place = V.mix(((m - first) * 1000 + own).astype(np.uint64))
    end = first + own - 1 + LENGTH
    s, t = V.mix(V.span_hashes(sums, first, end) ^ place), V.mix(_other_hashes(_other_sums(data), first, end) + place)
    row = np.searchsorted(offs, first, "right") - 1
    return row, least, s, t, first - offs[row], own


def segments(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, row, h, s, t, p, own): minimizer, hashes of content and place, first window and number of windows."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("row")
            for a, _, data, offs in V.chunks(batch.column("text"), 1 << 20):
                row, h, s, t, p, own = cut(data, offs)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), rows.take(take), *(pa.array(x.view(np.int64)) for x in (h, s, t)), pa.array(p.astype(np.int32)), pa.array(own.astype(np.int32))],
                    ["doc_id", "row", "h", "s", "t", "p", "own"],
                )

    return texts.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, h long, s long, t long, p int, own int")


# --- transforms ------------------------------------------------------------------------------------------------


def _ranks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys of so many bits, and each key's rank among the different ones. Where key and place fit in one
    word, sorting these is several times faster than an argsort."""
    n = len(keys)
    own = np.uint64(max(1, n.bit_length()))
    if bits + int(own) <= 64:
        got = np.sort((keys << own) | np.arange(n, dtype=np.uint64))
        order = (got & ((np.uint64(1) << own) - np.uint64(1))).astype(np.int64)
        got >>= own
    else:
        order = np.argsort(keys)
        got = keys[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate(([False], got[1:] != got[:-1]))[:n]).astype(np.uint64)
    return order, rank


def _grams(text: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (8 at most) from each place of a text on, round its end, as one number."""
    pad, key = np.resize(text, len(text) + q), np.zeros(len(text), np.uint64)
    for j in range(q):
        key = (key << np.uint64(8)) | pad[j : j + len(text)]
    return key


def rotations(text: np.ndarray, depth: int = 256) -> np.ndarray:
    """Starts of the rotations of a text, ordered by their first depth bytes (prefix doubling)."""
    n, k = len(text), 5
    bits = max(1, n.bit_length())
    order, rank = _ranks(_grams(text, k), 8 * k)
    while k < depth and n and rank.max() < n - 1:
        order, rank = _ranks((rank << np.uint64(bits)) | np.roll(rank, -(k % n)), 2 * bits)
        k *= 2
    return order


def transform(text: np.ndarray, order: np.ndarray, codes: np.ndarray, q: int) -> np.ndarray:
    """The transform by q bytes: for each rotation in order, the code of the q bytes before it."""
    return codes[(order - q) % len(text)]


def gram_codes(texts: list[np.ndarray], sizes: set[int]) -> dict[int, list[np.ndarray]]:
    """Codes, in their order, of the strings of 8, 16 or 32 bytes at each place of each text, the same for all texts."""
    cuts = np.cumsum([len(t) for t in texts])[:-1]
    bits = max(1, sum(map(len, texts)).bit_length())
    codes = np.split(_ranks(np.concatenate([_grams(t, 8) for t in texts]), 64)[1], cuts)
    out, q = {8: codes}, 8
    while q < max(sizes):
        pairs = [(c << np.uint64(bits)) | np.roll(c, -(q % len(c))) for c in codes]
        codes = np.split(_ranks(np.concatenate(pairs), 2 * bits)[1], cuts)
        q *= 2
        out[q] = codes
    return out


def merge_transforms(transforms: dict[int, list[np.ndarray]], rounds: tuple = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of at most 8 transforms: which one each suffix comes from, in the order of the first bytes, as many
    as the rounds have in all; and the number of the interval of suffixes that share all these bytes. transforms: by each q.

    A round takes the symbols in the present interleave and sorts the interleave by them, stably: suffixes
    that were in order by k bytes are then in order by k + q. Two neighbours share k + q bytes if they have one symbol
    and what follows it was in one interval."""
    sizes = [len(t) for t in next(iter(transforms.values()))]
    z = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    merged, interval = np.empty(len(z), np.uint64), np.zeros(len(z), np.int64)
    place = np.arange(len(z), dtype=np.uint64) << np.uint64(3)
    bits = np.uint64(max(1, len(z).bit_length()))
    shift = bits + np.uint64(3)
    for q in rounds:
        for s, symbols in enumerate(transforms[q]):
            merged[z == np.uint64(s)] = symbols
        key = np.sort((merged << shift) | place | z)
        z = key & np.uint64(7)
        key >>= np.uint64(3)
        was = interval[(key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
        key >>= bits
        interval = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (was[1:] != was[:-1]))))
    return z, interval


def repeated(parts: list[bytes], own: np.ndarray, weight: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each segment, marks of its windows that occur twice or more, a segment counting weight times."""
    sizes = np.array([len(x) for x in parts])
    shards = max(1, min(MOST_SHARDS, len(parts), -(-int(sizes.sum()) // shard_bytes)))
    deal = np.arange(len(parts)) % shards
    texts = [np.frombuffer(b"".join(parts[i] for i in np.flatnonzero(deal == s)), np.uint8) for s in range(shards)]
    orders = [rotations(t) for t in texts]
    transforms = {q: [transform(t, o, c, q) for t, o, c in zip(texts, orders, codes)] for q, codes in gram_codes(texts, set(ROUNDS)).items() if q in ROUNDS}
    z, interval = merge_transforms(transforms)
    # Suffixes in merged order: their segment and their place in it; those that don't begin a window go.
    seg, place = [], []
    for s, o in enumerate(orders):
        mine = np.flatnonzero(deal == s)
        begin = np.cumsum(sizes[mine]) - sizes[mine]
        owner = np.repeat(np.arange(len(mine)), sizes[mine])[o]
        seg.append(mine[owner])
        place.append(o - begin[owner])
    back = np.empty(len(z), np.int64)
    back[np.argsort(z.astype(np.uint8), kind="stable")] = np.arange(len(z))
    seg, place = np.concatenate(seg)[back], np.concatenate(place)[back]
    real = place < own[seg]
    seg, place, interval = seg[real], place[real], interval[real]
    flat = np.zeros(int(own.sum()), bool)
    if len(seg):
        starts = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
        total = np.add.reduceat(weight[seg], starts)
        hit = np.flatnonzero(np.repeat(total > 1, np.diff(np.append(starts, len(seg)))))
        flat[(np.cumsum(own) - own)[seg[hit]] + place[hit]] = True
    return np.split(flat, np.cumsum(own)[:-1])


def candidates(parts: list[bytes], own: np.ndarray, weight: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows [lo, hi) of each segment that may occur twice; least is the hash of its minimizer. Equal windows have
    equal bytes on the left of the minimizer and on its right, SPAN - 1 in all, so a window goes if what it has on one side, in whole
    STEPs, is in no other segment. Unequal hashes tell unequal bytes; equal ones only keep windows."""
    sizes = np.array([len(x) for x in parts])
    begin = np.cumsum(sizes) - sizes
    sums = V.prefix_sums(np.frombuffer(b"".join(parts), np.uint8))
    core = SPAN - own + 1  # grams that all windows of a segment have
    of = np.repeat(np.arange(len(parts)), core)
    at = np.arange(len(of)) - np.repeat(np.cumsum(core) - core, core) + (begin + own - 1)[of]
    hit = np.flatnonzero(V.span_hashes(sums, at, at + GRAM) == least[of])
    known, first = np.unique(of[hit], return_index=True)
    m = np.full(len(parts), -1)
    m[known] = at[hit[first]] - begin[known]
    lo, hi = np.zeros(len(parts), np.int64), own.astype(np.int64)

    def longest(room: np.ndarray, start, end) -> np.ndarray:
        """Bytes beyond the minimizer, below the next STEP, that a window may have on a side."""
        out, live = np.full(len(parts), STEP - 1), known
        for n in range(STEP, SPAN, STEP):
            live = live[room[live] >= n]
            _, inverse = np.unique(V.span_hashes(sums, start(live, n), end(live, n)), return_inverse=True)
            live = live[np.bincount(inverse, weight[live])[inverse] > 1]
            out[live] = n + STEP - 1
        return out

    gram = begin + m
    left = longest(m, lambda i, n: gram[i] - n, lambda i, n: gram[i] + GRAM)
    right = longest(sizes - m - GRAM, lambda i, n: gram[i], lambda i, n: gram[i] + GRAM + n)
    lo[known] = np.maximum(0, m - left)[known]
    hi[known] = np.maximum(np.minimum(own, m + right - SPAN + 2), lo)[known]
    return lo, hi


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


MARKS = "h long, s long, t long, a int, b int"


def compared(contents: DataFrame) -> DataFrame:
    """Rows (h, s, t, a, b): the runs [a, b) of repeated windows of each segment's content."""
    n_bytes = contents.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))

    def run(t):
        t = t.sort_by([("h", "ascending"), ("s", "ascending"), ("t", "ascending")])
        parts, c = t.column("content").to_pylist(), t.column("c").to_numpy()
        lo, hi = candidates(parts, t.column("own").to_numpy(), c, t.column("h").to_numpy().view(np.uint64))
        some = np.flatnonzero(hi > lo)
        t, lo, hi = t.take(pa.array(some)), lo[some], hi[some]
        marks = repeated([parts[i][a : b + LENGTH - 1] for i, a, b in zip(some.tolist(), lo.tolist(), hi.tolist())], hi - lo, c[some]) if len(some) else []
        found = [tuple(x + a for x in runs(m)) for m, a in zip(marks, lo.tolist())]
        n = [len(a) for a, _ in found]
        names = [np.repeat(t.column(c).to_numpy(), n) for c in ("h", "s", "t")]
        ends = [np.concatenate(x).astype(np.int32) for x in zip(*found)] or [np.zeros(0, np.int32)] * 2
        return pa.table([pa.array(x) for x in (*names, *ends)], names=["h", "s", "t", "a", "b"])

    dealt = contents.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, MARKS)


def marked(contents: DataFrame, level: int = 0) -> DataFrame:
    """The same; contents has a row (h, s, t, c, own, content) for each different segment. Minimizers of too many bytes are
    cut into segments of the next level."""
    large = materialize(contents.groupBy("h").agg(F.sum(F.octet_length("content")).alias("n")).where(f"n > {MOST_BYTES}").select("h"), "large")
    if level > CUTS or large.isEmpty():
        return compared(contents)
    near = materialize(contents.join(large, "h", "left_anti"), "contents")
    parts = materialize(recut(contents.join(large, "h", "left_semi"), level + 1), "parts")
    total = parts.groupBy("h2").agg(F.sum("c").alias("n")).where("n > 1").select("h2")
    some = parts.join(materialize(total, "again"), "h2")
    kinds = some.groupBy(F.col("h2").alias("h"), F.col("s2").alias("s"), F.col("t2").alias("t")).agg(F.sum("c").alias("c"), F.first("own").alias("own"), F.first("content").alias("content"))
    inner = materialize(marked(materialize(kinds, "contents"), level + 1), "marks").toDF("h2", "s2", "t2", "a", "b")
    back = parts.drop("content").join(inner, ["h2", "s2", "t2"]).select("h", "s", "t", (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"))
    return compared(near).unionAll(back)


def recut(contents: DataFrame, level: int) -> DataFrame:
    """Segments of a level, with their content, of contents: (h2, s2, t2) of window p on of (h, s, t)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in V.chunks(batch.column("content"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                row, h, s, t, p, own = cut(data, offs, level)
                take, first = pa.array(row), offs[row] + p
                raw = data.tobytes()
                content = [raw[x : x + n + LENGTH - 1] for x, n in zip(first.tolist(), own.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(take) for c in ("h", "s", "t", "c")),
                        *(pa.array(x.view(np.int64)) for x in (h, s, t)), pa.array(p.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(content, pa.binary()),
                    ],
                    ["h", "s", "t", "c", "h2", "s2", "t2", "p", "own", "content"],
                )

    return contents.select("h", "s", "t", "c", "content").mapInArrow(run, "h long, s long, t long, c long, h2 long, s2 long, t2 long, p int, own int, content binary")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, row, a, b): runs [a, b) of starts of repeated windows."""
    own = materialize(segments(texts), "segments")
    # Read again, so that a hot minimizer's segments are split over tasks.
    again = materialize(own.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "often")
    found = materialize(own.join(again, "h"), "again")
    for df in (own, again):
        discard(df)
    kinds = found.groupBy("h", "s", "t").agg(F.min(F.struct("doc_id", "row", "p", "own")).alias("r"), F.count("*").alias("c")).select("h", "s", "t", "c", "r.*")
    content = F.substring(F.col("text").cast("binary"), F.col("p") + 1, F.col("own") + (LENGTH - 1))
    # Equal rows of one document give the same content several times.
    contents = materialize(kinds.join(texts, ["doc_id", "row"]).select("h", "s", "t", "c", "own", content.alias("content")).dropDuplicates(["h", "s", "t"]), "contents")
    marks = materialize(marked(contents), "marks")
    return found.join(marks, ["h", "s", "t"]).select("doc_id", "row", (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"))


def merged_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of runs of window starts [a, b)."""
    out: list[list[int]] = []
    for x, y in sorted(zip(a.tolist(), b.tolist())):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y + LENGTH - 1)
        else:
            out.append([x, y + LENGTH - 1])
    return [(x, y) for x, y in out]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row; on request the kept bytes."""
    texts = text_table(docs)
    spans = repeated_windows(texts).groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("w"))  # equal rows have the same
    rows = texts.join(spans, ["doc_id", "row"], "left").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", F.col("w.a").alias("a"), F.col("w.b").alias("b"))

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b")):
                data = text.as_buffer() or b""
                data = bytes(memoryview(data))
                cuts = merged_spans(a.values.to_numpy(), b.values.to_numpy()) if a.is_valid else []
                kept, at = [], 0
                for x, y in cuts:
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                for o, v in zip(out, (len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept)):
                    o.append(v)
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
            k = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols[:k]], ["doc_id", *names[:k]])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else ""))


def op9_bwt_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


#: The same by plain windows, over hexadecimal digits so that strings may begin inside a character.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
k AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
b AS (SELECT r, i FROM w SEMI JOIN k USING (s)),
g AS (SELECT r, i, sum(CASE WHEN i > p + 200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM b)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, g),
e AS (SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS nx FROM s),
t AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, min(a) AS f, string_agg(substr(h, 2 * z + 1, 2 * (coalesce(nx, n) - z)), '' ORDER BY a) AS rest FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN f IS NULL THEN h ELSE left(h, 2 * f) || rest END)) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
