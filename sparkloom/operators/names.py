"""Names in texts: in how many texts each of many names stands, with work that grows with names and texts, never with their pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut_lineage

#: Bytes of a name's beginning by which places of a text are told, and kinds of beginnings that are told apart.
BEGIN, KINDS = 4, 1 << 16
#: Names of more bytes meet texts by a join on GRAM characters.
LONG, GRAM = 255, 4
#: Bytes of texts that a task compares at once; a longer text is compared alone.
SLICE = 1 << 20


def _kind(code: np.ndarray) -> np.ndarray:
    """Which of KINDS beginnings, given as numbers."""
    return (code.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _slices(column: pa.Array):
    """Runs of a binary column's rows: first row, end row, bytes, and where in these each row begins and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, side="right")) - 1)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def _codes(data: np.ndarray) -> np.ndarray:
    """The BEGIN bytes from each place on as a number; zeros follow the last."""
    wide = np.concatenate((data, np.zeros(BEGIN - 1, np.uint8))).astype(np.uint32)
    return sum(wide[i : len(wide) - BEGIN + 1 + i] << np.uint32(8 * i) for i in range(BEGIN))


def _lengths_of_kinds(names: DataFrame) -> np.ndarray:
    """By kind of beginning a bit for each length that a name of at most LONG bytes has: 2 MB, however many names there are."""

    def run(batches):
        for batch in batches:
            bits = np.zeros((KINDS, 4), np.uint64)
            for _, _, data, at in _slices(batch.column("name")):
                size = np.diff(at)
                begin = _codes(data)[np.minimum(at[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint32)
                kind = _kind(begin & _mask(np.minimum(size, BEGIN)))
                np.bitwise_or.at(bits, (kind, size >> 6), np.uint64(1) << (size & 63).astype(np.uint64))
            got = np.flatnonzero(bits.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), *[pa.array(bits[got, i].view(np.int64)) for i in range(4)]], ["kind", "b0", "b1", "b2", "b3"])

    rows = names.select("name").mapInArrow(run, "kind int, b0 long, b1 long, b2 long, b3 long").groupBy("kind").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)]).collect()
    out = np.zeros((KINDS, 4), np.uint64)
    for r in rows:
        out[r["kind"]] = np.array(r[1:], np.int64).view(np.uint64)
    return out


def _mask(size: np.ndarray) -> np.ndarray:
    """The lowest `size` bytes of a number of four."""
    return ((np.uint64(1) << (8 * size).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def _parts(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of every part of the rows that begins and measures like a name."""
    codes = _codes(data)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))  # bytes to the row's end
    present = np.bitwise_or.reduce(lengths, axis=0)
    sizes = [n for n in range(1, LONG + 1) if present[n >> 6] >> np.uint64(n & 63) & np.uint64(1)]
    places, found = [], []
    for begin in range(1, BEGIN + 1):
        own = [n for n in sizes if n == begin or n > begin == BEGIN]
        if not own:
            continue
        wanted = np.zeros(4, np.uint64)
        for n in own:
            wanted[n >> 6] |= np.uint64(1) << np.uint64(n & 63)
        kind = _kind(codes & _mask(np.array([begin]))[0])
        at_ = np.flatnonzero((lengths & wanted).any(axis=1)[kind])
        bits, rest = lengths[kind[at_]], left[at_]
        for n in own:
            got = at_[((bits[:, n >> 6] >> np.uint64(n & 63) & np.uint64(1)) != 0) & (rest >= n)]
            places.append(got)
            found.append(np.full(len(got), n))
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def name_counts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, n): in how many rows of texts (content) each of names (name) stands, for those that stand in any.

    A task cuts from its texts the parts that begin like a name and have its length, each once a text, and counts them; sums of these
    counts meet the names by equality. What goes to all tasks is a table of 2 MB. Equal texts are one with a count."""
    names = cut_lineage(names.where("name <> ''").select("name").distinct())
    texts = texts.where("content is not null").groupBy("content").agg(F.count("*").alias("n"))
    short = names.where(F.octet_length("name") <= LONG)
    lengths = names.sparkSession.sparkContext.broadcast(_lengths_of_kinds(short))

    def run(batches):
        for batch in batches:
            weight = batch.column("n").to_numpy()
            for a, b, data, at in _slices(batch.column("content")):
                place, size = _parts(data, at, lengths.value)
                if not len(place):
                    continue
                ends = np.cumsum(size)
                bytes_ = data[np.repeat(place - (ends - size), size) + np.arange(ends[-1])]
                offsets = np.concatenate(([0], ends)).astype(np.int64)
                parts = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)]).dictionary_encode()
                different = len(parts.dictionary)
                once = np.unique((np.searchsorted(at, place, side="right") - 1) * different + parts.indices.to_numpy())
                n = np.zeros(different, np.int64)
                np.add.at(n, once % different, weight[a:b][once // different])
                yield pa.RecordBatch.from_arrays([parts.dictionary.cast(pa.binary()), pa.array(n)], ["part", "n"])

    counts = texts.mapInArrow(run, "part binary, n long").groupBy("part").agg(F.sum("n").alias("n"))
    met = short.withColumn("part", F.col("name").cast("binary")).join(counts, "part").select("name", "n")
    longest = names.agg(F.max(F.octet_length("name"))).first()[0] or 0
    return met if longest <= LONG else met.unionByName(_long_counts(names.where(F.octet_length("name") > LONG), texts))


def _grams(text: Column) -> Column:
    """The distinct runs of GRAM characters, at every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _long_counts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """name_counts for names of over LONG bytes, which have GRAM characters in any case. A name waits under the one of its grams that
    fewest texts have; texts come to names by an equi-join on their grams, and what meets is confirmed by the text."""
    texts = cut_lineage(texts.withColumn("key", F.xxhash64("content")))
    own = cut_lineage(names.select("name", F.explode(_grams(F.col("name"))).alias("gram")))
    found = texts.select("key", F.explode(_grams(F.col("content"))).alias("gram"))
    held = found.join(cut_lineage(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    # A gram that no text has leaves its name out: min_by over a left join would take df null first.
    rarest = own.join(held, "gram", "left").groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("df", F.lit(0))).alias("df")).where("df > 0")
    met = found.join(cut_lineage(rarest.select("name", "gram")), "gram").select("key", "name").distinct()
    return met.join(texts, "key").where(F.contains("content", "name")).groupBy("name").agg(F.sum("n").alias("n"))
