"""Cross-tokenizer alignment by byte-owner arrays.

A byte's owner is the token that covers it. np.repeat of token indices over token lengths gives the owners under
A and under B; consecutive distinct owner pairs are the overlaps of tokens, and where both owners change at once the bytes are
cut into groups. Tokens of one group are linked, each of A with each of B.

A text (with a blank before it) is taken apart before each blank that follows a character which is no white space. No pre-token
of A and no piece of B reaches over such a place (for B this is looked up in the vocabulary; if a piece does, texts
stay whole), so the parts, called units, are encoded alone, both tokenizers end a token at each end, and equal units
of a batch are encoded and aligned once.

Counts over the corpus: a batch (some megabytes of whole texts) becomes one row with its distinct id pairs, the number of
its documents that hold each, and its documents as units. The pairs are summed over all batches by a shuffle of (pair, number),
each A id's highest count is found, and both travel back to the batches that hold the pair, where documents sum them up. Texts are
encoded once, and no pair travels once a document.

Defined cases: a null or empty text, or one whose joined A or B bytes differ from blank and text (a literal U+2581, for one),
has no tokens: zeros, an empty string, and a part in no count; rows are documents each, repeated ones and those of a null
doc_id included; ties for an A id's highest count are all the highest; a very long text is a batch of its own, at some 40
bytes a token besides its own; a table without rows gives none. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .base import materialize, spread, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 8 << 20
#: Units that are encoded at once, as the tokenizers' own results take far more memory than ids.
UNITS_AT_ONCE = 8192
#: Links that are written out at once before equal ones are counted.
LINKS_AT_ONCE = 4 << 20
SPACE_PIECE = "▁"
UNIT = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """A and B: ids of many strings at once, and the bytes of every id."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        with open(byte_bpe, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        value = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in vocabulary.items():
            if all(c in value for c in token):
                self.a_bytes[i] = bytes(value[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(names)]
        self.blank = self.b.piece_to_id(SPACE_PIECE)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.splits = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in names)

    def units(self, text: str) -> list[str]:
        return UNIT.split(" " + text) if self.splits else [" " + text]

    def encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        return _flat(units, lambda some: [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)])

    def encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        def encode(some):
            ids = self.b.encode([u[1:] for u in some], num_threads=1)
            return [x if u != " " else [self.blank] for x, u in zip(ids, some)]

        return _flat(units, encode)


def _flat(units: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
    found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(units), UNITS_AT_ONCE):
        ids = encode(units[low : low + UNITS_AT_ONCE])
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        found.append(np.fromiter((x for i in ids for x in i), np.int64, int(sizes[-1].sum())))
    return np.concatenate(found), np.concatenate(sizes)


@functools.lru_cache(maxsize=1)
def tokenizers(byte_bpe: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_bpe, pieces)


def _spread_ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _upto(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Owners:
    """Byte-owner arrays of strings one after the other, each of which both tokenizers spell out in full."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        a, b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
        new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
        pair = np.flatnonzero(np.concatenate((np.ones(min(len(a), 1), bool), new_a | new_b)))
        #: Tokens that share a byte, and after which bytes both tokens end (the last byte included).
        self.overlap_a, self.overlap_b = a[pair], b[pair]
        cut = np.concatenate((new_a & new_b, np.ones(min(len(a), 1), bool)))
        self.cuts = np.flatnonzero(cut) + 1
        group = np.cumsum(cut) - cut
        self.group_a, self.group_b = (group[_upto(s)[:-1]] for s in (a_sizes, b_sizes))
        self.n_groups = len(self.cuts)


class Units:
    """Distinct units of a batch: tokens of both kinds, groups and links of each."""

    def __init__(self, units: list[str], tk: Tokenizers):
        self.a, self.n_a = tk.encode_a(units)
        self.b, self.n_b = tk.encode_b(units)
        self.whole = self._spelled(units, tk)
        if not self.whole.all():  # tokens of units that are not spelled out go
            for kind in "ab":
                ids, sizes = getattr(self, kind), getattr(self, f"n_{kind}")
                setattr(self, kind, ids[np.repeat(self.whole, sizes)])
                setattr(self, f"n_{kind}", np.where(self.whole, sizes, 0))
        self.owners = Owners(tk.a_size[self.a], tk.b_size[self.b])
        self.unit_of_a = np.repeat(np.arange(len(units)), self.n_a)
        g = self.owners.group_a
        firsts = np.flatnonzero(np.concatenate((np.ones(min(len(g), 1), bool), g[1:] != g[:-1])))
        self.n_groups = np.bincount(self.unit_of_a[firsts], minlength=len(units))
        self.in_a = np.bincount(g, minlength=self.owners.n_groups)
        self.in_b = np.bincount(self.owners.group_b, minlength=self.owners.n_groups)
        self.n_links = np.zeros(len(units), np.int64)
        np.add.at(self.n_links, self.unit_of_a[firsts], self.in_a * self.in_b)

    def _spelled(self, units: list[str], tk: Tokenizers) -> np.ndarray:
        """Which units both kinds of tokens spell out."""
        raw = [u.encode() for u in units]
        whole = np.ones(len(units), bool)
        for ids, sizes, spelt in ((self.a, self.n_a, tk.a_bytes), (self.b, self.n_b, tk.b_bytes)):
            parts = [spelt[i] for i in ids.tolist()]
            if b"".join(parts) != b"".join(raw) or (np.add.reduceat(np.append([len(p) for p in parts], 0), _upto(sizes)[:-1]) != [len(r) for r in raw]).any():
                ends = _upto(sizes).tolist()
                whole &= np.array([b"".join(parts[x:y]) == r for x, y, r in zip(ends, ends[1:], raw)], bool)
        return whole

    def links(self, n_b_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per unit its linked id pairs (A id * n_b_ids + B id), sorted, and how many links each has; where each unit's begin."""
        g = self.owners.group_a
        reps, begins = self.in_b[g], _upto(self.in_b)[:-1][g]
        ends = _upto(reps)
        parts, low = [], 0
        while low < len(g):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + LINKS_AT_ONCE, "right")) - 1)
            code = np.repeat(self.a[low:high] * n_b_ids, reps[low:high]) + self.b[_spread_ranges(begins[low:high], reps[low:high])]
            unit = np.repeat(self.unit_of_a[low:high], reps[low:high])
            order = np.lexsort((code, unit))
            parts.append(_counted(unit[order], code[order], np.ones(len(code), np.int64)))
            low = high
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(self.n_a) + 1, np.int64)
        unit, code, n = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:
            order = np.lexsort((code, unit))
            unit, code, n = _counted(unit[order], code[order], n[order])
        return code, n, np.searchsorted(unit, np.arange(len(self.n_a) + 1))

    def group_strings(self) -> list[str]:
        """a1,a2|b1;a3|b2 of each unit."""
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        at_a, at_b = _upto(self.in_a).tolist(), _upto(self.in_b).tolist()
        groups = [",".join(a[at_a[i] : at_a[i + 1]]) + "|" + ",".join(b[at_b[i] : at_b[i + 1]]) for i in range(self.owners.n_groups)]
        at = _upto(self.n_groups).tolist()
        return [";".join(groups[x:y]) for x, y in zip(at, at[1:])]


def _counted(unit: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours as one, their numbers added."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), (unit[1:] != unit[:-1]) | (code[1:] != code[:-1]))))
    return unit[first], code[first], np.add.reduceat(n, first) if len(first) else n


def units_of(texts: list[str | None], tk: Tokenizers) -> tuple[Units, np.ndarray, np.ndarray]:
    """The distinct units of texts, each text's units in order, and where each text's begin. Texts that are not spelled
    out have none."""
    place: dict[str, int] = {}
    rows = [np.array([place.setdefault(u, len(place)) for u in tk.units(t)], np.int64) if t else np.zeros(0, np.int64) for t in texts]
    units = Units(list(place), tk)
    rows = [r if units.whole[r].all() else r[:0] for r in rows]
    return units, np.concatenate([np.zeros(0, np.int64), *rows]), _upto(np.array([len(r) for r in rows], np.int64))


def _sums(values: np.ndarray, rows: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sum over each text's units."""
    run = _upto(values[rows])
    return run[upto[1:]] - run[upto[:-1]]


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Per document the ids of A and B, the byte offsets (in blank and text) where both end, and its overlaps: the places
    in these lists of an A and a B token that share bytes."""

    def run(batches):
        tk = tokenizers(byte_bpe, pieces)
        for batch in batches:
            for a, b, _, _ in V.chunks(batch.column("text"), BATCH_BYTES):
                part = batch.slice(a, b - a)
                units, rows, upto = units_of(part.column("text").to_pylist(), tk)
                ids, cuts, overlaps = ([], []), [], ([], [])
                at = [_upto(units.n_a), _upto(units.n_b)]
                for x, y in zip(upto[:-1], upto[1:]):
                    r = rows[x:y]
                    own = [kind[_spread_ranges(up[r], size[r])] for kind, up, size in ((units.a, at[0], units.n_a), (units.b, at[1], units.n_b))]
                    owners = Owners(tk.a_size[own[0]], tk.b_size[own[1]])
                    for out, found in zip((*ids, cuts, *overlaps), (*own, owners.cuts, owners.overlap_a, owners.overlap_b)):
                        out.append(found.tolist())
                arrays = [pa.array(x, pa.list_(pa.int64())) for x in (*ids, cuts, *overlaps)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "a_ids", "b_ids", "cuts", "overlap_a", "overlap_b"])

    schema = T.StructType([docs.schema["doc_id"]])
    for name in ("a_ids", "b_ids", "cuts", "overlap_a", "overlap_b"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, schema)


DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
#: A batch as a row: its number; distinct pairs and their numbers of documents; documents; and, as 32-bit numbers, units'
#: pairs (places among these) and links of each, and documents' units.
BATCH = (
    "batch long, pairs array<long>, held array<long>, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>,"
    " unit_upto binary, unit_pairs binary, unit_links binary, doc_upto binary, doc_units binary"
)


def _batch_row(number: int, ids: pa.Array, texts: list[str | None], tk: Tokenizers) -> list:
    units, rows, upto = units_of(texts, tk)
    code, links, unit_upto = units.links(len(tk.b_bytes))
    pairs, at = np.unique(code, return_inverse=True)
    # Distinct units of each document, then its distinct pairs.
    doc = np.repeat(np.arange(len(texts)), np.diff(upto))
    held_units = np.unique(doc * max(len(units.n_a), 1) + rows)
    doc, unit = held_units // max(len(units.n_a), 1), held_units % max(len(units.n_a), 1)
    sizes = np.diff(unit_upto)[unit]
    held = np.unique(np.repeat(doc, sizes) * max(len(pairs), 1) + at[_spread_ranges(unit_upto[unit], sizes)])
    held = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
    strings = units.group_strings()
    cuts, flat = upto.tolist(), rows.tolist()
    shas = [hashlib.sha256(";".join([strings[u] for u in flat[x:y]]).encode()).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]
    sums = [_sums(v, rows, upto) for v in (units.n_a, units.n_b, units.n_groups, units.n_links)]
    docs = pa.StructArray.from_arrays([ids.cast(pa.int64()), *map(pa.array, sums), pa.array(shas, pa.string())], DOC)
    blobs = [x.astype(np.int32).tobytes() for x in (unit_upto, at, links, upto, rows)]
    return [number, pairs, held, docs, *blobs]


def batches_of(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    names = ["batch", "pairs", "held", "docs", "unit_upto", "unit_pairs", "unit_links", "doc_upto", "doc_units"]

    def run(batches):
        tk = tokenizers(byte_bpe, pieces)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, _, _ in V.chunks(batch.column("text"), BATCH_BYTES):
                part = batch.slice(a, b - a)
                number, *lists = _batch_row(number, part.column("doc_id"), part.column("text").to_pylist(), tk)
                arrays = [pa.array([number]), *[pa.array([x], pa.list_(pa.int64())) for x in lists[:2]]]
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(lists[2])], pa.int32()), lists[2]))
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array([x], pa.binary()) for x in lists[3:]]], names)
                number += 1

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, BATCH)


def _finished(batches):
    """Documents of batches that have the counts of their pairs: twice the count, and one more for a highest one."""
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            unit_upto, at, links, upto, rows = (np.frombuffer(row[c].as_py(), np.int32).astype(np.int64) for c in ("unit_upto", "unit_pairs", "unit_links", "doc_upto", "doc_units"))
            found = np.asarray(row["counts"].values).astype(np.int64) if row["counts"].is_valid else np.zeros(0, np.int64)
            best, total = (_upto(links * x)[unit_upto] for x in ((found & 1)[at], (found >> 1)[at]))
            docs = row["docs"].values
            sums = [pa.array(_sums(np.diff(x), rows, upto)) for x in (best, total)]
            own = {c: docs.field(c) for c in DOC}
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], *sums, own["groups_sha256"]], [*DOC[:-1], "n_best", "count_sum", DOC[-1]])


def pair_counts(batches: DataFrame, n_b_ids: int) -> DataFrame:
    """(pair, packed): in how many documents of the corpus an id pair is linked, doubled, and one more where no pair of the
    same A id has a higher count."""
    counts = batches.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held").groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.expr(f"pair div {n_b_ids}")))  # an A id has at most n_b_ids pairs
    return counts.select("pair", (F.col("n") * 2 + (F.col("n") == best).cast("long")).alias("packed"))


def linked(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """Per document its numbers of tokens, groups and links, a digest of its groups, how many links are the most frequent of
    their A id, and the sum of all links' counts over the corpus."""
    batches = materialize(batches_of(docs, byte_bpe, pieces), "aligned")
    counts = pair_counts(batches, len(tokenizers(byte_bpe, pieces).b_bytes))
    asked = batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "packed"))).alias("told"))
    told = told.select("batch", F.col("told.packed").alias("counts"))
    whole = batches.drop("pairs", "held").join(told, "batch", "left")
    return whole.mapInArrow(_finished, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_align(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
