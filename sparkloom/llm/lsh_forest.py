"""Near-duplicate documents by a MinHash LSH forest, links confirmed on full shingle sets.

1. Each document gets its set's size, digest and MinHash signature. Documents of equal sets are one class,
   and only its smallest id goes on.
2. The forest has TREES sorted orders of signatures; the label in a tree is DEPTH signature values. Rows are
   sorted by label and neighbours by longest common prefix, at least BASE values, become candidates: each
   row with the WINDOW rows before it in its region and with the region's first row.
3. Candidates of low estimated similarity are left out (the bound is 4.5 standard errors below the threshold);
   the others join documents to families.
4. A region that was wider than the window and holds several families is split until no part has more than REGION
   rows: it goes one value deeper as often as the label allows (adaptive depth), then into FURTHER trees of its own,
   STEP values deeper each time, until all K values agree; a row is in each of these once. A part compares all its pairs across families by signature
   and tells which families to join; rows that agree in all values are joined to their first one.
5. Families are confirmed on full sets, a block of rows at a time: intersections of all its pairs are one matrix
   product over the shingles that several rows share. Each block also holds the family's HUBS first rows, which
   tie blocks of true copies together. A family that is still in parts is split by the further trees in the same way, to
   ROWS rows, and what holds several parts is confirmed, so a row is in some tens of blocks however large its family is.

Tasks return trees of links, never pairs of a group, and no group is dropped, capped or sampled. A pair of
similarity 0.75 has a common prefix of 3 in at least one of 32 trees but for a chance of 2.4e-8. Where a region is split
by the further trees, it keeps a common part of STEP values but for 1.9e-5; parts that are still too large go deeper in the same
trees, so there it must agree in 6, 9 or more values in one of 20 trees, and a pair near 0.75 may be lost (0.02 at 6 values). What that
costs is measured in tests/llm/test_forest_regions.py: links between rows that no third row ties together are what is at risk.

Defined cases: a null or empty text has no shingles, is linked with nothing and kept; fewer words than a
shingle form one shingle; repeated rows of a doc_id are one document (of different texts, the one of the
smaller digest gives its class), and each row is returned; rows of a null doc_id are all kept, with a null
component_id; a very long text is hashed in one piece by its task, at some 40 bytes a word, and only its signature and, for
confirmation, its set travel; ties of a component go to the smallest doc_id; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .base import bucketed, discard, materialize, table
from .components import connected_components

K, TREES, DEPTH, BASE = 96, 32, 6, 3
SHINGLE, PERCENT = 5, 75
WINDOW, REGION = 4, 4096
#: Trees of a region that is still too large at full depth, and values by which these go deeper.
FURTHER, STEP = 20, 3
#: Rows and shingles of a block of a family, and rows of a family that all its blocks hold.
ROWS, SHINGLES, HUBS = 1024, 600_000, 8
#: Estimates below go no further: 0.75 less 4.5 standard errors of an estimate from K values.
LEAST_ESTIMATE = 0.55
_A = V.splitmix(5, K) | np.uint64(1)
_B = V.splitmix(6, K)
_FURTHER = np.array([np.random.default_rng(1000 + t).permutation(K) for t in range(FURTHER)])
_ORDERS = np.array([np.random.default_rng(t).permutation(K)[:DEPTH] for t in range(TREES)])


def _fold(x: np.ndarray) -> np.ndarray:
    """16 bits of a least hash. Different hashes agree by chance once in 65,536, which an estimate of K values
    does not feel."""
    return (V.mix(x.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest (of the set), sig (K values of 2 bytes)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offs in V.chunks(batch.column("text")):
                sets = V.shingle_sets(data, offs, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig = np.zeros((b - a, K), np.uint16)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    cuts = np.cumsum(n[full]) - n[full]
                    with np.errstate(over="ignore"):
                        for k in range(K):
                            sig[full, k] = _fold(np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(n),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    ["doc_id", "n", "digest", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    data, _ = V.buffer_of(column)
    return data.view(dtype).reshape(-1, width)


def labels(classes: DataFrame) -> DataFrame:
    """A row (key, rest, id) for each class and tree: the hash of tree and first BASE values, and the next three
    values in order, by which rows are sorted within a key."""

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"), K, np.uint16).astype(np.uint64)
            ids = batch.column("id").to_numpy()
            for t in range(TREES):
                own = sig[:, _ORDERS[t]]
                key = V.mix((own[:, 0] << np.uint64(32)) | (own[:, 1] << np.uint64(16)) | own[:, 2] | np.uint64((t + 1) << 48))
                rest = (own[:, 3] << np.uint64(32)) | (own[:, 4] << np.uint64(16)) | own[:, 5]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(ids)], ["key", "rest", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, rest long, id long")


def neighbours(forest: DataFrame) -> DataFrame:
    """One pass over the sorted forest, with the last WINDOW rows in mind. Rows (a, b): a row's pairs with the
    WINDOW rows before it in its region and with the region's first row. Rows (a, key, rest), b null: the members
    of regions wider than the window."""
    ordered = forest.repartition("key").sortWithinPartitions("key", "rest", "id")

    def run(batches):
        empty = np.zeros(0, np.int64)
        key, rest, ids = empty, empty, empty  # the last rows
        leader, count = (0, 0), 0  # of the last row's region: first (id, rest) and rows so far
        for batch in batches:
            kept = len(key)
            key, rest, ids = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((key, "key"), (rest, "rest"), (ids, "id")))
            n = len(key)
            if n == kept:
                continue
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, n))
            region = np.repeat(np.arange(len(starts)), sizes)
            first, first_rest = ids[starts].copy(), rest[starts].copy()
            dropped = np.zeros(len(starts), np.int64)  # earlier rows of the region that are not in mind
            was = 0
            if kept:
                r = region[kept - 1]
                first[r], first_rest[r] = leader
                dropped[r] = count - (kept - starts[r])
                was = count
            pairs = []
            for w in range(1, WINDOW + 1):
                i = np.arange(max(kept, w), n)
                i = i[key[i] == key[i - w]]
                pairs.append((ids[i - w], ids[i]))
            i = np.arange(kept, n)
            pairs.append((first[region[i]], ids[i]))
            a, b = (np.concatenate(x) for x in zip(*pairs))
            got = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b)))[a != b], axis=0)
            wide = sizes + dropped > WINDOW + 1
            out = wide[region] & (np.arange(n) >= kept)
            extra = []
            if kept:
                r = region[kept - 1]
                if wide[r] and was <= WINDOW + 1:  # it has just become wide: its earlier rows too
                    out[starts[r] : kept] = True
                    if dropped[r]:
                        extra.append(r)
            m = np.flatnonzero(out)
            x = np.array(extra, np.int64)
            member = [np.concatenate((ids[m], first[x])), np.concatenate((key[m], key[starts[x]])), np.concatenate((rest[m], first_rest[x]))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((got[:, 0], member[0]))),
                    pa.concat_arrays([pa.array(got[:, 1], pa.int64()), pa.nulls(len(member[0]), pa.int64())]),
                    *(pa.concat_arrays([pa.nulls(len(got), pa.int64()), pa.array(c, pa.int64())]) for c in member[1:]),
                ],
                ["a", "b", "key", "rest"],
            )
            r = region[-1]
            leader, count = (first[r], first_rest[r]), int(sizes[r] + dropped[r])
            lo = max(starts[r], n - WINDOW)
            key, rest, ids = key[lo:], rest[lo:], ids[lo:]

    return ordered.mapInArrow(run, "a long, b long, key long, rest long")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=1) / K


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs with the estimate of their similarity, those below LEAST_ESTIMATE left out."""
    sig = classes.select("id", "sig", "n")
    rows = pairs.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            e = _agree(_matrix(batch.column("sa"), K, np.uint16), _matrix(batch.column("sb"), K, np.uint16))
            keep = pa.array(e >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(e[e >= LEAST_ESTIMATE])], ["a", "b", "e"])

    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, e double")


def trees_of(ids: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """Each id with the least id of its component, where the two differ. linked(labels) gives each row's least
    label among its neighbours and itself."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        new = linked(label)
        new = np.minimum(new, new[order][new])  # jump: the label of the row that the label names
        if np.array_equal(new, label):
            break
        label = new
    root = ids[order][label]
    far = root != ids
    return root[far], ids[far]


def block_links(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Trees of the links among rows with shingle sets, by exact intersections."""
    m = len(ids)
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(m), n)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1  # a shingle of one row is in no intersection
    keep = counts[inverse] > 1
    row, col = row[keep], shared[inverse[keep]]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, (lo, lo + 4096))
        part = np.zeros((m, min(4096, int(col[-1]) + 1 - lo)), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        both += part @ part.T
    links = (both > 0) & (100 * both >= PERCENT * (n[:, None] + n[None, :] - both))
    np.fill_diagonal(links, True)
    return trees_of(ids, lambda label: np.where(links, label[None, :], m).min(axis=1))


def family_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Trees (a, b) of confirmed links. rows: id, family, part (a family's part that is confirmed alone); only
    ids in rows are read from texts."""
    own = rows.join(texts.where("text is not null").toDF("id", "text"), "id")

    def sets(batches):
        for batch in batches:
            for a, b, data, offs in V.chunks(batch.column("text")):
                got = V.shingle_sets(data, offs, SHINGLE)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "family", "parts")), pa.array([x.tobytes() for x in got], pa.binary())], ["id", "family", "parts", "s"])

    grouped = own.groupBy("id").agg(F.first("family").alias("family"), F.collect_set("part").alias("parts"), F.first("text").alias("text"))
    made = grouped.mapInArrow(sets, "id long, family long, parts array<string>, s binary")

    def run(t):
        t = t.sort_by("id")
        a, b = block_links(t.column("id").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return made.select("id", "family", F.explode("parts").alias("part"), "s").groupBy("family", "part").applyInArrow(run, "a long, b long")


def confirmed(families: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Trees of the links inside families (id, family) on full sets."""
    sized = families.join(classes.select("id", "n"), "id")
    totals = sized.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / ROWS), F.ceil(F.col("total") / SHINGLES)).cast("int")
    rows = materialize(sized.join(totals.select("family", blocks.alias("k")), "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).select("id", "family", "n", "k", "block"), "family")
    wide = rows.where("k > 1")
    # The first rows of a family by a hash, found by partial minima, stand in all its blocks.
    hubs = wide.withColumn("slot", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(HUBS))).groupBy("family", "slot").agg(F.min("id").alias("id"), F.first("k").alias("k"))
    hubs = hubs.select("id", "family", F.explode(F.sequence(F.lit(0), F.col("k") - 1).cast("array<string>")).alias("part"))
    first = materialize(family_links(rows.select("id", "family", F.col("block").cast("string").alias("part")).unionByName(hubs), texts), "link")
    if wide.isEmpty():
        return first
    comps = materialize(connected_components(first, "a", "b"), "comp")
    named = wide.join(comps.toDF("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")).select("id", "family", "c", "n")
    parted = named.groupBy("family").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("family")
    left = materialize(named.join(parted, "family", "left_semi"), "parted")
    if left.isEmpty():
        return first
    small, same = split(left.withColumns({"key": F.col("family"), "rest": F.lit(0).cast("long")}), classes, ROWS, SHINGLES, DEPTH)
    parts = small.select("id", "family", F.col("key").cast("string").alias("part"))
    # Rows of one signature, too many for a block: blocks with the same first rows again.
    m = same.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("k"))
    same = same.join(m, "key")
    part = F.concat_ws("-", "key", F.pmod(F.xxhash64("id"), F.col("k")))
    hubs = same.withColumn("slot", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(HUBS))).groupBy("key", "slot").agg(F.min("id").alias("id"), F.first("family").alias("family"), F.first("k").alias("k"))
    hubs = hubs.select("id", "family", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "key").select("id", "family", F.concat_ws("-", "key", "i").alias("part"))
    return first.unionAll(materialize(family_links(parts.unionAll(same.select("id", "family", part.alias("part"))).unionAll(hubs), texts), "link"))


def split(rows: DataFrame, classes: DataFrame, most: int, shingles: int | None = None, depth: int = BASE) -> tuple[DataFrame, DataFrame]:
    """The regions of rows (id, key, rest, c, n and others) that hold several c, in parts (by key) of at most `most` rows and
    so many shingles, or of HUBS rows; and those too large parts whose rows agree in all K values. At depth DEPTH, where rest has
    no more values, each row goes into the further trees once, whatever trees it came from: a row's part is told by its
    values (and by the key, if regions began at this depth)."""
    fits = f"m <= {most}" + ("" if shingles is None else f" and (m <= {HUBS} or total <= {shingles})")

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.sum("n").alias("total")).where("m > 1 and c1 < c2")
        found = materialize(rows.join(materialize(sizes.select("key", "m", "total"), "sizes"), "key"), "open")
        return found.where(fits).drop("m", "total"), found.where(f"not ({fits})").drop("m", "total")

    small, rows = parted(rows)
    step, alone = 0, depth == DEPTH
    while not rows.isEmpty() and step < K:
        if depth < DEPTH:
            depth += 1
            rows = rows.withColumn("key", F.xxhash64("key", F.shiftrightunsigned("rest", 16 * (DEPTH - depth)).bitwiseAND(F.lit(65535))))
        else:
            if not (step or alone):
                rows = rows.withColumn("key", F.lit(0).cast("long")).dropDuplicates(["id"])
            rows = deeper(rows, classes, step)
            step += STEP
        here, rows = parted(rows)
        small = small.unionByName(here)
    return small, rows


def deeper(rows: DataFrame, classes: DataFrame, step: int) -> DataFrame:
    """The rows with keys of STEP values more; at first, of each further tree. rest then is the tree's number."""
    own = [c for c in rows.columns if c not in ("key", "rest")]

    def run(batches):
        for batch in batches:
            sig = _matrix(batch.column("sig"), K, np.uint16).astype(np.uint64)
            key, at = batch.column("key").to_numpy().view(np.uint64), np.arange(batch.num_rows)
            trees = range(FURTHER) if step == 0 else [batch.column("rest").to_numpy()]
            for t in trees:
                with np.errstate(over="ignore"):
                    new = key + np.uint64(t + 1) if step == 0 else key
                    for i in range(step, step + STEP):
                        new = V.mix(new * np.uint64(V.R) + sig[at, _FURTHER[t, i]])
                rest = np.full(len(at), t) if step == 0 else t
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(new.view(np.int64)), pa.array(rest)], [*own, "key", "rest"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c in own) + ", key long, rest long"
    return rows.join(classes.select("id", "sig"), "id").select(*own, "key", "rest", "sig").mapInArrow(run, kinds)


def bridges(members: DataFrame, families: DataFrame, classes: DataFrame) -> DataFrame:
    """Trees (a, b) of what joins families in the wide regions: pairs whose estimate is high enough. members: id, key, rest."""
    named = members.join(families, "id", "left").select("id", "key", "rest", F.coalesce("family", "id").alias("c"), F.lit(1).alias("n"))
    small, same = split(named, classes, REGION)
    rows = small.select("key", "id", "c").join(classes.select("id", "sig", "n"), "id")

    def run(t):
        ids, c, n = (t.column(x).to_numpy() for x in ("id", "c", "n"))
        sig = _matrix(t.column("sig"), K, np.uint16)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b = [], []
        for i in range(len(ids)):
            j = i + 1 + np.flatnonzero((c[i + 1 :] != c[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= PERCENT * np.maximum(n[i + 1 :], n[i])))
            if len(j):
                j = j[(sig[j, :32] == sig[i, :32]).sum(axis=1) >= 8]  # the first values settle most pairs
                j = j[(sig[j] == sig[i]).sum(axis=1) >= LEAST_ESTIMATE * K]
            for x in j.tolist():
                p, q = find(int(c[i])), find(int(c[x]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(int(ids[i]))
                    b.append(int(ids[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    alike = same.join(materialize(same.groupBy("key").agg(F.min("id").alias("a")), "alike"), "key").where("id <> a").select("a", F.col("id").alias("b"))
    return rows.groupBy("key").applyInArrow(run, "a long, b long").unionAll(alike)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; docs has doc_id and text."""
    texts = bucketed(docs.select("doc_id", "text"), ["doc_id"], "near")
    sigs = materialize(signatures(texts), "sig")
    one = sigs.where("n > 0").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    ids = materialize(one.join(one.groupBy("digest").agg(F.min("doc_id").alias("id")), "digest"), "ids")
    firsts = ids.where("doc_id = id").select("doc_id", "digest")
    classes = materialize(
        sigs.join(firsts, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.any_value("n").alias("n"), F.any_value("sig").alias("sig")).select(F.col("doc_id").alias("id"), "n", "sig"),
        "class",
    )
    swept = materialize(neighbours(labels(classes)), "sweep")
    members = swept.where("b is null").select(F.col("a").alias("id"), "key", "rest")
    candidates = materialize(estimated(swept.where("b is not null").select("a", "b").distinct(), classes), "cand")
    name = lambda df: df.select("id", F.col("component").alias("family"))
    families = materialize(name(connected_components(candidates, "a", "b")), "fam")
    found = materialize(bridges(members, families, classes), "bridge")
    if not found.isEmpty():
        families = materialize(name(connected_components(families.select(F.col("id").alias("a"), F.col("family").alias("b")).unionAll(found), "a", "b")), "fam")
    links = confirmed(families, classes, texts)
    final = connected_components(links, "a", "b")
    comp = ids.join(final.toDF("id", "component"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    for df in (texts, swept, candidates, found):
        discard(df)
    return sigs.join(comp, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def op7_lsh_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept FROM d JOIN m ON m.id = doc_id LEFT JOIN n USING (doc_id)
"""
