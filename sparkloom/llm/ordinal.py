"""Quality by ordinal cumulative-link regression: P(grade <= k) = sigmoid(threshold_k - weights . features).

One weight vector over hashed text features is shared by all grades; ordered thresholds part them. Grades of
the labels table: 0 toxic, 1 of low quality, 2 good. A document's result is its expected grade and its tail
probability P(grade >= 2), by which documents are selected.

Features are present or absent: lower-cased words, and buckets of the shares of symbols, capitals, separators,
distinct words and distinct word pairs and of the length. A hashed word counts if at least MIN_DOCS sample
documents have it and it goes with some grade by LEAST_Z standard errors.

The fit takes a bounded sample: the SAMPLE labelled documents of smallest hash. Scoring reads every document.

Features and score of a row come from that row alone, whatever stands beside it in a batch.

Defined cases: a null text is empty and gets the bucket features only; a null label is ignored; of several
labels of a document the lowest grade counts; rows of a null doc_id are scored like others and never sampled;
repeated documents give repeated rows; a tail probability of TAIL exactly is kept; without labels, or with
labels of one grade only, the model is that grade's constant; a very long text is scored in one piece, at some
60 bytes of memory a byte; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .base import spread, table

BITS = 18
SAMPLE = 12_000
MIN_DOCS = 4
#: Standard errors by which a word's count with a grade must exceed what chance gives.
LEAST_Z = 4.0
ROUNDS = 150
GRADES = 3
TAIL = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&<>!|", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _bucket(kind: int, value) -> np.ndarray:
    return (V.mix(np.asarray(value).astype(np.uint64) + np.uint64(1000 * (kind + 1))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row, one after the other, and where each row's begin (one more than rows)."""
    h, _, _, upto = V.word_hashes(data, offs, V.ALNUM)
    rows = len(offs) - 1
    n = np.diff(upto)
    doc = np.repeat(np.arange(rows, dtype=np.int64), n)
    keys = np.unique((doc << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    size = np.diff(offs)
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask[data])))[offs]) / np.maximum(size, 1)
    distinct = np.bincount(keys >> BITS, minlength=rows) / np.maximum(n, 1)
    bar = np.zeros(256, bool)
    bar[124] = True
    pairs = V.run_hashes(h, 2)
    own = doc[: len(pairs)] == doc[1 : len(pairs) + 1]  # a pair over the end of a row is of neither row
    inner = np.unique((doc[: len(pairs)][own] << 40) | (pairs[own] >> np.uint64(24)).astype(np.int64))
    fresh = np.bincount(inner >> 40, minlength=rows) / np.maximum(n, 1)
    parts = [
        np.ceil(np.log2(1 + 500 * share(_SYMBOL))),
        np.ceil(np.log2(1 + 100 * share(_UPPER))),
        np.ceil(np.log2(1 + 500 * share(bar))),
        np.floor(20 * distinct),
        np.ceil(np.log2(1 + n)),
        np.floor(10 * fresh),
    ]
    extra = [(np.arange(rows) << BITS) | _bucket(i, p) for i, p in enumerate(parts)]
    keys = np.unique(np.concatenate([keys, *extra]))
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(rows + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_and_gradient(p: np.ndarray, doc: np.ndarray, col: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalty, and the gradient. p: weights, the first threshold, and the
    logarithm of what the second is above it; (doc, col) are the features that are present."""
    n, own = len(grade), np.arange(len(grade))
    s = np.bincount(doc, p[col], minlength=n)
    cut = np.array([p[-2], p[-2] + np.exp(p[-1])])
    c = _sigmoid(cut[None, :] - s[:, None])
    prob = np.diff(np.column_stack((np.zeros(n), c, np.ones(n))), axis=1)
    inv = np.zeros_like(prob)
    inv[own, grade] = 1 / np.maximum(prob[own, grade], 1e-12)
    up = (inv[:, :-1] - inv[:, 1:]) * (c * (1 - c))  # of the log likelihood by each threshold
    g = np.empty_like(p)
    g[:-2] = np.bincount(col, up.sum(axis=1)[doc], minlength=len(p) - 2) / n + l2 * p[:-2]
    g[-2] = -up.sum() / n
    g[-1] = -up[:, 1].sum() / n * np.exp(p[-1])
    return float(-np.log(np.maximum(prob[own, grade], 1e-12)).mean() + l2 / 2 * (p[:-2] ** 2).sum()), g


def fit(index: np.ndarray, begins: np.ndarray, grade: np.ndarray, rounds: int = ROUNDS, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the mean negative log likelihood. Deterministic."""
    n = len(grade)
    w = np.zeros(1 << BITS)
    if not n:
        return w.astype(np.float32), np.array([-20.0, -10.0])
    share = np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / n
    share = np.clip(share, 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    theta = np.array([theta[0], max(theta[1], theta[0] + 1e-3)])
    raw = np.array([theta[0], np.log(theta[1] - theta[0])])  # the second threshold is the first plus exp()
    doc = np.repeat(np.arange(n), np.diff(begins))
    # Words that part the grades: seen with some grade far more often than its share of documents has it.
    seen = np.bincount(index, minlength=1 << BITS)
    odd = np.zeros(1 << BITS, bool)
    for g in range(GRADES):
        expected = seen * (grade == g).mean()
        odd |= np.bincount(index[grade[doc] == g], minlength=1 << BITS) - expected >= LEAST_Z * np.sqrt(np.maximum(expected, 0.3))
    odd[np.concatenate([_bucket(i, np.arange(64)) for i in range(6)])] = True
    used = (seen >= MIN_DOCS) & odd
    live = np.flatnonzero(used)
    slot = np.full(1 << BITS, -1)
    slot[live] = np.arange(len(live))
    col = slot[index]
    doc, col = doc[col >= 0], col[col >= 0]
    p = np.zeros(len(live) + 2)
    p[-2:] = raw
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        _, g = loss_and_gradient(p, doc, col, grade, l2)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[live] = p[:-2]
    return w.astype(np.float32), np.array([p[-2], p[-2] + np.exp(p[-1])])


def sample_of(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of at most size labelled documents, brought to the driver (bounded by size)."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches):
        for batch in batches:
            for a, b, data, offs in V.chunks(batch.column("text")):
                index, begins = features(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("grade").slice(a, b - a), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(index, pa.int32()))], ["doc_id", "grade", "f"]
                )

    got = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, f array<int>").toArrow().sort_by("doc_id")
    f = got.column("f").combine_chunks()
    lists = f.chunk(0) if isinstance(f, pa.ChunkedArray) else f
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, int)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths))).astype(int), got.column("grade").to_numpy().astype(int)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], tail: float = TAIL, carry: list[str] = ()) -> DataFrame:
    """expected_grade, tail_probability and kept for every row of docs; carry names columns to keep beside doc_id."""
    weights, cut = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in ("doc_id", *carry)])
    for name, kind in (("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("kept", T.BooleanType())):
        schema = schema.add(name, kind)

    def run(batches):
        w = weights.value
        for batch in batches:
            for a, b, data, offs in V.chunks(batch.column("text")):
                index, begins = features(data, offs)
                s = np.bincount(np.repeat(np.arange(b - a), np.diff(begins)), w[index], minlength=b - a)  # a row's own sum, in order
                c = _sigmoid(cut[None, :] - s[:, None])
                good = np.round(1 - c[:, -1], 6)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(a, b - a) for x in ("doc_id", *carry)), pa.array(np.round((1 - c).sum(axis=1), 6)), pa.array(good), pa.array(good >= tail)],
                    ["doc_id", *carry, "expected_grade", "tail_probability", "kept"],
                )

    own = dict.fromkeys(["doc_id", *carry, "text"])
    return docs.select(*own).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return fit(*sample_of(docs, labels))


def op8_ordinal(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(spread(docs, "doc_id"), model)
