"""The cumulative-link model: gradients, a row's independence of its neighbours, ties and odd tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import ordinal
from sparkloom.llm import vectext as V


def rows_of(texts):
    index, begins = ordinal.features(*V.buffer_of(pa.array(texts, pa.string())))
    return [index[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]


def test_features_of_a_row_do_not_depend_on_neighbours():
    texts = ["hello", "world again", None, "", "hello hello", "one two one two one two", "ÄÖ ## | x", "z" * 3000 + " y"]
    alone = [rows_of([t])[0] for t in texts]
    rng = random.Random(3)
    for _ in range(20):
        order = [rng.randrange(len(texts)) for _ in range(9)]
        assert rows_of([texts[i] for i in order]) == [alone[i] for i in order]


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(2)
    n, k = 40, 7
    doc, col = np.nonzero(rng.random((n, k)) < 0.4)
    grade, p = rng.integers(0, ordinal.GRADES, n), rng.normal(0, 0.5, k + 2)
    _, g = ordinal.loss_and_gradient(p, doc, col, grade, 0.01)
    for i in range(k + 2):
        step = np.zeros(k + 2)
        step[i] = 1e-6
        want = (ordinal.loss_and_gradient(p + step, doc, col, grade, 0.01)[0] - ordinal.loss_and_gradient(p - step, doc, col, grade, 0.01)[0]) / 2e-6
        assert abs(want - g[i]) < 1e-6, i


def test_likelihood_against_plain_loops():
    p, doc, col, grade = np.array([0.5, -1.0, 0.2, -0.3]), np.array([0, 0, 2]), np.array([0, 1, 1]), np.array([2, 0, 1])
    t1, t2 = 0.2, 0.2 + np.exp(-0.3)
    upto = lambda t, s: 1 / (1 + np.exp(-(t - s)))
    want = -(np.log(1 - upto(t2, -0.5)) + np.log(upto(t1, 0.0)) + np.log(upto(t2, -1.0) - upto(t1, -1.0))) / 3
    assert abs(ordinal.loss_and_gradient(p, doc, col, grade, 0.0)[0] - want) < 1e-12


def test_scores_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice(["the", "vile", "of", "###", "and"]) for _ in range(rng.randrange(1, 60)))) for i in range(300)] + [(None, "the of and"), (None, None), (7, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, labels)
    got = [sorted(map(str, ordinal.score(d, model, carry=["text"]).collect())) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy("text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(data)
    again = ordinal.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])


def test_one_grade_only_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in ordinal.score(docs, ordinal.train(docs, labels)).collect()] == [False, False]
    assert ordinal.score(docs.limit(0), ordinal.train(docs.limit(0), labels)).count() == 0
