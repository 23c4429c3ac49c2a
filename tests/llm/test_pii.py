"""Personal data: base spans against the contract's patterns and DuckDB, the network against enumeration, held-out text."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time

import duckdb
import held_out
import numpy as np
import pytest

from sparkloom.llm import pii

CONTRACT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in CONTRACT for m in re.finditer(p, text) if valid(k, m.group())]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice("01259..@@-+ a(é") for _ in range(rng.randrange(1, 50)))
        yield " ".join(rng.choice(["4111 1111 1111 1111", "a.b@c.d", "+1 555 123 4567", "10.0.0.1", "1.2.3.4.5.6.7.8.9", "x@y@z.w.", "00256.1.1.1", "+", "."]) for _ in range(4))


def test_base_spans_are_the_patterns_matches():
    for text in odd_texts(20_000):
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize(
    "text",
    ["x 1.1.1." + "0" * 5000 + " @", "0" * 1_000_000 + " @", "a" * 1_000_000 + " @ 1", "a." * 500_000 + "@1", "1." * 500_000, "@a" * 300_000 + "1", "+1" + "(" * 1_000_000, "+1 " * 300_000, "4 " * 500_000],
    ids=lambda t: f"{t[:6]}x{len(t)}",
)
def test_long_runs_take_linear_time(text):
    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 20


def test_base_columns_by_sql(spark):
    texts = [*odd_texts(300, 5), None, "", "é" * 40 + " ü@b.c a.b@é.c", "4111111111111111 5500-0000-0000-0004", *(t for t, _ in held_out.labelled())]
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(c.execute(f"SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256 FROM ({pii.BASE_SQL})").fetchall())
    assert got == want
    for i, t in rows:
        assert got[i][5] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or "")).encode()).hexdigest()


def test_paths_against_enumeration():
    rng = np.random.default_rng(3)
    e, a = rng.normal(size=(4, 2, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)) + pii._allowed()
    tags, chance = pii.viterbi(e, a), pii.posteriors(e, a)
    for n in range(2):
        paths = [p for p in itertools.product(range(pii.TAGS), repeat=4) if not (p[0] and p[0] % 2 == 0)]
        score = np.array([sum(e[t, n, p[t]] for t in range(4)) + sum(a[p[t - 1], p[t]] for t in range(1, 4)) for p in paths])
        assert tags[n].tolist() == list(paths[int(score.argmax())])
        w = np.exp(score - score.max())
        for t in range(4):
            want = np.bincount([p[t] for p in paths], w, minlength=pii.TAGS) / w.sum()
            assert np.allclose(chance[t, n], want, atol=1e-9)


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    p = {"E": rng.normal(size=(pii.CLASSES, pii.EMBED)), "O": rng.normal(size=(2 * pii.HIDDEN, pii.TAGS)), "o": rng.normal(size=pii.TAGS), "A": rng.normal(size=(pii.TAGS, pii.TAGS))}
    p |= {"W": rng.normal(size=(2, pii.EMBED, 4 * pii.HIDDEN)), "U": rng.normal(size=(2, pii.HIDDEN, 4 * pii.HIDDEN)), "b": rng.normal(size=(2, 1, 4 * pii.HIDDEN))}
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 0]] * 3)
    _, g = pii._step(x, y, p)
    for k in p:
        for i in [np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape), tuple(int(rng.integers(d)) for d in g[k].shape)]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            want = (pii._step(x, y, up)[0] - pii._step(x, y, down)[0]) / 2e-5
            assert math.isclose(want, g[k][i], rel_tol=1e-3, abs_tol=1e-6), k


def test_tagger_on_held_out_windows():
    p = pii.trained()
    x, y = pii.labelled(200, 12345)
    tags = pii.viterbi(pii.emissions(x, p), p["A"])
    assert (tags == y).mean() > 0.96 and (tags == y)[y > 0].mean() > 0.85


def test_tagger_on_sentences_of_no_generator():
    data = held_out.labelled()
    found = pii.tag_texts([t for t, _ in data], pii.trained())
    right = wrong = 0
    for (text, spans), f in zip(data, found):
        got = set(pii.reconcile(text, pii.base_spans(text), f))
        right, wrong = right + len(got & set(spans)), wrong + len(got - set(spans))
    total = sum(len(s) for _, s in data)
    print(f"precision {right / (right + wrong):.2f}, recall {right / total:.2f} of {total}")
    assert right >= 0.65 * total and right >= 0.85 * (right + wrong)


def test_tagger_adds_what_the_patterns_drop():
    text = "Des +1 (826) 555-4081 190.137.223.20 and call (555) 123-4567 now, page 12 of 2024."
    found = pii.reconcile(text, pii.base_spans(text), pii.tag_texts([text], pii.trained())[0])
    assert found == [("ip", 22, 36), ("phone", 4, 21), ("phone", 46, 60)]


def test_spans_do_not_depend_on_windows():
    """A span is found wherever it stands in the text, over the edges of cores too, and once."""
    p = pii.trained()
    for pad in range(0, 100, 3):
        text = "word " * (pad // 5) + "x" * (pad % 5) + " call (212) 867-5309 or " + "mail sales@localhost now " + "word " * 20
        got = pii.reconcile(text, pii.base_spans(text), pii.tag_texts([text], p)[0])
        assert ("phone", text.index("("), text.index("(") + 14) in got, pad
        assert len(got) <= 2


def test_odd_rows(spark):
    rows = [(None, "a.b@c.de"), (1, None), (1, None), (2, ""), (3, "4" * 300_000), (4, "word " * 100_000 + "a.b@c.de")]
    got = sorted(((r["doc_id"] or 0), r["n_email"], r["n_spans"]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), redact=True).collect())
    assert got == [(0, 1, 1), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 1)]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
