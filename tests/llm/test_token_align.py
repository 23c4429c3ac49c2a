"""Alignment of two tokenizers against a walk over both token lists of whole texts."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest
from sparkloom.llm import token_align as A

pytestmark = pytest.mark.skipif(not os.path.exists(A.BYTE_BPE), reason="needs the vocabulary files")
SCHEMA = "doc_id long, text string, n_a long, batch long"
PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", " the", "'s", "12", "é", "漢字", "😀", "ก", "\x1c", "\u00a0", "\u2003", "▁", "<s>", "<|endoftext|>", "<0x41>", "\x00", "\x85", "====", "ที่", "Ⅷ", "\u0301", "\r\n", "\u3000", "x  "]


def walked(text):
    """Ids, ends and groups of whole texts, by two pointers."""
    tk = A.tokenizers(A.BYTE_BPE, A.PIECES)
    if not text:
        return [], [], [], []
    a, b = tk.a.encode(" " + text, add_special_tokens=False).ids, tk.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(tk.a_bytes[i] for i in a) != whole or b"".join(tk.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    spans = [[], []]
    for ids, spelt, out in ((a, tk.a_bytes, spans[0]), (b, tk.b_bytes, spans[1])):
        at = 0
        for i in ids:
            out.append((at, at + len(spelt[i])))
            at += len(spelt[i])
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for c in cuts:
        groups.append(tuple([i for i, (s, _) in zip(ids, at) if low <= s < c] for ids, at in ((a, spans[0]), (b, spans[1]))))
        low = c
    overlaps = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    return a, b, groups, (cuts, overlaps)


def brute(rows):
    found = [(d, *walked(t)[:3]) for d, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for *_, groups in found]
    held = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for (d, a, b, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(c for p, c in own.items() if held[p] == best[p[0]])
        out.append((d, len(a), len(b), len(groups), sum(own.values()), n_best, sum(c * held[p] for p, c in own.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def made(seed, n, most=12):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))) for i in range(n)]
    return rows + [(7, None), (None, "a b c"), (7, ""), (8, " "), (9, "  "), (9, "a "), (9, "a "), (10, "the cat " * 3000)]


key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


@pytest.mark.parametrize("batch,at_once", [(A.BATCH_BYTES, A.LINKS_AT_ONCE), (200, 3)])
def test_equals_walking_both_lists(spark, monkeypatch, batch, at_once):
    monkeypatch.setattr(A, "BATCH_BYTES", batch)
    monkeypatch.setattr(A, "LINKS_AT_ONCE", at_once)
    rows = made(batch, 300)
    got = A.linked(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_overlaps_and_cuts(spark):
    rows = made(5, 60)[:-1]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    for r in A.align(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)).collect():
        a, b, groups, more = walked(rows[r["doc_id"]][1])
        cuts, overlaps = more or ([], [])
        assert (r["a_ids"], r["b_ids"], r["cuts"], list(zip(r["overlap_a"], r["overlap_b"]))) == (a, b, cuts, overlaps)


def test_whole_texts_where_a_piece_reaches_over_blanks(spark):
    """Without the property that lets texts be taken apart they are encoded whole, with equal results."""
    tk = A.tokenizers(A.BYTE_BPE, A.PIECES)
    texts = [t for _, t in made(6, 80) if t]
    parts = A.units_of(texts, tk)
    tk.splits = False
    try:
        whole = A.units_of(texts, tk)
    finally:
        tk.splits = True
    for kind in ("n_a", "n_b", "n_groups", "n_links"):
        assert A._sums(getattr(parts[0], kind), *parts[1:]).tolist() == A._sums(getattr(whole[0], kind), *whole[1:]).tolist()


def test_empty_table(spark):
    assert A.linked(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["n_a"] for r in A.linked(spark.createDataFrame([(1, None, 0, 0)], SCHEMA)).collect()] == [0]
