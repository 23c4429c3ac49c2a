"""Document operators against brute force on a small table with nulls, repeats, ties and odd texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import bwt_dedup, fm_index, lsh_forest, ordinal, pii, quality_rules, sharding, sp_sample, substring_chain

SCHEMA = "doc_id long, text string, lang string, n_words long, kept boolean"


def rows():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("an", "re", "éa", "ou", "the") for b in ("ti", "on", "ß", "ing", "er")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(120) + "."
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = say(70)
    texts = [
        base, base, near, base.upper(), say(80) + " " + passage + ".", passage + " " + say(50) + ".", None, None, "", " \n\t ", "x", "one two three", "one two three", "a b c d e", "a b\x0bc d e",
        "word " * 300, ("same line here.\n" * 20), say(3000) + ".", "日本語 🙂 text ▁ here", "no end of line", "Mail a.b@mail1.example.com or +1 (555) 555-0199, 10.1.2.3; 4111 1111 1111 1111.", "a" * 700, "a" * 700 + "b",
        "z" * 150 + "q" + "z" * 199, "buy | now | menu | home\nbuy | now | menu | home",
    ]
    return [(i, t, "en", 7, None) for i, t in enumerate(texts)] + [(3, base.upper(), "en", 7, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, empty):
    got = {(r["doc_id"]): r for r in quality_rules.clean(docs).collect()}
    for i, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit)), i
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert got[0]["kept"] and not got[24]["kept"]
    assert quality_rules.clean(docs).count() == len(rows()) and quality_rules.clean(empty).count() == 0


def test_long_runs_of_marks_take_linear_time(spark):
    import time

    lines = ["!" * 300_000, "?!" * 150_000 + " x", "a!! b!! c!! d", "a!!!b??c!?", "a! b! c!", "!!x!!y!!", "!!x!!y!!z"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    began = time.time()
    got = [r["s"] for r in df.select("i", quality_rules.F.col("x").rlike(quality_rules.SHOUTS).alias("s")).orderBy("i").collect()]
    assert got == [bool(re.search(r"([!?]{2,}[^!?]+){3}", x)) if len(x) < 100 else False for x in lines]
    assert time.time() - began < 20


def test_quality_rules_long_path(docs, monkeypatch):
    want = {(r["doc_id"], r["n_repeat_words"]) for r in quality_rules.clean(docs).collect()}
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 6)  # texts of over 63 words take the path of whole strings
    assert {(r["doc_id"], r["n_repeat_words"]) for r in quality_rules.clean(docs).collect()} == want


@pytest.mark.parametrize("fan", [2_000, 2])
def test_sharding(docs, empty, fan, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    monkeypatch.setattr(sharding, "CHUNK_GROUPS", 3)
    monkeypatch.setattr(sharding, "FAN", fan)
    got = sharding.assign(docs, 4).collect()
    assert len(got) == len(rows())
    shard_of: dict = {}
    texts = dict((i, t) for i, t, *_ in rows())
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert shard_of.setdefault(t, r["shard"]) == r["shard"]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(empty, 4).count() == 0


def test_differencing_balances_better_than_a_greedy_deal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 10_000) for _ in range(400)]
    bins = [x[0] for x in sharding.difference([[s, *[0] * 7] for s in sizes])]
    sums = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(8)]
    greedy = [0] * 8
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert sharding.difference([]) == []


def test_differencing_against_a_plain_one():
    """The same sums as combining the two lists of greatest spread until one is left, without heap or tree."""
    rng = random.Random(9)
    for k in (2, 3, 5):
        sizes = [rng.randrange(1, 10**9) for _ in range(37)]
        lists = [[s, *[0] * (k - 1)] for s in sizes]
        while len(lists) > 1:
            lists.sort(key=lambda x: x[-1] - x[0])  # most negative: the greatest spread
            a, b = lists[0], lists[1]
            lists[:2] = [sorted((x + y for x, y in zip(a, b[::-1])), reverse=True)]
        sums = [0] * k
        for s, x in zip(sizes, sharding.difference([[s, *[0] * (k - 1)] for s in sizes])):
            sums[x[0]] += s
        assert sorted(sums, reverse=True) == lists[0]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.mark.parametrize("region", [4096, 2])
def test_near_duplicates(docs, empty, region, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", region)
    monkeypatch.setattr(lsh_forest, "ROWS", 3)
    sets = {i: shingles(t) for i, t, *_ in rows()}
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = lsh_forest.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i), i
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_forest_links_a_wide_region(spark, monkeypatch):
    """A chain of texts that each differ a little from the one before; wide regions of many components."""
    monkeypatch.setattr(lsh_forest, "WINDOW", 1)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    data = []
    for g in range(3):
        own = [rng.choice(words) for _ in range(150)]
        for i in range(12):
            own = own[:]
            own[rng.randrange(150)] = f"e{g}{i}"
            data.append((len(data), " ".join(own)))
    sets = {i: shingles(t) for i, t in data}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = lsh_forest.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def brute_removal(texts, length=200):
    data = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_bwt_dedup(docs, empty, most, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "MOST_BYTES", most)  # 1: every minimizer is cut again, down to single windows
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_dedup.dedup(docs).collect())
    assert got == sorted((i, *x) for (i, *_), x in zip(rows(), brute_removal([t for _, t, *_ in rows()])))
    assert bwt_dedup.dedup(empty).count() == 0


def test_merged_transforms_sort_all_windows():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(210, 420))).encode() for _ in range(9)]
    parts.append(parts[0][5:230])
    own = np.array([len(p) - 199 for p in parts])
    got = bwt_dedup.repeated(parts, own, np.ones(len(parts), int), 700)
    c = Counter(p[i : i + 200] for p, n in zip(parts, own) for i in range(n))
    assert [m.tolist() for m in got] == [[c[p[i : i + 200]] > 1 for i in range(n)] for p, n in zip(parts, own)]


def test_windows_that_go_before_transforms_are_not_repeated():
    """All repeated windows are kept, and some others are not."""
    texts = [(t or "").encode() for _, t, *_ in rows()]
    base = "".join(random.Random(5).choice("abcdef") for _ in range(900)).encode()
    texts += [base, base[:520] + b"#" + base[520:], b"x" * 300 + base[100:330], b"ab" * 250]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, h, _, _, p, own = bwt_dedup.cut(data, offs)
    parts = [texts[r][a : a + n + 199] for r, a, n in zip(row.tolist(), p.tolist(), own.tolist())]
    lo, hi = bwt_dedup.candidates(parts, own, np.ones(len(parts), int), h)
    c = Counter(x[i : i + 200] for x, n in zip(parts, own) for i in range(n))
    twice = [np.array([c[x[i : i + 200]] > 1 for i in range(n)]) for x, n in zip(parts, own)]
    assert all(not t[:a].any() and not t[b:].any() for t, a, b in zip(twice, lo, hi))
    assert sum(map(np.sum, twice)) <= (hi - lo).sum() < own.sum() and (hi == lo).any()


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_fm_index(spark, docs, empty, block):
    texts = {i: t for i, t, *_ in rows()}
    items = [(1, " ".join(texts[0].split()[20:45])), (2, "one TWO three"), (10, "one two three"), (3, None), (4, "!!"), (5, "unknown words only here"), (6, texts[17][100:400]), (2, "One two three"), (7, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, tuple(w[j : j + k])) for i, t in items for w in [word(t)] if w for k in [min(10, len(w))] for j in range(len(w) - k + 1)]
    got = fm_index.find(docs, bench, block_words=block).collect()
    assert len(got) == len(rows())
    for r in got:
        w = word(texts[r["doc_id"]])
        hit, found = set(), set()
        for i, p in windows:
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(str(i))
        assert {x for a, b in zip(r["starts"], r["ends"]) for x in range(a, b)} == hit, r["doc_id"]
        assert r["n_words"] == len(w) and r["items"] == sorted(found)
    assert fm_index.find(empty, bench).count() == 0
    assert fm_index.find(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert fm_index.cut(docs.select("doc_id", "text"), bench).where("text like '%one two three%'").count() == 0


def test_phrases_of_a_block_are_made_once_for_a_batch(monkeypatch):
    """However many blocks and shards there are; the parts' results are those of one block."""
    import pyarrow as pa

    made = []
    phrases = fm_index.Phrases

    class Counted(phrases):
        def __init__(self, items, window):
            made.append(len(items))
            super().__init__(items, window)

    monkeypatch.setattr(fm_index, "Phrases", Counted)
    monkeypatch.setattr(fm_index, "_KEPT", {})
    held = lambda items: type("Held", (), {"value": items})()
    blocks = [(f"b{i}", held([(i, f"alpha{i} beta gamma")])) for i in range(10)]
    text = pa.array([f"say alpha{i % 10} beta gamma now" for i in range(60)])
    shards = list(fm_index.V.chunks(text, 200))
    assert len(shards) > 5
    for block in blocks:
        for _, _, data, offs in shards:
            fm_index.scan_shard(data, offs, fm_index.phrases_of(block, 10))
    assert made == [1] * 10


def test_pii(docs, empty):
    got = pii.find_pii(docs, redact=True).collect()
    assert len(got) == len(rows()) and pii.find_pii(empty).count() == 0
    r = next(x for x in got if x["doc_id"] == 20)
    assert (r["n_email"], r["n_phone"], r["n_ip"], r["n_card"]) == (1, 1, 1, 1)
    for x in got:
        t = dict((i, t) for i, t, *_ in rows())[x["doc_id"]] or ""
        want = []
        for kind, p in pii.PATTERNS.items():
            want += [f"{kind}:{m.start()}:{m.end()}" for m in p.finditer(t) if pii.passes(kind, m.group())]
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(x["spans"].split(","))
    assert "[EMAIL]" in r["redacted_text"] and "4111" not in r["redacted_text"]
    assert next(x for x in got if x["doc_id"] == 6)["redacted_text"] is None


def test_ordinal(spark, docs, empty):
    rng = random.Random(5)
    good = ["the", "of", "and", "in", "to", "was", "that"]
    data, labels = [], []
    for i in range(600):
        w = [rng.choice(good) + rng.choice("abc") for _ in range(60)]
        q, tox = 1, 0
        if i % 3 == 1:
            w, q = [x + "###" for x in w], 0
        if i % 3 == 2:
            w[rng.randrange(60)], tox = "vile", 1
        data.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, q, tox))
    labels += [(5, None, None), (None, 1, 0), (5, 0, 1)]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ordinal.train(d, lab)
    assert model[1][0] < model[1][1]
    held = [r for r in ordinal.score(d, model).collect() if r["doc_id"] >= 400]
    assert np.mean([r["kept"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in held)
    assert ordinal.score(docs, model).count() == len(rows()) and ordinal.score(empty, model).count() == 0
    none = ordinal.train(d, lab.limit(0))
    assert ordinal.score(docs, none, carry=["lang"]).where("kept").count() == len(rows())


def test_sampled_segmentations(docs, empty):
    got = sp_sample.encode(docs, k=3, with_ids=True).collect()
    texts = dict((i, t) for i, t, *_ in rows())
    v = sp_sample.vocabulary(sp_sample.MODEL, sp_sample.ALPHA)
    assert len(got) == len(rows()) and sp_sample.encode(empty).count() == 0
    for r in got:
        assert r["round_trip"] and len({tuple(x) for x in r["ids"]}) == r["n_samples"] >= 1
        assert all(v.decode(x) == (texts[r["doc_id"]] or "") for x in r["ids"]), r["doc_id"]
        assert all(x <= 0 for x in r["log_inclusion"])
    same = [r["ids_crc32"] for r in got if r["doc_id"] == 3]
    assert same[0] == same[1]


def test_samples_follow_the_exact_distribution():
    """Order and inclusion of samples without replacement against all segmentations of a short text."""
    import itertools

    v = sp_sample.vocabulary(sp_sample.MODEL, 1.0)
    ids = {b: i for i, b in enumerate(v.bytes) if b and i >= 259}

    def all_of(b, lo=0):
        if lo == len(b):
            yield (), 0.0
        for e in range(lo + 1, len(b) + 1):
            if b[lo:e] in ids:
                for r, x in all_of(b, e):
                    yield (ids[b[lo:e]], *r), x + v.weight[ids[b[lo:e]]]

    parts = [list(all_of(w.encode())) for w in ("▁the", "▁a")]
    every = [(a + b, x + y) for (a, x), (b, y) in itertools.product(*parts)]
    z = math.log(sum(math.exp(x) for _, x in every))
    p = {s: math.exp(x - z) for s, x in every}
    n = 8000
    data = np.frombuffer(b"the a" * n, np.uint8)
    got = sp_sample.sample_chunk(data, np.arange(n + 1) * 5, sp_sample.row_keys(np.arange(n), 0), v, 2)
    first, second = (Counter(tuple(g[i][0].tolist()) for g in got) for i in range(2))
    assert max(abs(first[s] / n - p[s]) for s in p) < 0.02
    want = {s: sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s) for s in p}
    assert max(abs(second[s] / n - want[s]) for s in p) < 0.02
    assert abs(np.mean([sum(math.exp(x[1] - x[2]) for x in g) for g in got]) - 1) < 0.01


def test_passages(docs, empty):
    got = substring_chain.passages(docs).collect()
    texts = {i: (t or "").lower().split() for i, t, *_ in rows()}
    covered: dict = {i: set() for i in texts}
    for r in got:
        assert r["similarity"] >= 0.75 and r["end_word"] - r["start_word"] >= 50
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        covered[r["partner_id"]] |= set(range(r["partner_start"], r["partner_end"]))
    seen: dict = {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    for where in seen.values():
        if len({i for i, _ in where}) > 1:
            for i, j in where:
                assert set(range(j, j + 50)) <= covered[i]
    assert {1, 2, 5} <= {r["doc_id"] for r in got}
    assert substring_chain.passages(empty).count() == 0


def test_chains_are_collinear_and_pay_for_gaps():
    x = np.array([0, 10, 20, 30, 500, 510, 15])
    y = np.array([100, 110, 121, 131, 90, 100, 900])
    got = substring_chain.chains(x, y)
    assert [c.tolist() for c in got] == [[[0, 100], [10, 110], [20, 121], [30, 131]], [[500, 90], [510, 100]]]


def test_alignment_bridges_an_insertion():
    u = np.arange(100, dtype=np.uint32)
    v = np.concatenate((u[:50], np.array([900, 901], np.uint32), u[50:]))
    px, py, match, *_ = substring_chain.align(u, v, np.array([10, 30, 60]), np.array([10, 30, 62]))
    assert match.sum() == 100
    assert substring_chain.stretches(px, py, match) == [(0, 100, 0, 102, pytest.approx(100 / 102))]


def test_samples_of_long_texts_and_null_keys(spark, monkeypatch):
    """A text over a chunk is sampled like any, and a null key gives the samples of -1."""
    rows = [(None, "one text of some words"), (-1, "one text of some words"), (1, "longer words and more " * 60), (1, "longer words and more " * 60), (2, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_pieces long")
    plain = lambda: sorted((tuple((x is None, str(x)) for x in r) for r in sp_sample.encode(df).collect()))
    want = plain()
    assert len(want) == len(sp_sample.encode(df.where("doc_id is not null")).collect()) + len(sp_sample.encode(df.where("doc_id is null")).collect())
    null, minus = ([tuple(r)[1:] for r in sp_sample.encode(df.where(c)).collect()] for c in ("doc_id is null", "doc_id = -1"))
    assert sorted(map(str, null)) == sorted(map(str, minus))
    monkeypatch.setattr(sp_sample, "CHUNK", 64)
    assert plain() == want
