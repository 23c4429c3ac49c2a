"""The pipeline's stages on a small corpus with planted cases, each against brute force on its own input."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from sparkloom.llm import pii

WORDS = [a + b for a in ("an", "re", "éa", "ou", "the", "mi") for b in ("ti", "on", "ß", "ing", "er", "la")]


def plain(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", plain(t))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))
    item = say(30)
    docs, labels = [], []
    for i in range(260):
        t = say(90) + "."
        if i % 4 == 1:
            t = " ".join(w + "###" for w in t.split())
        if i % 4 == 2:
            t = t.replace(" ", " vile ", 1)
        if i % 40 == 0:
            t = say(10) + " " + item + " " + say(40)
        if i % 40 == 4:
            t += " Write to a.b9@mail1.example.com or call +1 (555) 555-0199."
        if i % 40 == 8:
            t = docs[-4][1].replace(" ", "  ", 2)
        docs.append((i, t, "en", f"s{i % 3}", len(t), True, 5))
        if i % 2 == 0 or i % 4 == 1:
            labels.append((i, int(i % 4 != 1), int(i % 4 == 2)))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, starts int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_stages(spark, folder, tmp_path):
    path, item = folder
    rows = [spark.read.parquet(f"{path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows[-1], path)
        if k < 4:
            assert out.columns == rows[0].columns
        out.write.parquet(str(tmp_path / str(k)))
        rows.append(spark.read.parquet(str(tmp_path / str(k))))
    first, second, third, fourth, last = ({r["doc_id"]: r for r in df.collect()} for df in rows[1:])
    clean = [i for i in range(260) if i % 4 in (0, 3)]
    assert sum(i in first for i in clean) >= 0.97 * len(clean) and not any(i % 4 == 1 for i in first)
    assert sum(i % 4 == 2 for i in first) <= 4
    sets = {i: shingles(r["text"]) for i, r in first.items()}
    comp = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert set(second) == {i for i in comp if comp[i] == i} and len(second) < len(first)
    for i, r in third.items():
        assert (item in second[i]["text"]) == (r["text"] != second[i]["text"]) and item not in r["text"]
        assert r["n_chars"] == (len(r["text"]) if r["text"] != second[i]["text"] else second[i]["n_chars"])
    assert any(item in r["text"] for r in second.values())
    for i, r in fourth.items():
        assert not pii.base_spans(r["text"]) and (bool(pii.base_spans(third[i]["text"])) <= (r["text"] != third[i]["text"]))
    assert set(last) == set(fourth) and all(r["round_trip"] and r["n_samples"] == 2 for r in last.values())


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 100 and {"doc_id", "ids_crc32", "log_inclusion"} <= set(got.columns)


def test_odd_rows_and_empty_tables(spark, folder, tmp_path):
    """Nulls in any column, empty and repeated rows, a null id and a long text through all stages; then empty tables."""
    path, item = folder
    own = spark.read.parquet(f"{path}/documents.parquet")
    good = own.where("doc_id = 3").first()["text"]
    rows = [(9000, good, None, None, None, None, None), (9000, good, None, None, None, None, None), (9001, None, "en", "s", 0, True, 1), (9002, "", "en", "s", 0, True, 1), (None, good, "en", "s", 3, True, 1),
            (9003, " ".join([good] * 400) + " " + item, "en", "s", 1, False, 0)]
    docs = spark.createDataFrame(rows, own.schema)
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, path)
        out.write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert seen.columns == docs.columns
            texts = [(r["doc_id"], r["text"]) for r in seen.collect()]
            assert texts.count((None, good)) == 1 and texts.count((9000, good)) == 2
            assert all(t is None for i, t in texts if i == 9001)
    assert [r["round_trip"] for r in seen.where("doc_id is null or doc_id = 9000").collect()] == [True] * 3
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), path).count() == 0, k
    empty = tmp_path / "none"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.quality(spark, docs, str(empty)).count() == len(rows)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.decontaminate(spark, docs, str(empty)).collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
