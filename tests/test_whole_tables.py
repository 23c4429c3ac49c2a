"""Queries read and return whole tables: rows by plain Python, without the queries' SQL."""

from __future__ import annotations

import hashlib
import os
import re

import pandas as pd
import pytest

from sparkloom import catalog
from sparkloom.operators import memory as m

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def run(spark, name: str, sf: str = SF) -> list:
    got = [tuple(r) for r in catalog.queries()[name](spark, sf).collect()]
    print("ROWS", name, sf, len(got))
    return got


def table(name: str, sf: str = SF, columns=None) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/{name}.parquet", columns=columns)


def test_redaction_of_every_document(spark):
    def digest(text: str) -> str:
        text += ' api_key="abcdefghij0123456789" x'
        for p in m.SECRETS:
            text = re.sub(p, "[REDACTED]", text)
        return hashlib.md5(text.encode()).hexdigest()

    d = table("documents", columns=["doc_id", "text"])
    want = [(f"m{i}", None if t is None else digest(t)) for i, t in zip(d.doc_id, d.text)]
    assert sorted(run(spark, "pf7_redaction")) == sorted(want)


def test_ranking_of_every_section(spark):
    sf = "/root/testdata/sf0.01"
    d = table("conversations", sf)
    rows = [(c, -{"system": 100, "user": 85}.get(r, 72), len(x.encode()) // 4, n) for c, n, r, x in zip(d.conv_id, d.turn, d.role, d.text)]
    assert run(spark, "tk7_context_ranking", sf) == [(c, n, -p) for c, p, _, n in sorted(rows)]


def test_totals_of_every_project(spark):
    sf = "/root/testdata/sf0.01"
    line = table("lineitem", sf, ["l_suppkey", "l_quantity", "l_linenumber"])
    total = (line.l_quantity.astype(float).astype(int) + line.l_linenumber).groupby(line.l_suppkey).sum()
    want = sorted(((int(k), int(v)) for k, v in total.items()), key=lambda r: (-r[1], r[0]))
    got = run(spark, "ag3_top_projects", sf)
    assert [int(p) for p, _ in got] == [p for p, _ in want]
    assert [int(n) for _, n in got] == [n for _, n in want]


def test_calls_of_every_line(spark):
    line = table("lineitem", columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    files: dict = {}
    for k in table("supplier", columns=["s_suppkey"]).s_suppkey:
        files.setdefault(int(k) % 50, set()).add(int(k))
    want = []
    for o, n, s, p in line.itertuples(index=False):
        there = files.get(p % 50, set())
        want += [(o, n, p % 50, f) for f in ([s] if s % 2 == 0 and s in there else there)]
    assert sorted(tuple(map(int, r)) for r in run(spark, "jn6_resolved_calls")) == sorted(tuple(map(int, r)) for r in want)


def test_verdicts_over_every_section(spark):
    orders, line = table("orders"), table("lineitem")
    task = dict(zip(*[table("customer")[c] for c in ("c_custkey", "c_mktsegment")]))
    runs = {o: (task[c], s == "F") for o, c, s in zip(orders.o_orderkey, orders.o_custkey, orders.o_orderstatus) if c in task}
    good = {t: sum(ok for x, ok in runs.values() if x == t) for t in set(task.values())}
    seen: dict = {}
    for o, a, b, n in zip(line.l_orderkey, line.l_returnflag, line.l_linestatus, line.l_linenumber):
        if o in runs:
            for section in [f"{a}{b}{n % 2}"] + ["retry"] * (n == 2 and not runs[o][1]):
                seen.setdefault((runs[o][0], section), [0, 0])[not runs[o][1]] += 1
    for t, ok in runs.values():
        seen.setdefault((t, "goal"), [0, 0])[not ok] += 1
    want = [(t, s, "always" if good[t] and ok == good[t] else "only_failures") for (t, s), (ok, bad) in seen.items() if (good[t] and ok == good[t]) or (not ok and bad)]
    assert {v for _, _, v in want} == {"always", "only_failures"}
    assert sorted(run(spark, "ag8_prompt_suggestion")) == sorted(want)


def test_suggestion_reads_lines_of_any_number(spark, tmp_path):
    for name, rows in {
        "customer": {"c_custkey": [1], "c_mktsegment": ["A"]},
        "orders": {"o_orderkey": [1, 2], "o_custkey": [1, 1], "o_orderstatus": ["F", "O"], "o_orderpriority": ["1", "1"], "o_totalprice": [1.0, 1.0]},
        "lineitem": {"l_orderkey": [1, 2], "l_linenumber": [5, 6], "l_returnflag": ["N", "R"], "l_linestatus": ["O", "F"]},
    }.items():
        pd.DataFrame(rows).to_parquet(tmp_path / f"{name}.parquet")
    assert sorted(run(spark, "ag8_prompt_suggestion", str(tmp_path))) == [("A", "NO1", "always"), ("A", "RF0", "only_failures"), ("A", "goal", "always")]


def test_findings_of_every_rule(spark, tmp_path):
    texts = ['api_key = "abcdefgh1"', "eval (x)", "select a \\\\ b", "process.env.HOME std::env::var(x", "nothing"]
    pd.DataFrame({"doc_id": range(5), "text": texts, "lang": "en", "source": "s"}).to_parquet(tmp_path / "documents.parquet")
    want = [(f"m{i}", rule, severity, len(g), min(g)) for i, x in enumerate(texts) for rule, p, severity in m.SECURITY if (g := [f.group() for f in re.finditer(p, x)])]
    assert {r[1] for r in want} == {r[0] for r in m.SECURITY}
    assert sorted(run(spark, "pf10_security_findings", str(tmp_path))) == sorted(want)
