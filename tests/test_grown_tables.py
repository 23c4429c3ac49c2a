"""Queries on tables with more rows or larger keys than the supplied ones have."""

from __future__ import annotations

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import scalars as fn

SF = "/root/testdata/sf0.001"


@pytest.fixture
def both(spark, tmp_path):
    """Runs a query and its SQL on the tables given, by name; others are the smallest supplied ones."""

    def run(name: str, **tables: pd.DataFrame) -> tuple[list, list]:
        c = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            path = tmp_path / f"{t}.parquet"
            if t in tables:
                tables[t].to_parquet(path)
            elif not path.exists():
                path.symlink_to(f"{SF}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
        got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
        want = c.execute(catalog.oracle_sql()[name]).fetchdf()[list(got.columns)]
        plain = lambda f: sorted((tuple(map(str, r)) for r in f.itertuples(index=False)))
        return plain(got), plain(want)

    return run


def _documents(keys) -> pd.DataFrame:
    rows = pd.read_parquet(f"{SF}/documents.parquet").head(1)
    return pd.concat([rows.assign(doc_id=k) for k in keys], ignore_index=True)


@pytest.mark.parametrize("name", ["jn8_relation_edges", "gr10_reasoning_chain"])
def test_relations_of_keys_beyond_a_hundred_thousand(both, name):
    got, want = both(name, documents=_documents([*range(30), *range(100_000, 100_030)]))
    assert got == want and len(want) > 5


def test_patterns_beyond_a_thousand_a_project(both):
    supplier = pd.DataFrame({"s_suppkey": range(1, 2501), "s_nationkey": [k % 2 for k in range(1, 2501)]})
    got, want = both("cl9_dominant_patterns", supplier=supplier)
    assert got == want and len(want) == 2


def test_formats_of_halves(both, spark):
    keys = [k * 500 + i for k in range(1, 4000) for i in (0, 1)]
    orders = pd.DataFrame({"o_orderkey": range(len(keys) + 4000), "o_totalprice": [*map(float, keys), *[k * 51.2 / 100 for k in range(4000)]]})
    got, want = both("sf15_formats", orders=orders)
    assert got == want
    given = [1.05, 1.15, 1.25, 1.35, 1.45, 9.95, 9.96, 2.0, 1e12 + 0.25, 1e12 + 0.75]
    shown = spark.createDataFrame([(x,) for x in given], "x double").select(fn.one_decimal(F.col("x"))).collect()
    assert [r[0] for r in shown] == [f"{x:.1f}" for x in given]


@pytest.mark.parametrize("name", ["ag21_file_map", "ag27_file_skeletons"])
def test_every_pair_of_files_with_one_name_is_an_edge(both, name):
    part = pd.read_parquet(f"{SF}/part.parquet").query("p_partkey % 10 != 0").head(60).assign(p_name="one name")
    got, want = both(name, part=part)
    assert got == want
    files = sorted(r[0] for r in got)
    if name == "ag21_file_map":
        outs = {r[0]: int(r[2]) for r in got}
        assert max(outs.values()) == len(files) - 1 > 5
    else:
        assert max(len(r[-2].split(",")) for r in got) == 20 < len(files)


def test_a_mirror_has_a_file_by_id_and_no_folders(spark, tmp_path):
    from sparkloom.sources import files

    rows = spark.createDataFrame([("a", "p", "x\ny"), ("pending", "p", "z"), (".b", "q", None), ("_c", "p", "é"), ("no/t", "p", "w"), (None, "p", "v")], "id string, project_id string, content string")
    for _ in range(2):  # a second mirror takes the first one's place
        files.export_mirror(rows, str(tmp_path / "m"))
    names = sorted(f.name for f in (tmp_path / "m").iterdir() if not f.name.endswith(".crc"))
    assert names == ["row-.b.json", "row-_c.json", "row-a.json", "row-pending.json"]
    assert sorted((r["id"], r["content"]) for r in files.import_mirror(spark, str(tmp_path / "m"), "p").collect()) == [("_c", "é"), ("a", "x\ny"), ("pending", "z")]


def test_a_mirror_is_listed_by_a_task(spark, tmp_path):
    """No plan of the driver has a mirror's files; rows are those of Spark's own reader, also of odd files."""
    from sparkloom.sources import files

    row = lambda i, text="é\n": json.dumps({"id": i, "project_id": "p", "content": text, "tags": ["t"]}, ensure_ascii=False)
    odd = {"a": row("a"), "b": row("b", "x" * 100_000), "list": f"[{row('c')}, {row('d')}]", "empty": "", "blank": " \n", "bad": "{", "number": "1", "lines": json.dumps(json.loads(row("e")), indent=2), "wrong": '{"id": "w", "project_id": "p", "tags": 1}',
           "_hidden": row("h"), ".dot": row("i"), "pending-1": row("j"), "acks": row("k"), "_x=1": row("l"), "two": row("m") + "\n" + row("n"), "other": row("o").replace('"p"', '"q"')}
    for name, text in odd.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    (tmp_path / "wide.json").write_bytes(row("u").encode("utf-16-le"))
    (tmp_path / "mark.json").write_bytes(row("v").encode("utf-8-sig"))
    (tmp_path / "broken.json").write_bytes(row("y").encode("latin-1"))
    (tmp_path / "text.txt").write_text(row("z"))
    (tmp_path / "folder.json").mkdir()
    got = files.import_mirror(spark, str(tmp_path), "p")
    assert got.inputFiles() == []
    (tmp_path / "folder.json").rmdir()
    df = spark.read.schema(files.MEMORY + ", _corrupt_record string").option("multiLine", True).json(str(tmp_path), pathGlobFilter="*.json")
    df = df.where("not _metadata.file_name rlike '^(pending|ack)' and _corrupt_record is null and id is not null and project_id = 'p'")
    rows = lambda x: sorted((r["id"], r["content"], r["tags"]) for r in x.collect())
    assert rows(got) == rows(df) and len(rows(df)) >= 6


@pytest.mark.parametrize("name", ["sy3_observed_remove_dots", "sy3_observed_remove_sets"])
def test_replicas_read_no_window_from_each_row_to_its_end(both, spark, tmp_path, name):
    events = pd.read_parquet(f"{SF}/events.parquet").assign(user_id=lambda e: e.user_id % 2)
    got, want = both(name, events=events)
    assert got == want and len(want) > 1
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, 1, unboundedfollowing" not in plan
