"""Bindings that ask for one name of one module ask once, however many files have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import resolve as m

FILES = [(f"src/a/u{i}.ts", "".join(f"import {{ f as x{k} }} from '../lib/m{k}';\n" for k in range(20))) for i in range(300)] + [(f"src/lib/m{k}.ts", "export function f() {}\n") for k in range(20)]


def shuffled_rows(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    lists = lambda: spark._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, sc._gateway.new_array(spark._jvm.double, 0), lists())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bindings_are_not_shuffled_again_and_again(spark):
    files = spark.createDataFrame(FILES, "file string, text string").coalesce(2)
    before = shuffled_rows(spark)
    got = m.resolved_bindings(files).collect()
    assert len(got) == 6000 and {(r["imported"], r["origin_file"], r["origin_name"]) for r in got} == {("f", f"src/lib/m{k}.ts", "f") for k in range(20)}
    assert shuffled_rows(spark) - before < 9000


def test_texts_are_parsed_once(spark):
    """Counted where a text is made: what imports and what exports ask of it comes from one pass."""
    made = spark.sparkContext.accumulator(0)

    def text(x):
        made.add(1)
        return x

    files = spark.createDataFrame(FILES, "file string, text string").coalesce(2)
    got = m.resolved_bindings(files.select("file", F.udf(text, "string")("text").alias("text"))).collect()
    assert len(got) == 6000 and made.value == len(FILES)


def test_a_round_is_one_table(spark):
    """A chain of eight modules that pass a name on: a round writes one table and asks once whether anything is open."""
    given = [(f"m{k}", "f", "f", f"m{k + 1}" if k < 8 else None) for k in range(9)] + [("c0", "g", "g", "c1"), ("c1", "g", "g", "c0")]
    given = spark.createDataFrame(given, "file string, name string, local string, module string")
    asked = spark.createDataFrame([("m0", "f"), ("c0", "g"), ("m0", "none")], "module string, name string")
    tables = []
    cut = m.cut_lineage
    m.cut_lineage = lambda df: tables.append(1) or cut(df)
    try:
        got = m.origins(asked, given).collect()
    finally:
        m.cut_lineage = cut
    assert [tuple(r) for r in got] == [("m0", "f", "m8", "f", 8)]
    assert len(tables) <= 2 + 9


def test_specifiers_without_inner_dots_lead_where_others_do(spark):
    folders = ("", "a", "a/b", "/a/b", "./a", "a/../b", "a/.b", "a//b", "a/b/c d")
    specifiers = ("./x", "../x", "../../x/y", "./../x", "../../../x", "../../../../x", "././x", "../.x", "../x/../y", ".", "..", "./", "../", "/x", "x", "../x/", ".../x", "..x", "./x\r", "../x//y", "../" * 20_000 + "x", "./" + "x/" * 20_000 + "y")
    rows = [(f"{f}/u.ts" if f else "u.ts", s) for f in folders for s in specifiers]

    def led(path):
        out = []
        for part in path.split("/"):
            if part == ".." and not out:
                return ""
            out = out[:-1] if part == ".." else out if part in ("", ".") else [*out, part]
        return "/" + "/".join(out)

    def keys(file, s):
        near = s in (".", "..") or s.startswith(("./", "../"))
        root = led(s) if near or s.startswith("/") else ""
        return (led(file.rpartition("/")[0] + "/" + s), root) if near else (root, "")

    for r in m._with_keys(spark.createDataFrame(rows, "file string, specifier string")).collect():
        key, key2 = keys(r["file"], r["specifier"])
        assert r["key"] == (key or key2) and (not key or r["key2"] == key2), tuple(r)
