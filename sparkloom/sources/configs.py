"""Settings that lie in workspaces' files: rule files by order of candidates, agents of markdown files; exports of summaries.

files: workspace, path (relative), text. All workspaces are read in one plan; what a file can't give is left out, and a
workspace without a usable file has the built-in rules.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cooldown_ms
from ..operators.memory import SECURITY

RULES = "workspace string, rank int, ordinal int, id string, pattern string, severity string"


def _parsed(ranked: DataFrame, table: str) -> DataFrame:
    """A row for each rule of each file (workspace, rank, text). A file that does not parse, or whose rules lack an id or a
    pattern, gives no row at all; a severity that is not given is a warning."""

    def rules(text: str) -> list[tuple[str, str, str]]:
        try:
            return [(r["id"], r["pattern"], r.get("severity", "warning")) for r in tomllib.loads(text).get(table, [])]
        except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
            return []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(w, k, i, *map(str, r)) for w, k, text in pdf.itertuples(index=False) for i, r in enumerate(rules(text))]
            yield pd.DataFrame(rows, columns=["workspace", "rank", "ordinal", "id", "pattern", "severity"])

    return ranked.select("workspace", "rank", "text").mapInPandas(run, RULES)


def security_rules(files: DataFrame, candidates: Sequence[str], builtin: Sequence[tuple[str, str, str]] = SECURITY, append: bool = False, table: str = "rules") -> DataFrame:
    """(workspace, source, ordinal, id, pattern, severity): each workspace's rules, from the first candidate path that is
    there, parses and has a rule; else the built-in ones (source "builtin"). With append, these also follow a file's own.
    Of rows with one workspace and path, that with the smallest text counts. Workspaces are those that have any file."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("path")).cast("int")
    some = files.where("workspace is not null")
    texts = some.select("workspace", rank.alias("rank"), "text").where("rank > 0 and text is not null").groupBy("workspace", "rank").agg(F.min("text").alias("text"))
    own = _parsed(texts, table).withColumn("first", F.min("rank").over(Window.partitionBy("workspace"))).where("rank = first")
    source = F.element_at(F.array(*[F.lit(c) for c in candidates]), F.col("rank"))
    own = own.select("workspace", source.alias("source"), F.col("ordinal").cast("long").alias("ordinal"), "id", "pattern", "severity")
    count = own.groupBy("workspace").agg(F.count("*").alias("n"))
    rest = some.select("workspace").distinct().join(count, "workspace", "left")
    if not append:
        rest = rest.where("n is null")
    made = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("id"), F.lit(p).alias("pattern"), F.lit(s).alias("severity")) for i, (a, p, s) in enumerate(builtin)])
    rest = rest.select("workspace", F.lit("builtin").alias("source"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.explode(made).alias("x"))
    return own.unionByName(rest.select("workspace", "source", (F.col("n") + F.col("x.i")).alias("ordinal"), "x.id", "x.pattern", "x.severity"))


#: A line "key: value", or "key: |" and the indented lines behind it.
FIELD = r"\n([^:\n]*):[ \t]*(?:\|[ \t]*(?=\n|\z)((?s:.*?))(?=\n[^ \t]|\n?\z)|([^\n]*))"
BLOCK = r"(?s)\n[ \t]*```yaml[ \t]*(?=\n)(.*?)(?=\n[ \t]*```[ \t]*(?:\n|\z)|\z)"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t"))


def agents(files: DataFrame) -> DataFrame:
    """(workspace, path, ordinal, name, trigger, scope, action, output, cooldown_ms): the agents of markdown files.

    An agent is a section "## Agent: name" with a fenced yaml block that has a line; of equal keys the last one holds. An
    empty text has no agents. A default: trigger manual, scope workspace, no action, output brain:{project}:<name in lower
    case>, no cooldown. Column expressions only; lengths of sections and blocks don't matter."""
    sections = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n")), r"\n[ \t]*## Agent:")
    cut = files.where("text is not null").select("workspace", "path", F.posexplode(sections).alias("p", "s")).where("p > 0")
    body = cut.withColumns({"name": _trim(F.regexp_extract("s", r"^([^\n]*)", 1)), "block": F.regexp_extract("s", BLOCK, 1)}).where("block <> ''")
    whole = lambda g: F.regexp_extract_all("block", F.lit(FIELD), F.lit(g))
    lines = lambda c: F.array_join(F.transform(F.split(F.substring(c, 2, 2**31 - 1), "\n"), _trim), "\n")
    body = body.withColumn("fields", F.arrays_zip(whole(1).alias("k"), whole(2).alias("b"), whole(3).alias("v")))
    fields = F.transform("fields", lambda x: F.struct(_trim(x["k"]).alias("k"), F.when(x["b"] != "", lines(x["b"])).otherwise(_trim(x["v"])).alias("v")))

    def last(key: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter("f", lambda x: x["k"] == key), F.lit(-1))["v"], default)

    return body.withColumn("f", fields).select(
        "workspace", "path", F.col("p").cast("long").alias("ordinal"), "name", last("trigger", F.lit("manual")).alias("trigger"), last("scope", F.lit("workspace")).alias("scope"), last("action", F.lit("")).alias("action"),
        last("output", F.concat(F.lit("brain:{project}:"), F.lower("name"))).alias("output"), cooldown_ms(last("cooldown", F.lit("0ms"))).alias("cooldown_ms"),
    )


def telemetry(summaries: DataFrame, key: str, attributes: dict[str, Column], events: dict[str, tuple[str, Column]], prefix: str = "project") -> DataFrame:
    """(key, document): one JSON document for each summary, of resource attributes (name, value) and of events whose
    attributes number the values of an array from 1. A null value is an empty string, a null array has no values."""
    pair = lambda k, v: F.struct(k.alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value"))
    resource = F.array(*[pair(F.lit(f"{prefix}.{k}"), c) for k, c in attributes.items()])
    values = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    numbered = lambda word, c: F.transform(values(c), lambda x, i: pair(F.concat(F.lit(word + "."), i + 1), x))
    happened = F.array(*[F.struct(F.lit(f"{prefix}.{name}").alias("name"), numbered(word, c).alias("attributes")) for name, (word, c) in events.items()])
    return summaries.select(key, F.to_json(F.struct(resource.alias("resource_attributes"), happened.alias("events"))).alias("document"))
