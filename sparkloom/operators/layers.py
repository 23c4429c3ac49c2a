"""Values of several layers as one: JSON documents merged level by level, and contexts with merge, override and extend.

A merge works on rows (id, path, order, JSON text). All nodes at one path meet; what a later layer covers goes there with all that is
under it, arrays become ordered unions, and the members of the objects that are left are the next level's rows. So a level is one
grouping by (id, path), a group holds a node of each layer at most, and no document is folded in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut_lineage

NODE = "struct<ord: long, kind: string, text: string>"


def parse_or_text(content: Column) -> Column:
    """JSON text in one form (members in order of their names); what is no JSON becomes a JSON string."""
    quoted = F.to_json(F.array(content))
    return F.coalesce(F.to_json(F.try_parse_json(content)), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _kind(text: Column) -> Column:
    return F.when(text.startswith("{"), "object").when(text.startswith("["), "array").otherwise("scalar")


def _items(text: Column) -> Column:
    return F.transform(F.try_parse_json(text).cast("array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def _union(nodes: Column) -> Column:
    """The first array's items, then of the others those that are new, each once."""
    first = _items(F.get(nodes, F.lit(0))["text"])
    rest = F.flatten(F.transform(F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))), lambda n: _items(n["text"])))
    return F.concat(F.lit("["), F.array_join(F.concat(first, F.array_except(F.array_distinct(rest), first)), ","), F.lit("]"))


def merge_documents(layers: DataFrame) -> DataFrame:
    """(id, path, value) of the merged JSON content of layers (id, ordinal, content): the greatest ordinal lies beneath. Objects merge
    by member, arrays are ordered unions, anything else is the upper layer's. path is the names on the way with / between
    (~1 for / and ~0 for ~ in names); value is JSON text of a scalar, an array or an empty object. Null content is no layer."""
    rows = layers.where("content is not null").select("id", F.lit("").alias("path"), (-F.col("ordinal")).cast("long").alias("ord"), parse_or_text(F.col("content")).alias("text"))
    out = None
    while True:
        nodes = rows.select("id", "path", F.struct("ord", _kind(F.col("text")).alias("kind"), "text").alias("n")).groupBy("id", "path").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
        last = F.element_at("nodes", -1)
        barrier = F.array_max(F.transform(F.filter("nodes", lambda n: n["kind"] != last["kind"]), lambda n: n["ord"]))
        left = nodes.select("id", "path", last["kind"].alias("kind"), last["text"].alias("text"), F.filter("nodes", lambda n: (n["kind"] == last["kind"]) & (barrier.isNull() | (n["ord"] > barrier))).alias("left"))
        left = cut_lineage(left.withColumn("bare", F.forall("left", lambda n: n["text"] == "{}")))
        value = F.when(F.col("kind") == "array", _union(F.col("left"))).otherwise(F.col("text"))
        done = left.where("kind <> 'object' or bare").select("id", "path", value.alias("value"))
        out = done if out is None else out.unionByName(done)
        members = left.where("kind = 'object' and not bare").select("id", "path", F.explode("left").alias("n"))
        each = members.select("id", "path", "n.ord", F.explode(F.try_parse_json("n.text").cast("map<string, variant>")).alias("name", "value"))
        name = F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        path = F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("/"), name))
        rows = cut_lineage(each.select("id", path.alias("path"), "ord", F.coalesce(F.to_json("value"), F.lit("null")).alias("text")))
        if rows.isEmpty():
            return out


LISTS = ("patterns", "decisions", "rules", "issues")


def resolve_contexts(layers: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (path) the context of the layers whose path begins it, by falling priority, then name: merge adds (patterns and
    decisions once, repeats counted as conflicts), override takes all before away, extend puts its own in front; files of later layers
    win. layers: name, priority, path, mode, the LISTS, file_map. Requests that no layer fits have no row."""
    begins = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left("path", n))
    asked = requests.select("path").distinct().select(F.col("path").alias("request"), F.explode(begins).alias("path"))
    used = asked.join(layers, "path")
    order = Window.partitionBy("request").orderBy(F.desc("priority"), "name")
    used = used.select("request", F.row_number().over(order).alias("r"), F.sum((F.col("mode") == "override").cast("int")).over(order).alias("epoch"), "name", "mode", *LISTS, "file_map")
    rows = F.sort_array(F.collect_list(F.struct("r", "name", "mode", *LISTS, F.map_entries("file_map").alias("files"))))
    parts = used.groupBy("request", "epoch").agg(rows.alias("rows"))
    of = lambda mode, f: F.flatten(F.transform(F.filter("rows", lambda x: x["mode"] == mode), lambda x: x[f]))
    ahead = lambda f: F.flatten(F.transform(F.reverse(F.filter("rows", lambda x: x["mode"] == "extend")), lambda x: x[f]))
    new = lambda f: F.array_except(F.array_distinct(of("merge", f)), of("override", f))
    final = {f: F.concat(ahead(f), of("override", f), new(f) if f in LISTS[:2] else of("merge", f)) for f in LISTS}
    conflicts = F.size(of("merge", "patterns")) - F.size(new("patterns")) + F.size(of("merge", "decisions")) - F.size(new("decisions"))
    pairs = F.flatten(F.transform("rows", lambda x: x["files"]))
    # Of equal keys the last pair stays.
    files = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    each = parts.select("request", "epoch", F.transform("rows", lambda x: x["name"]).alias("names"), conflicts.alias("conflicts"), *[c.alias(f) for f, c in final.items()], F.map_from_entries(files).alias("file_map"))
    all_ = each.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("epoch", "names"))).alias("n"), F.sum("conflicts").alias("conflicts"), F.max_by(F.struct(*LISTS, "file_map"), "epoch").alias("last"))
    return all_.select(F.col("request").alias("path"), *[F.col(f"last.{f}").alias(f) for f in (*LISTS, "file_map")], F.flatten(F.transform("n", lambda x: x["names"])).alias("layers"), F.col("conflicts").cast("long").alias("conflicts"))
