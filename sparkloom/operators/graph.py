"""Directed graphs as edge tables (src, dst): ranks, reachability, components, orders.

Loops run on the driver over DataFrames; each round's frontier is written to the shared folder, so lineage stays
short and a lost executor costs a read. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut_lineage


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame, dense_at: int = 5) -> DataFrame:
    """Fan-in, fan-out and whether fan-in makes the node dense."""
    e = simple(edges)
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ins.join(outs, "node", "full_outer").select("node", zero("fan_in"), zero("fan_out")).withColumn("dense", F.col("fan_in") >= dense_at)


def mutual_pairs(edges: DataFrame, limit: int | None = 5) -> DataFrame:
    e = simple(edges)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = e.join(back, ["src", "dst"]).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().orderBy("a", "b")
    return out.limit(limit) if limit else out


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Ranks after a fixed number of rounds; what nodes without out-edges hold is dropped; divided by the largest."""
    e = cut_lineage(simple(edges))
    all_nodes = cut_lineage(nodes(e))
    n = all_nodes.count()
    if not n:
        return all_nodes.withColumn("pagerank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count("*").alias("d"))
    links = cut_lineage(e.join(out, "src").select("src", "dst", (1.0 / F.col("d")).alias("w")))
    rank = all_nodes.withColumn("r", F.lit(1.0 / n))
    for i in range(rounds):
        got = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("r") * F.col("w")).alias("g"))
        rank = all_nodes.join(got, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) / n + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
        if i % 4 == 3 and i + 1 < rounds:
            rank = cut_lineage(rank)
    rank = cut_lineage(rank)
    top = rank.agg(F.max("r").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("node", F.round(F.col("r") / F.col("top"), 6).alias("pagerank"))  # top is one row


#: Rows that a level of betweenness may have: sources are taken in batches of so many by the number of edges.
LEVEL_ROWS = 50_000_000


def _dependencies(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): Brandes' dependencies of a batch of sources (node), level by level for all of them at once. Path counts go
    forward over joins on the node, dependencies back over the same edges; every row carries its source."""
    level = cut_lineage(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "v")
    while True:
        step = level.join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("w")).agg(F.sum("paths").alias("paths")).withColumnRenamed("w", "v")
        level = cut_lineage(step.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    below = levels[-1].withColumn("delta", F.lit(0.0))
    total = below
    for level in reversed(levels[:-1]):
        share = below.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        got = share.join(e, F.col("w") == F.col("dst")).groupBy("s", F.col("src").alias("v")).agg(F.sum("share").alias("share"))
        below = cut_lineage(level.join(got, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta")))
        total = total.unionByName(below)
    return total.where("s <> v").groupBy(F.col("v").alias("node")).agg(F.sum("delta").alias("b"))


def betweenness(edges: DataFrame, level_rows: int = LEVEL_ROWS) -> DataFrame:
    """Brandes over unweighted directed paths, divided by the largest. Sources go in batches, so that what a level holds is
    bounded; a batch's sums are written before the next, and nothing but counts comes to the driver."""
    e = cut_lineage(simple(edges))
    all_nodes = cut_lineage(nodes(e))
    batches = max(1, -(-all_nodes.count() * e.count() // level_rows))
    found = None
    for i in range(batches):
        sources = all_nodes.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == i)
        part = cut_lineage(_dependencies(e, sources))
        found = part if found is None else found.unionByName(part)
    sums = cut_lineage(found.groupBy("node").agg(F.sum("b").alias("b")))
    top = sums.agg(F.max("b").alias("top"))
    return all_nodes.join(sums, "node", "left").crossJoin(F.broadcast(top)).select("node", F.round(F.coalesce(F.try_divide("b", "top"), F.lit(0.0)), 6).alias("betweenness"))  # top is one row


def importance(edges: DataFrame, a: float = 0.6, b: float = 0.4) -> DataFrame:
    """Betweenness and page rank combined."""
    return betweenness(edges).join(pagerank(edges), "node").withColumn("score", F.round(a * F.col("betweenness") + b * F.col("pagerank"), 6))


def reach(edges: DataFrame, start: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """Breadth-first search from start (node): node, depth and via (the least name it was found from)."""
    e = simple(edges)
    if undirected:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = cut_lineage(e)
    kind = start.schema["node"].dataType
    seen = cut_lineage(start.select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("via")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        new = cut_lineage(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"), "via"))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def blast_radius(edges: DataFrame, target: str, depth: int = 5) -> DataFrame:
    """What depends on a node, directly or not: over reversed edges, without the node itself."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = edges.sparkSession.createDataFrame([(target,)], "node string")
    return reach(back, start, depth).where("depth > 0")


def reach_many(edges: DataFrame, starts: DataFrame, depth: int, undirected: bool = False) -> DataFrame:
    """reach() for many requests at once: (request, node, depth, via, path) from starts (request, node). A row of the frontier
    carries its request and the nodes on its way, so all searches go one step a round and no path is looked up later."""
    e = simple(edges)
    if undirected:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = cut_lineage(e)
    kind = starts.schema["node"].dataType
    seen = cut_lineage(starts.select("request", "node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("via"), F.array("node").alias("path")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        ways = frontier.select("request", F.col("node").alias("src"), "path").join(e, "src").groupBy("request", F.col("dst").alias("node")).agg(F.min(F.struct("src", "path")).alias("w"))
        step = ways.select("request", "node", F.lit(d).alias("depth"), F.col("w.src").alias("via"), F.concat(F.col("w.path"), F.array("node")).alias("path"))
        new = cut_lineage(step.join(seen, ["request", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def blast_radii(edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """What depends on each target (node), directly or not, with the way from the target."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach_many(back, targets.select(F.col("node").alias("request"), "node"), depth).where("depth > 0")


def critical_paths(blast: DataFrame) -> DataFrame:
    """Per request the path to a deepest node, the last name of equals."""
    return blast.groupBy("request").agg(F.max_by("path", F.struct("depth", "node")).alias("path"), F.max("depth").cast("long").alias("depth"))


def impact(edges: DataFrame, target: str, depth: int = 5) -> DataFrame:
    """One row: affected, risk, urgency by depth and severity by count."""
    b = blast_radius(edges, target, depth)
    n, deep = F.count("*"), F.max("depth")
    return b.agg(n.alias("affected"), F.coalesce(F.round(F.least(n / 10, F.lit(1.0)), 6), F.lit(0.0)).alias("risk"), F.count_if(F.col("depth") == 1).alias("direct"), F.coalesce(deep, F.lit(0)).cast("long").alias("depth"),
                 F.when(n > 5, "high").when(n > 0, "medium").otherwise("low").alias("severity"))


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kahn's rounds: (node, level) of nodes that no cycle feeds, where level is the longest path to the node;
    and the edges among the rest, none if there is no cycle."""
    e = cut_lineage(simple(edges))
    left, done, level = cut_lineage(nodes(e)), None, 0
    while True:
        ready = cut_lineage(left.join(e.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        left = cut_lineage(left.join(ready, "node", "left_anti"))
        e = cut_lineage(e.join(ready.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
        level += 1
    empty = nodes(edges).limit(0).withColumn("level", F.lit(0))
    return (done if done is not None else empty), e


def topological_order(edges: DataFrame) -> DataFrame:
    """node and level, by which an order is (level, node); empty if there is a cycle."""
    done, rest = levels(edges)
    return done if rest.isEmpty() else done.limit(0)


def max_depth(edges: DataFrame) -> DataFrame:
    """One row: edges on the longest path of the acyclic part."""
    done, _ = levels(edges)
    return done.agg(F.coalesce(F.max("level"), F.lit(0)).cast("long").alias("depth"))


def condensed(edges: DataFrame) -> DataFrame:
    """Edges between strong components, each named by its least member; a node of none is its own."""
    own = cut_lineage(strong_components(edges))
    name = lambda side: F.coalesce(F.col(f"_{side}"), F.col(side)).alias(side)
    of = lambda side: own.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    e = simple(edges).join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(name("src"), name("dst"))
    return e.where("src <> dst").distinct()


def condensed_depth(edges: DataFrame) -> DataFrame:
    """One row: edges on the longest path of the condensation, so that what stands behind a cycle counts too."""
    return longest_path(cut_lineage(condensed(cut_lineage(simple(edges)))))


def _removable(e: DataFrame, turn: int) -> DataFrame:
    """(node, pred, succ, w_in, w_out, end) of nodes of e (src, dst, w; no loops) that a round takes out: ends, which have no edges in or none
    out, and of nodes inside chains (one edge in, one out) those whose hash is less than their neighbours', so that no two inner ones
    are neighbours, nor beside one of the ends. A round takes about a third of a chain, not one node."""
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.max("src").alias("pred"), F.max("w").alias("w_in"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.max("dst").alias("succ"), F.max("w").alias("w_out"))
    n = cut_lineage(ins.join(outs, "node", "full_outer").select("node", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o"), "pred", "succ", "w_in", "w_out"))
    ends = n.where("i = 0 or o = 0").select("node", "pred", "succ", "w_in", "w_out", F.lit(True).alias("end"))
    order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), c)
    inner = n.where("i = 1 and o = 1")
    # What may not be beside a node that is taken: an end, or an inner node that comes before it.
    near = n.where("i = 0 or o = 0 or (i = 1 and o = 1)").select(F.col("node").alias("near"), F.when((F.col("i") > 0) & (F.col("o") > 0), order(F.col("node"))).alias("at"))
    beside = lambda side: (F.col("near") == F.col(side)) & (F.col("at").isNull() | (F.col("at") < order(F.col("node"))))
    own = inner.join(near, beside("pred"), "left_anti").join(near, beside("succ"), "left_anti").select("node", "pred", "succ", "w_in", "w_out", F.lit(False).alias("end"))
    return cut_lineage(ends.unionByName(own))


def _without(e: DataFrame, out: DataFrame) -> DataFrame:
    """Edges (src, dst, w) after a round: chains go on past the nodes that were taken out of them."""
    gone = lambda side: out.select(F.col("node").alias(side))
    left = e.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst", "w")
    past = out.where("not end").select(F.col("pred").alias("src"), F.col("succ").alias("dst"), (F.col("w_in") + F.col("w_out")).alias("w"))
    return cut_lineage(left.union(past).groupBy("src", "dst").agg(F.max("w").alias("w")))


def longest_path(edges: DataFrame) -> DataFrame:
    """One row (depth): edges on the longest path of a graph without cycles. Rounds take out sources, sinks and parts of chains,
    and keep at the nodes beside them how long a way leads to there (a) and on from there (b); chains and trees of n nodes need some log n
    rounds, other graphs at most half their depth."""
    e = cut_lineage(simple(edges).where("src <> dst").withColumn("w", F.lit(1).cast("long")))
    kind = e.schema["src"].dataType.simpleString()
    spark, none = edges.sparkSession, F.lit(0).cast("long")
    at = spark.createDataFrame([], f"node {kind}, a long, b long")
    best, turn = 0, 0
    while not e.isEmpty():
        out = _removable(e, turn)
        if out.isEmpty():
            raise ValueError("the graph has a cycle")
        # Values at a taken node go over its edges to its neighbours; whatever an edge or a node joins is a path.
        known = lambda side, c: at.select(F.col("node").alias(side), F.col(c))  # noqa: E731, B023
        taken = lambda side: out.select(F.col("node").alias(side), F.lit(True).alias(f"out_{side}"))  # noqa: E731, B023
        each = e.join(taken("src"), "src", "left").join(taken("dst"), "dst", "left").where("out_src or out_dst").join(known("src", "a"), "src", "left").join(known("dst", "b"), "dst", "left")
        each = cut_lineage(each.select("src", "dst", "out_src", "out_dst", (F.coalesce("a", none) + F.col("w")).alias("a"), (F.coalesce("b", none) + F.col("w")).alias("b"), (F.coalesce("a", none) + F.col("w") + F.coalesce("b", none)).alias("through")))
        on = each.where("out_src").select(F.col("dst").alias("node"), "a", none.alias("b")).union(each.where("out_dst").select(F.col("src").alias("node"), none.alias("a"), "b"))
        at = cut_lineage(at.union(on).groupBy("node").agg(F.max("a").alias("a"), F.max("b").alias("b")))
        best = max(best, each.agg(F.max("through")).first()[0] or 0, at.agg(F.max(F.col("a") + F.col("b"))).first()[0] or 0)
        e = _without(e, out)
        turn += 1
    return spark.range(1).select(F.lit(best).cast("long").alias("depth"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (the least member) of components of more than one node. What lies on no cycle and nodes inside chains are taken
    out by rounds first; the rest is colored: the least name that reaches a node is carried forward to a fixpoint, then members
    are what reaches the color's root back within the color. A node inside a chain is in its neighbours' component if they share one."""
    e = cut_lineage(simple(edges).where("src <> dst").withColumn("w", F.lit(1).cast("long")))
    rounds = []
    while not e.isEmpty():
        out = _removable(e, len(rounds))
        if out.isEmpty():
            break
        left = _without(e, out)
        rounds.append((out.where("not end").select("node", "pred", "succ"), left.where("src = dst").select(F.col("src").alias("node"))))
        e = left.where("src <> dst")
    found = _colored(cut_lineage(e.select("src", "dst")))
    for chain, loops in reversed(rounds):
        # A loop that a chain leaves behind makes its node a component, unless that is in one already.
        found = cut_lineage(found.union(loops.join(found, "node", "left_anti").withColumn("color", F.col("node"))))
        of = lambda side: found.select(F.col("node").alias(side), F.col("color").alias(f"_{side}"))  # noqa: E731, B023
        inside = chain.join(of("pred"), "pred").join(of("succ"), "succ").where("_pred = _succ").select("node", F.col("_pred").alias("color"))
        found = found.union(inside)
    found = cut_lineage(found)
    big = found.groupBy("color").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return found.join(big, "color").select("node", "component")


def _colored(e: DataFrame) -> DataFrame:
    """(node, color) of all nodes of edges by strong component."""
    found = nodes(e).limit(0).withColumn("color", F.col("node"))
    while not e.isEmpty():
        color = cut_lineage(nodes(e).withColumn("color", F.col("node")))
        while True:
            step = e.join(color, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("color").alias("c"))
            new = cut_lineage(color.join(step, F.col("node") == F.col("dst"), "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color")))
            changed = not new.exceptAll(color).isEmpty()
            color = new
            if not changed:
                break
        inside = e.join(color.toDF("src", "cs"), "src").join(color.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("color"))
        inside = cut_lineage(inside)
        seen = cut_lineage(color.where("node = color").select("node", "color"))
        frontier = seen
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            new = cut_lineage(back.join(seen, ["node", "color"], "left_anti"))
            if new.isEmpty():
                break
            seen, frontier = cut_lineage(seen.union(new)), new
        found = found.union(seen)
        keep = lambda side: seen.select(F.col("node").alias(side))  # noqa: E731, B023
        e = cut_lineage(e.join(keep("src"), "src", "left_anti").join(keep("dst"), "dst", "left_anti").select("src", "dst"))
    return found


def replace_source(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges in which new ones take the place of all with their sources."""
    return edges.join(new.select("src").distinct(), "src", "left_anti").select("src", "dst").union(new.select("src", "dst")).distinct()


def remove_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") != node) & (F.col("dst") != node))
