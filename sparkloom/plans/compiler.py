"""Contexts of requests: what is near the active file, what memory and rules add, and what the budget holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import query_boost, terms, token_estimate
from ..operators import context, events, graph, reports, textfilter
from ..operators.cut import cut_lineage


def sections(active: str, edges: DataFrame, symbols: DataFrame, memory: DataFrame, log: DataFrame, rule_files: DataFrame, scores: DataFrame, task: str = "unknown", query: str = "", depth: int = 2) -> DataFrame:
    """Candidate sections (ordinal, id, kind, priority, tokens, content) of a request.

    Files within depth steps of the active one give skeletons; one that three or more memory rows name is cut to
    its first lines. Skeletons are boosted by graph scores (node, betweenness, pagerank) and by the query's terms.
    History is compacted by project, rule files are pruned by task and query."""
    spark = edges.sparkSession
    near = graph.reach(edges, spark.createDataFrame([(active,)], "node string"), depth, undirected=True).select(F.col("node").alias("file"))
    text = reports.skeleton_text(symbols.join(near, "file", "left_semi"))
    named = reports.coverage(text.select("file", F.array().cast("array<string>").alias("exports")), memory).select("file", "hits")
    short = F.array_join(F.slice(F.split("text", "\n"), 1, 4), "\n")
    code = text.join(named, "file", "left").join(scores, F.col("file") == F.col("node"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    content = F.when(F.coalesce("hits", F.lit(0)) >= 3, short).otherwise(F.col("text"))
    base = context.base_priority(F.lit("code-skeleton"), F.col("file") == active)
    priority = context.boosted(base, zero("betweenness"), zero("pagerank")) + query_boost(query, content)
    code = code.select(F.concat(F.lit("code:"), "file").alias("id"), F.lit("code-skeleton").alias("kind"), priority.alias("priority"), content.alias("content"))
    history = events.compaction(log).select(
        F.concat(F.lit("history:"), "project").alias("id"), F.lit("history").alias("kind"), F.lit(70).alias("priority"), F.format_string("%d mutations of %d files; intents %s", "mutations", "files", "intents").alias("content")
    )
    rules = rule_files.select(F.concat(F.lit("rules:"), "file").alias("id"), F.lit("rules").alias("kind"), F.lit(55).alias("priority"), textfilter.pruned(F.col("text"), task, terms(query)).alias("content")).where("length(content) > 0")
    head = spark.createDataFrame([("active:file", "active-context", 100, f"Active file: {active}\nTask type: {task}")], "id string, kind string, priority int, content string")
    all_ = head.unionByName(code).unionByName(history).unionByName(rules)
    return all_.withColumns({"tokens": token_estimate(F.col("content")), "ordinal": F.xxhash64("id")})


def compile_context(candidates: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The sections that a budget holds at the greatest value, and one row of metrics."""
    own = candidates.withColumn("request", F.lit(1))
    chosen = own.join(context.knapsack(own, budget).select("ordinal"), "ordinal", "left_semi").drop("request")
    total = own.agg(F.count("*").alias("considered"), F.sum("tokens").alias("tokens_considered"))
    taken = chosen.agg(F.count("*").alias("selected"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return chosen, total.join(taken)


def sections_of_all(requests: DataFrame, edges: DataFrame, symbols: DataFrame, memory: DataFrame, log: DataFrame, rule_files: DataFrame, scores: DataFrame, task: str = "unknown", query: str = "", depth: int = 2) -> DataFrame:
    """sections() for many requests (request, active, project) in one plan, with request, file and covered. Skeletons, their
    coverage and boosts are made once a file and join the files near each request; history is that of the request's project."""
    near = graph.reach_many(edges, requests.select("request", F.col("active").alias("node")), depth, undirected=True).select("request", F.col("node").alias("file"))
    wanted = near.select("file").distinct()
    text = reports.skeleton_text(symbols.join(wanted, "file", "left_semi"))
    named = reports.coverage(text.select("file", F.array().cast("array<string>").alias("exports")), memory)
    short = F.array_join(F.slice(F.split("text", "\n"), 1, 4), "\n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    files = text.join(named, "file", "left").join(scores, F.col("file") == F.col("node"), "left")
    files = files.select("file", F.coalesce("covered", F.lit(False)).alias("covered"), F.when(F.col("covered"), short).otherwise(F.col("text")).alias("content"), zero("betweenness").alias("betweenness"), zero("pagerank").alias("pagerank"))
    code = near.join(files, "file").join(requests.select("request", "active"), "request")
    base = context.base_priority(F.lit("code-skeleton"), F.col("file") == F.col("active"))
    priority = context.boosted(base, F.col("betweenness"), F.col("pagerank")) + query_boost(query, F.col("content"))
    code = code.select("request", F.concat(F.lit("code:"), "file").alias("id"), F.lit("code-skeleton").alias("kind"), priority.alias("priority"), "content", "covered")
    shared = lambda kind, priority, content: [F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), content.alias("content"), F.lit(False).alias("covered")]
    past = events.compaction(log)
    history = requests.join(past, "project").select("request", F.concat(F.lit("history:"), "project").alias("id"), *shared("history", 70, F.format_string("%d mutations of %d files; intents %s", "mutations", "files", "intents")))
    rules = rule_files.select(F.concat(F.lit("rules:"), "file").alias("id"), textfilter.pruned(F.col("text"), task, terms(query)).alias("content")).where("length(content) > 0")
    rules = rules.agg(F.collect_list(F.struct("id", "content")).alias("all"))  # one row: a workspace's few rule files
    rules = requests.crossJoin(F.broadcast(rules)).select("request", F.explode("all").alias("x")).select("request", "x.id", *shared("rules", 55, F.col("x.content")))
    head = requests.select("request", F.lit("active:file").alias("id"), *shared("active-context", 100, F.concat(F.lit("Active file: "), "active", F.lit(f"\nTask type: {task}"))))
    all_ = head.unionByName(code).unionByName(history).unionByName(rules)
    return all_.withColumns({"tokens": token_estimate(F.col("content")), "ordinal": F.xxhash64("id")})


def compile_all(candidates: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The sections that the budget holds for each request, and by request a row of metrics."""
    own = cut_lineage(candidates)
    picked = cut_lineage(context.knapsack(own, budget).select("request", "ordinal"))
    chosen = own.join(picked, ["request", "ordinal"], "left_semi")
    kind = lambda k: F.count_if(F.col("kind") == k)
    total = own.groupBy("request").agg(F.count("*").alias("considered"), F.sum("tokens").cast("long").alias("tokens_considered"), kind("code-skeleton").alias("relevant_files"), F.count_if("covered").alias("deduplicated_files"))
    taken = chosen.groupBy("request").agg(
        F.count("*").alias("selected"), F.sum("tokens").cast("long").alias("tokens"), kind("history").alias("history_sections"), kind("rules").alias("rules_sections"), F.sum(F.col("priority") * 100 + 1).cast("long").alias("value")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    metrics = total.join(taken, "request", "left").select("request", "considered", "tokens_considered", "relevant_files", "deduplicated_files", *map(zero, ("selected", "tokens", "history_sections", "rules_sections", "value")))
    return chosen, metrics
