"""Scores and classes: intent, risk, command patterns, confidence feedback, pattern clusters."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intents by name; of equal votes the first wins.
INTENTS = ("api_design", "bug_fixing", "configuration", "refactoring", "scaffolding", "testing")
#: Words of a path that vote for an intent, and the vote.
PATH_VOTES = {
    "api_design": (0.30, ("/api/", "route.", "/routes/", "handler", "endpoint")),
    "testing": (0.35, ("/test", ".test.", ".spec.", "_test.", "/spec/")),
    "configuration": (0.30, ("config", ".env", "settings", "toml", "yaml", ".yml")),
    "scaffolding": (0.25, ("migration", "seed")),
}
#: Pattern tags that vote for an intent, and the vote.
TAG_VOTES = {"testing": (0.20, ("tests",)), "scaffolding": (0.15, ("repository", "service")), "api_design": (0.15, ("edge-guards", "adapter"))}


def intents(diffs: DataFrame) -> DataFrame:
    """(file, intent, confidence) of diffs (file, added, removed, modified, tags)."""
    path, a, r, m = F.lower("file"), F.col("added"), F.col("removed"), F.col("modified")
    total = a + r + m
    share = lambda c: c / F.greatest(total, F.lit(1))
    any_ = lambda words: reduce(lambda e, w: e | path.contains(w), words, F.lit(False))
    tagged = lambda words: reduce(lambda e, w: e | F.array_contains("tags", w), words, F.lit(False))
    votes: dict[str, list[tuple[float, Column]]] = {i: [] for i in INTENTS}
    for i, (v, words) in PATH_VOTES.items():
        votes[i].append((v, any_(words)))
    for i, (v, words) in TAG_VOTES.items():
        votes[i].append((v, tagged(words)))
    votes["scaffolding"] += [(0.35, (a > 0) & (r == 0) & (m == 0)), (0.25, (share(a) > 0.6) & (a >= 3))]
    votes["refactoring"] += [(0.35, (r > 0) & (m > 0) & (share(a) <= share(r))), (0.15, (r >= 3) & (a == 0))]
    votes["bug_fixing"] += [(0.35, (m > 0) & (share(m) > share(a)) & (share(m) > share(r))), (0.15, (total <= 2) & (m > 0) & (a == 0) & (r == 0))]
    sums = {i: F.round(sum((F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for v, c in vs), F.lit(0.0)), 6) for i, vs in votes.items()}
    best = F.greatest(*sums.values())
    name = reduce(lambda e, i: F.when(sums[i] == best, F.lit(i)).otherwise(e), reversed(INTENTS), F.lit(None))
    none = (total == 0) | (best == 0)
    return diffs.select("file", F.when(none, F.lit("exploration")).otherwise(name).alias("intent"), F.when(none, F.lit(0.25)).otherwise(F.least(F.greatest(best, F.lit(0.25)), F.lit(0.95))).alias("confidence"))


def proactive_risk(files: DataFrame) -> DataFrame:
    """(file, risk, advice) where risk is at least 0.35. files: file, dependents, breaks, issues, stable, hot."""
    part = lambda c, cap, w: F.least(F.col(c), F.lit(cap)) / cap * w
    flag = lambda c: F.when(F.col(c), F.lit(0.1)).otherwise(F.lit(0.0))
    risk = F.round(F.least(part("dependents", 25, 0.35) + part("breaks", 5, 0.30) + part("issues", 5, 0.20) + flag("stable") + flag("hot"), F.lit(1.0)), 6)
    advice = F.when(F.col("risk") >= 0.75, "checkpoint").when(F.col("risk") >= 0.55, "review dependents").otherwise("caution")
    return files.withColumn("risk", risk).where("risk >= 0.35").select("file", "risk", advice.alias("advice"))


def additive_risk(files: DataFrame) -> DataFrame:
    """(file, score, level, stability). files: file, dependents, breakage, changes, core, issues."""
    add = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    d = F.col("dependents")
    score = F.when(d > 20, 30).when(d > 10, 15).otherwise(0) + add(F.col("breakage"), 25) + add(F.col("changes") > 10, 15) + add(F.col("core"), 20) + add(F.col("issues") > 0, 10)
    level = F.when(F.col("score") <= 20, "low").when(F.col("score") <= 40, "medium").when(F.col("score") <= 70, "high").otherwise("critical")
    return files.withColumn("score", score).select("file", "score", level.alias("level"), F.greatest(100 - F.col("score"), F.lit(0)).alias("stability"))


def command_patterns(facts: DataFrame, least: int = 3, limit: int = 50) -> DataFrame:
    """Frequent (command, argument) pairs and their confidence. facts: command, arg."""
    pairs = facts.groupBy("command", "arg").agg(F.count("*").alias("frequency"))
    total = facts.groupBy("command").agg(F.count("*").alias("total"))
    confidence = F.round(0.6 * F.least(F.col("frequency") / F.col("total"), F.lit(1.0)) + 0.4 * F.least(F.col("frequency") / 100, F.lit(1.0)), 6)
    return pairs.where(F.col("frequency") >= least).join(total, "command").select("command", "arg", "frequency", confidence.alias("confidence")).orderBy(F.desc("confidence"), F.desc("frequency"), "command", "arg").limit(limit)


def filter_suggestions(patterns: DataFrame) -> DataFrame:
    """Patterns worth a filter of their own, with its definition."""
    return patterns.where("confidence >= 0.5 and frequency >= 5").select("command", F.format_string("^%s .*%s", F.col("command"), F.col("arg")).alias("definition"))


#: What feedback adds to a rule's confidence.
FEEDBACK = {"useful": 0.05, "dismissed": -0.02, "incorrect": -0.10}


def confidence_feedback(rows: DataFrame, start: float = 0.5) -> DataFrame:
    """(rule, confidence) after feedback in order, held to 0..1 at each step. rows: rule, seq, feedback."""
    step = F.coalesce(*[F.when(F.col("feedback") == k, F.lit(v)) for k, v in FEEDBACK.items()], F.lit(0.0))
    ordered = F.array_sort(F.collect_list(F.struct("seq", step.alias("d"))))
    fold = lambda s: F.aggregate(s, F.lit(start), lambda acc, x: F.round(F.least(F.greatest(acc + x["d"], F.lit(0.0)), F.lit(1.0)), 6))
    return rows.groupBy("rule").agg(ordered.alias("s")).select("rule", fold(F.col("s")).alias("confidence"))


def shape_clusters(functions: DataFrame, least: int = 3) -> DataFrame:
    """Clusters of functions by shape: letters of flags, bucket of parameters, first statements.
    functions: name, flags (array of letters, in order), params, prefix (array)."""
    n = functions.agg(F.count("*").alias("all"))
    bucket = F.when(F.col("params") >= 4, F.lit("p4+")).otherwise(F.concat(F.lit("p"), F.col("params")))
    signature = F.array_join(F.concat("flags", F.array(bucket), F.slice("prefix", 1, 3)), "|")
    g = functions.select(signature.alias("signature")).groupBy("signature").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    g = g.withColumn("complexity", F.size(F.split("signature", r"\|")) - 1).where("complexity >= 2").join(F.broadcast(n))
    raw = F.least(F.col("size") / F.col("all") * 0.3 + F.ln("size") / 10 * 0.4 + F.least(F.col("complexity"), F.lit(5)) / 5 * 0.3, F.lit(0.95))
    return g.select("signature", "size", F.round(raw, 2).alias("confidence"))


def constellations(items: DataFrame, least: int = 3, least_items: int = 2) -> DataFrame:
    """Files with the same set of items (imports, or verbs of exports). items: file, item."""
    sets = items.groupBy("file").agg(F.array_sort(F.collect_set("item")).alias("s")).where(F.size("s") >= least_items)
    return sets.groupBy(F.array_join("s", ",").alias("items")).agg(F.count("*").alias("files")).where(F.col("files") >= least)


def dominance(patterns: DataFrame) -> DataFrame:
    """Patterns by tier without repeated ids and without those that an accepted one of greater confidence covers
    (over 0.7 of their evidence). patterns: project, id, tier, confidence, evidence (array)."""
    rank = {"known": 0, "framework": 1, "emergent": 2}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=pdf["tier"].map(rank).fillna(3)).sort_values(["t", "id"], kind="stable")
        taken: set[str] = set()
        holders: dict = {}  # of each piece of evidence, the accepted that have it: none other can cover
        keep = []
        for i, c, ev in zip(pdf["id"], pdf["confidence"], pdf["evidence"]):
            own = set(ev)
            ok = i not in taken and not any(d > c and len(o & own) / len(own) > 0.7 for x in own for d, o in holders.get(x, ()))
            keep.append(ok)
            if ok:
                taken.add(i)
                for x in own:
                    holders.setdefault(x, []).append((c, own))
        return pdf[keep][["project", "id", "tier", "confidence"]]

    return patterns.groupBy("project").applyInPandas(fold, "project string, id string, tier string, confidence double")


def error_style(files: DataFrame) -> DataFrame:
    """One row: the dominant error style by shares of functions. files: tries, results, functions."""
    g = files.agg(F.sum("tries").alias("t"), F.sum("results").alias("r"), F.sum("functions").alias("n"))
    t, r = F.col("t") / F.col("n"), F.col("r") / F.col("n")
    return g.select(F.when((t > 0.30) & (t > r), "try-catch").when((r > 0.15) & (t > 0.10), "mixed").when(r > 0.15, "result").otherwise("none").alias("style"), F.round(t, 6).alias("try_share"), F.round(r, 6).alias("result_share"))
