"""Aggregates over fact tables: tokens, commands, filters, models, profiles, churn and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b rounded to 6 places, or another value where b is 0."""
    return F.round(F.when(b != 0, a / b).otherwise(F.lit(otherwise)), 6)


def token_stats(facts: DataFrame) -> DataFrame:
    """By project: sums, hit rate, days (at least one) and tokens a day."""
    g = facts.groupBy("project").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("total").alias("total"), F.round(F.sum("cost"), 2).alias("cost"),
        F.count_if("cached").alias("hits"), F.count("*").alias("requests"), F.min("sec").alias("first"), F.max("sec").alias("last"),
    )
    days = F.greatest(F.floor((F.col("last") - F.col("first")) / 86400).cast("long"), F.lit(1))
    return g.withColumns({"hit_rate": ratio(F.col("hits"), F.col("requests")), "per_day": ratio(F.col("total"), days)})


def command_stats(facts: DataFrame, recent: int) -> DataFrame:
    """By command over the recent rows: outcomes, mean sizes, saved and its share."""
    rows = facts.orderBy(F.desc("sec"), F.desc("n")).limit(recent)
    g = rows.groupBy("command").agg(
        F.count("*").alias("executions"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("raw").alias("raw"), F.sum("filtered").alias("filtered"),
        F.min("sec").alias("first"), F.max("sec").alias("last"),
    )
    saved = F.col("raw") - F.col("filtered")
    return g.withColumns({
        "avg_raw": ratio(F.col("raw"), F.col("executions")), "avg_filtered": ratio(F.col("filtered"), F.col("executions")), "saved": saved, "savings_percent": ratio(saved * 100, F.col("raw")),
    })


def frequencies(facts: DataFrame, column: str) -> DataFrame:
    return facts.groupBy(column).agg(F.count("*").alias("n"))


def filter_metrics(facts: DataFrame) -> DataFrame:
    """By filter: applications, saved (never below 0 a row), share, satisfaction (1 without feedback), last use."""
    g = facts.groupBy("command").agg(
        F.count("*").alias("applications"), F.sum(F.greatest(F.col("raw") - F.col("filtered"), F.lit(0))).alias("saved"), F.sum("raw").alias("raw"),
        F.count_if("useful").alias("useful"), F.count("useful").alias("feedback"), F.max("sec").alias("last_used"),
    )
    return g.withColumns({"savings_percent": ratio(F.col("saved") * 100, F.col("raw")), "satisfaction": ratio(F.col("useful"), F.col("feedback"), 1.0)})


def filter_ranking(metrics: DataFrame, limit: int) -> DataFrame:
    return metrics.orderBy(F.desc("saved"), F.desc("satisfaction"), "command").limit(limit)


def filter_improvements(metrics: DataFrame, now: int) -> DataFrame:
    """Advice: low satisfaction (high), low savings (medium), long unused (low)."""
    advice = F.array_compact(F.array(
        F.when((F.col("satisfaction") < 0.7) & (F.col("applications") >= 5), F.lit("high:satisfaction")),
        F.when((F.col("savings_percent") < 20) & (F.col("applications") >= 5), F.lit("medium:savings")),
        F.when(F.lit(now) - F.col("last_used") > 30 * 86400, F.lit("low:unused")),
    ))
    return metrics.select("command", F.explode(advice).alias("advice"))


def model_performance(runs: DataFrame) -> DataFrame:
    """By model and task: runs, share of first tries, whole average of tokens."""
    g = runs.groupBy("model", "task").agg(F.count("*").alias("runs"), F.count_if(F.col("outcome") == "accepted").alias("first_try"), F.sum("tokens").alias("tokens"))
    return g.select("model", "task", "runs", ratio(F.col("first_try"), F.col("runs")).alias("first_try_rate"), F.floor(F.col("tokens") / F.col("runs")).cast("long").alias("avg_tokens"))


def prompt_suggestion(runs: DataFrame, sections: DataFrame) -> DataFrame:
    """By task and section: always (in each successful run), or only in failures. sections: task, outcome, section
    for each occurrence."""
    ok = runs.groupBy("task").agg(F.count_if(F.col("outcome") == "accepted").alias("successes"))
    g = sections.groupBy("task", "section").agg(F.count_if(F.col("outcome") == "accepted").alias("ok"), F.count_if(F.col("outcome") != "accepted").alias("bad")).join(ok, "task")
    verdict = F.when((F.col("successes") > 0) & (F.col("ok") == F.col("successes")), "always").when((F.col("ok") == 0) & (F.col("bad") > 0), "only_failures")
    return g.withColumn("verdict", verdict).where("verdict is not null").select("task", "section", "verdict")


def recommended_budget(runs: DataFrame) -> DataFrame:
    """By task the mean tokens of its successful runs, in whole tokens; 0 without one."""
    ok = F.col("outcome") == "accepted"
    g = runs.groupBy("task").agg(F.sum(F.when(ok, F.col("tokens"))).alias("s"), F.count_if(ok).alias("n"))
    return g.select("task", F.when(F.col("n") > 0, F.floor(F.col("s") / F.col("n"))).otherwise(0).cast("long").alias("budget"))


def shared_items(items: DataFrame, share: float) -> DataFrame:
    """Items that at least a share of projects has. items: project, item."""
    own = items.distinct()
    n = own.select("project").distinct().agg(F.count("*").alias("projects"))  # one row
    g = own.groupBy("item").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(n), F.col("n") >= F.col("projects") * share).select("item", "n", ratio(F.col("n"), F.col("projects")).alias("share"))


def churn(commits: DataFrame, files: DataFrame) -> DataFrame:
    """By file: commits, last touch, and up to five authors."""
    rows = files.join(commits, "commit_id")
    g = rows.groupBy("file").agg(F.count("*").alias("churn"), F.max(F.struct("sec", "commit_id")).alias("x"), F.collect_set("author").alias("a"))
    return g.select("file", "churn", F.col("x.sec").alias("last_sec"), F.col("x.commit_id").alias("last_commit"), F.array_join(F.slice(F.array_sort("a"), 1, 5), ",").alias("authors"))


def hot_and_stable(per_file: DataFrame, limit: int = 5) -> DataFrame:
    hot = per_file.orderBy(F.desc("churn"), "file").limit(limit).withColumn("zone", F.lit("hot"))
    return hot.unionAll(per_file.orderBy("churn", "file").limit(limit).withColumn("zone", F.lit("stable")))


def active_areas(paths: DataFrame, limit: int = 4) -> DataFrame:
    """The most frequent last two path segments, lower-cased. paths: path."""
    parts = F.split(F.lower("path"), "/")
    area = F.when(F.size(parts) > 1, F.concat_ws("/", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))).otherwise(F.get(parts, F.lit(0)))
    return paths.select(area.alias("area")).groupBy("area").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(limit)


def sizes(rows: DataFrame) -> DataFrame:
    """Bytes of content by key. rows: key, content."""
    return rows.groupBy("key").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("n"))


def health(rows: DataFrame, required: list[str], now: int) -> DataFrame:
    """One row: missing keys, largest age and share of capacity, and the worst of the verdicts."""
    agg = rows.agg(F.collect_set("key").alias("keys"), F.max(F.lit(now) - F.col("updated_h")).alias("age_h"), F.sum(F.octet_length("content")).alias("bytes"))
    missing = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "keys"))
    status = F.when(missing > 0, "critical").when((F.col("age_h") > 72) | (F.col("bytes") > 0.9 * 51200), "warning").otherwise("healthy")
    return agg.select(missing.cast("long").alias("missing"), F.col("age_h").cast("long").alias("age_h"), F.col("bytes").cast("long").alias("bytes"), status.alias("status"))


def conflicts(changes: DataFrame) -> DataFrame:
    """Names changed more than once and in more than one file. changes: name, file."""
    return changes.groupBy("name").agg(F.count("*").alias("changes"), F.count_distinct("file").alias("files")).where("changes > 1 and files > 1")


def lifetime(snapshots: DataFrame) -> DataFrame:
    """Lifetime totals from growing session snapshots (session, seq, total): the sum of their increments."""
    before = F.lag("total").over(Window.partitionBy("session").orderBy("seq"))
    return snapshots.withColumn("delta", F.greatest(F.col("total") - F.coalesce(before, F.lit(0)), F.lit(0))).groupBy("session").agg(F.sum("delta").alias("total"), F.count("*").alias("flushes"))


def cache_efficiency(facts: DataFrame) -> DataFrame:
    """By project the share of cached requests and input for each output token (1 without output)."""
    g = facts.groupBy("project").agg(F.count_if("cached").alias("h"), F.count("*").alias("n"), F.sum("input").alias("i"), F.sum("output").alias("o"))
    return g.select("project", ratio(F.col("h") * 100, F.col("n")).alias("efficiency"), ratio(F.col("i"), F.col("o"), 1.0).alias("compression"))
