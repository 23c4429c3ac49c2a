"""The supplied tables seen as the engine's data model: memory rows, events, edges, facts and snapshots.

Each adapter is a projection or aggregate of parquet tables; filters and columns reach the scans. SQL has the
same adapters for DuckDB as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Which event type stands for which kind of log entry.
KIND_OF = {"click": "mutation", "view": "memory", "signup": "intent", "error": "penalty", "purchase": "ai_call"}


def event_log(spark, sf_dir) -> DataFrame:
    """event_id, sec, kind, file (mutations), intent (intents), severity (penalties), tokens (calls), project."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv]), F.col("event_type"))
    file = F.concat(F.lit("src/f"), F.col("user_id"), F.lit(".ts"))
    return e.select(
        "event_id",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"),
        kind.alias("kind"),
        F.when(kind == "mutation", file).alias("file"),
        F.when(kind == "intent", F.concat(F.lit("intent"), F.col("user_id") % 6)).alias("intent"),
        F.when(kind == "penalty", F.floor("value").cast("long") % 10).alias("severity"),
        F.when(kind == "ai_call", F.floor("value").cast("long")).alias("tokens"),
        F.concat(F.lit("p"), F.col("user_id") % 7).alias("project"),
        F.col("value"),
    )


def memory_rows(spark, sf_dir) -> DataFrame:
    """Memory rows of documents: id, project_id, kind, content, tags, created and updated (hours), access_count."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "fr", "decision").when(F.col("lang") == "de", "pattern").otherwise("warning")
    return d.select(
        F.concat(F.lit("m"), F.col("doc_id")).alias("id"),
        F.col("source").alias("project_id"),
        kind.alias("kind"),
        F.col("text").alias("content"),
        F.array(F.col("lang"), F.concat(F.lit("t"), F.col("doc_id") % 5)).alias("tags"),
        (F.col("doc_id") % 1000).alias("created_h"),
        (F.col("doc_id") % 1000 + F.col("doc_id") % 97).alias("updated_h"),
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("m"), F.col("doc_id") + 1)).alias("superseded_by"),
        F.col("doc_id").alias("n"),
    )


def nation_edges(spark, sf_dir) -> DataFrame:
    """Supplier nation to customer nation, where the count of lines exceeds the 0.8 quantile; no self-edges."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    pairs = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("src", "dst").agg(F.count("*").alias("n")).where("src <> dst")
    )
    cut = pairs.agg(F.percentile("n", F.lit(0.8)).alias("cut"))  # one row
    name = lambda c: F.format_string("n%02d", F.col(c))
    return pairs.join(F.broadcast(cut), F.col("n") > F.col("cut")).select(name("src").alias("src"), name("dst").alias("dst"))


def page_links(spark, sf_dir) -> DataFrame:
    """page_id and each href of a page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))


def token_facts(spark, sf_dir) -> DataFrame:
    """project, input, output, total, cached, cost, sec of lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("project"),
        F.col("l_quantity").cast("long").alias("input"),
        F.col("l_linenumber").cast("long").alias("output"),
        (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("total"),
        (F.col("l_returnflag") == "R").alias("cached"),
        (F.col("l_discount") * F.col("l_extendedprice")).alias("cost"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("sec"),
    )


def command_facts(spark, sf_dir) -> DataFrame:
    """command, ok, raw, filtered, sec, n, useful (true, false or null) of orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("command"),
        (F.col("o_orderstatus") == "F").alias("ok"),
        F.floor("o_totalprice").cast("long").alias("raw"),
        F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 5) / 5).cast("long").alias("filtered"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("sec"),
        F.col("o_orderkey").alias("n"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(True)).when(F.col("o_custkey") % 3 == 1, F.lit(False)).alias("useful"),
    )


def commits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """commits (commit_id, author, sec) of orders and commit_files (commit_id, file) of lines."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("sec"))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file")).distinct()
    return c, f


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two versions (key, name, body) of parts: some rows only in one, some with another body."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("body"), "p_size")
    old = p.where("key % 11 <> 0").select("key", "name", "body", F.col("p_size").alias("version"))
    new = p.where("key % 7 <> 0").select("key", "name", F.when(F.col("key") % 5 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"), F.when(F.col("key") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("version"))
    return old, new


SQL = {
    "log": """log AS (SELECT event_id, floor(epoch(ts))::BIGINT AS sec, k AS kind, CASE WHEN k = 'mutation' THEN 'src/f' || user_id || '.ts' END AS file,
      CASE WHEN k = 'intent' THEN 'intent' || (user_id % 6) END AS intent, CASE WHEN k = 'penalty' THEN floor(value)::BIGINT % 10 END AS severity,
      CASE WHEN k = 'ai_call' THEN floor(value)::BIGINT END AS tokens, 'p' || (user_id % 7) AS project, value
      FROM (SELECT *, CASE event_type WHEN 'click' THEN 'mutation' WHEN 'view' THEN 'memory' WHEN 'signup' THEN 'intent' WHEN 'error' THEN 'penalty' WHEN 'purchase' THEN 'ai_call' END AS k FROM events))""",
    "mem": """mem AS (SELECT 'm' || doc_id AS id, source AS project_id, CASE lang WHEN 'en' THEN 'fact' WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'pattern' ELSE 'warning' END AS kind,
      text AS content, [lang, 't' || (doc_id % 5)] AS tags, doc_id % 1000 AS created_h, doc_id % 1000 + doc_id % 97 AS updated_h, CASE WHEN doc_id % 9 = 0 THEN 'm' || (doc_id + 1) END AS superseded_by, doc_id AS n FROM documents)""",
    "edges": """pairs AS (SELECT s_nationkey AS s, c_nationkey AS d, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
      edges AS (SELECT format('n{:02d}', s) AS src, format('n{:02d}', d) AS dst FROM pairs WHERE n > (SELECT quantile_cont(n, 0.8) FROM pairs))""",
    "links": """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""",
    "tok": """tok AS (SELECT l_suppkey AS project, l_quantity::BIGINT AS input, l_linenumber::BIGINT AS output, l_quantity::BIGINT + l_linenumber AS total, l_returnflag = 'R' AS cached,
      l_discount * l_extendedprice AS cost, floor(epoch(l_shipdate))::BIGINT AS sec FROM lineitem)""",
    "cmd": """cmd AS (SELECT o_orderpriority AS command, o_orderstatus = 'F' AS ok, floor(o_totalprice)::BIGINT AS raw, floor(o_totalprice * (o_orderkey % 5) / 5)::BIGINT AS filtered,
      floor(epoch(o_orderdate))::BIGINT AS sec, o_orderkey AS n, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS useful FROM orders)""",
    "commits": """commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, floor(epoch(o_orderdate))::BIGINT AS sec FROM orders),
      commit_files AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem)""",
    "snap": """olds AS (SELECT p_partkey AS key, p_name AS name, p_type AS body, p_size AS version FROM part WHERE p_partkey % 11 <> 0),
      news AS (SELECT p_partkey AS key, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_type || '!' ELSE p_type END AS body, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS version FROM part WHERE p_partkey % 7 <> 0)""",
}


def with_adapters(body: str, *names: str) -> str:
    """A DuckDB statement over adapters."""
    more = "" if body.lstrip().upper().startswith("SELECT") else ","
    return f"WITH RECURSIVE {', '.join(SQL[n] for n in names)}{more} {body}"
