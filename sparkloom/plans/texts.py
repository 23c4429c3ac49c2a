"""Queries of scalar functions, text filters, vectors and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import search as se
from ..operators import textfilter as tf
from ..sources import tables as t

def paths():
    return F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("././src\\")).otherwise(F.lit("src/")), F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(F.array(*[F.lit(x) for x in (".rs", ".ts", ".py", ".zz", "")]), (F.col("p_partkey") % 5 + 1).cast("int")))

PATHS_SQL = "(CASE WHEN p_partkey % 2 = 0 THEN '././src' || chr(92) ELSE 'src/' END || replace(p_name, ' ', '_') || ['.rs', '.ts', '.py', '.zz', ''][p_partkey % 5 + 1])"
NORMAL = f"regexp_replace(replace({PATHS_SQL}, chr(92), '/'), '^(\\./)+', '')"

TOOL = tf.Filter("demo", "^demo", strip=("^$", "^En"), max_chars=40, head=5, max_lines=4, on_empty="demo: ok")
LINES = "string_split(regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;?]*[a-zA-Z]', '', 'g'), '\\n$', ''), chr(10))"

QUERY = "the onoring from than of"


def _vector(s, d):
    return [float(x) for x in t.table(s, d, "embeddings").where("vec_id = 3").first()["embedding"]]


def _refs(s, d):
    return [(f"ref{r['vec_id']}", [float(x) for x in r["embedding"]]) for r in t.table(s, d, "embeddings").where("vec_id in (0, 1, 2)").orderBy("vec_id").collect()]


COS = "(list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[]))))"

BM = ["the", "onoring", "from", "than", "of"]
BM_SQL = (
    "WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), o AS (SELECT id, len(w) AS len, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS t{i}" for i, x in enumerate(BM))
    + " FROM w), s AS (SELECT count(*) AS n, avg(len) AS al, "
    + ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(BM)))
    + " FROM o) SELECT id, score FROM (SELECT id, round("
    + " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in range(len(BM)))
    + ", 6) AS score FROM o, s) WHERE score > 0 ORDER BY score DESC, id LIMIT 20"
)

PLANS = {
    "sf1_paths": (lambda s, d: t.table(s, d, "part").select("p_partkey", fn.normalize_path(paths()).alias("path"), fn.file_id(paths()).alias("id")), f"SELECT p_partkey, {NORMAL} AS path, 'fsi::' || {NORMAL} AS id FROM part"),
    "sf2_symbol_ids": (
        lambda s, d: t.table(s, d, "part").select("p_partkey", fn.symbol_id(F.lit("./src/a.rs"), F.concat("p_name", F.lit("::x y")), F.col("p_brand")).alias("id")),
        "SELECT p_partkey, 'fusi::src/a.rs::' || regexp_replace(replace(p_name || '::x y', '::', '_'), '\\s+', '_', 'g') || '::' || p_brand AS id FROM part",
    ),
    "sf3_languages": (
        lambda s, d: t.table(s, d, "part").select("p_partkey", fn.language(paths()).alias("language")),
        f"SELECT p_partkey, CASE regexp_extract({PATHS_SQL}, '\\.([A-Za-z0-9]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE 'unknown' END AS language FROM part",
    ),
    "sf5_signature_heads": (lambda s, d: t.table(s, d, "documents").select("doc_id", fn.signature_head(F.col("text")).alias("head")), "SELECT doc_id, trim(string_split(trim(string_split(text, chr(10))[1]), '{')[1]) AS head FROM documents"),
    "sf9_line_counts": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", fn.line_count(F.col("text")).cast("long").alias("lines")),
        "SELECT doc_id, greatest(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))), 1) AS lines FROM documents",
    ),
    "sf11_token_estimates": (lambda s, d: t.table(s, d, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, strlen(text) // 4 AS tokens FROM documents"),
    "sf13_truncation": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", fn.truncated(F.col("text"), 40).alias("short")),
        "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS short FROM documents",
    ),
    "sf15_formats": (
        lambda s, d: t.table(s, d, "orders").select("o_orderkey", fn.format_tokens((F.floor(F.col("o_totalprice")) * 100 + 1).cast("long")).alias("tokens"), fn.human_bytes(F.floor(F.col("o_totalprice") * 100).cast("long")).alias("bytes")),
        """SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE n::VARCHAR END AS tokens,
          CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS bytes
          FROM (SELECT o_orderkey, (floor(o_totalprice) * 100 + 1)::BIGINT AS n, floor(o_totalprice * 100)::BIGINT AS b FROM orders)""",
    ),
    "sf18_verbs": (
        lambda s, d: t.table(s, d, "part").select("p_partkey", fn.verb(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("getUser", "onClick", "Zebra", "zooKeeper", "setup")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_brand"))).alias("verb")),
        "SELECT p_partkey, ['get', 'on', 'zebra', 'zoo', 'set'][p_partkey % 5 + 1] || CASE WHEN p_partkey % 5 = 2 AND NOT regexp_matches(p_brand, '^[A-Z]') THEN p_brand ELSE '' END AS verb FROM part",
    ),
    "sf19_slugs": (lambda s, d: t.table(s, d, "pages").select("page_id", fn.slug(F.col("url")).alias("slug")), "SELECT page_id, left(regexp_replace(lower(url), '[^a-z0-9]', '_', 'g'), 40) AS slug FROM pages"),
    "sf20_templates": (
        lambda s, d: t.table(s, d, "nation").select(fn.filled(F.lit("Use {name} in {region}"), {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")}).alias("text")),
        "SELECT 'Use ' || n_name || ' in ' || n_regionkey AS text FROM nation",
    ),
    "sf21_cooldowns": (
        lambda s, d: t.table(s, d, "nation").select("n_nationkey", fn.cooldown_ms(F.element_at(F.array(*[F.lit(x) for x in ("500ms", "2s", "every 5 minutes", "3h", "soon")]), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("ms")),
        "SELECT n_nationkey, [500, 2000, 300000, 10800000, 0][n_nationkey % 5 + 1]::BIGINT AS ms FROM nation",
    ),
    "sf25_session_scores": (
        lambda s, d: t.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("c"), F.count_if(F.col("l_linestatus") == "F").alias("r")).select("l_suppkey", *[x.cast("long").alias(a) for x, a in zip(fn.session_score(F.col("c") % 8, F.col("r") % 9), ("compliance", "penalty"))]),
        """SELECT l_suppkey, greatest(100 - 15 * c - 5 * r, 0) AS compliance, least(20 * c + 10 * r, 255) AS penalty FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') % 8 AS c, count(*) FILTER (l_linestatus = 'F') % 9 AS r FROM lineitem GROUP BY 1)""",
    ),
    "sf26_generated_paths": (lambda s, d: t.table(s, d, "pages").select("page_id", fn.generated(F.concat("url", F.lit("/build/x"))).alias("generated")), "SELECT page_id, true AS generated FROM pages"),
    "vs3_keyword_scores": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", F.round(fn.keyword_score(QUERY, F.col("text")), 6).alias("score")),
        "SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'onoring')::INT + contains(lower(text), 'from')::INT + contains(lower(text), 'than')::INT) / 4, 6) AS score FROM documents",
    ),
    "vs9_query_boosts": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", fn.query_boost(QUERY, F.col("text")).alias("boost")),
        "SELECT doc_id, least(round((contains(lower(text), 'the')::INT + contains(lower(text), 'onoring')::INT + contains(lower(text), 'from')::INT + contains(lower(text), 'than')::INT) * 10.0 / 4), 10)::INTEGER AS boost FROM documents",
    ),
    "vs1_vector_topk": (
        lambda s, d: se.vector_topk(t.table(s, d, "embeddings"), _vector(s, d), 10),
        f"SELECT vec_id, round({COS}, 6) AS score FROM (SELECT vec_id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10",
    ),
    "vs4_hybrid_topk": (
        lambda s, d: se.hybrid_topk(t.table(s, d, "embeddings").join(t.table(s, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "embedding", F.col("text").alias("content")), _vector(s, d), QUERY),
        f"""SELECT id, round(0.8 * ({COS} + 1) * 0.5 + 0.2 * k, 6) AS score FROM (SELECT vec_id AS id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b,
          (contains(lower(text), 'the')::INT + contains(lower(text), 'onoring')::INT + contains(lower(text), 'from')::INT + contains(lower(text), 'than')::INT) / 4 AS k FROM embeddings JOIN documents ON vec_id = doc_id) ORDER BY score DESC, id LIMIT 10""",
    ),
    "vs5_best_reference": (
        lambda s, d: se.best_reference(t.table(s, d, "embeddings"), _refs(s, d), 0.1),
        f"""SELECT vec_id, arg_max(name, (score, name)) AS name, max(score) AS score FROM (SELECT vec_id, name, round({COS}, 6) AS score FROM (SELECT e.vec_id, e.embedding AS a, 'ref' || r.vec_id AS name, r.embedding AS b FROM embeddings e, embeddings r WHERE r.vec_id < 3)) GROUP BY vec_id HAVING max(score) >= 0.1""",
    ),
    "vs6_bm25": (lambda s, d: se.bm25(t.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), QUERY, 20), BM_SQL),
    "tf1_filter_names": (
        lambda s, d: t.table(s, d, "nation").select("n_nationkey", tf.filter_name(F.element_at(F.array(*[F.lit(x) for x in ("git status -s", "cargo test", "npm i x", "zzz", "npx jest")]), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("filter")),
        "SELECT n_nationkey, ['git-status', 'cargo-test', 'npm-install', NULL, 'jest'][n_nationkey % 5 + 1] AS filter FROM nation",
    ),
    "tf2_filtered_text": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", tf.applied(TOOL, F.col("text")).alias("out")),
        f"""SELECT doc_id, CASE WHEN trim(o) = '' THEN 'demo: ok' ELSE o END AS out FROM (SELECT doc_id, array_to_string(list_transform(list_filter({LINES}, lambda x: NOT regexp_matches(x, '^$') AND NOT regexp_matches(x, '^En')), lambda x: left(x, 40))[1:4], chr(10)) AS o FROM documents)""",
    ),
    "tf7_savings": (
        lambda s, d: tf.savings(t.table(s, d, "documents").select("doc_id", "text", F.regexp_replace("text", "[a-z]*o[a-z]* ?", "").alias("f")), "text", "f").select("doc_id", "saved", "saved_percent"),
        "SELECT doc_id, greatest(r - f, 0) AS saved, round(CASE WHEN r > 0 THEN (r - f) * 100.0 / r ELSE 0 END, 6)::DOUBLE AS saved_percent FROM (SELECT doc_id, strlen(text) // 4 AS r, strlen(regexp_replace(text, '[a-z]*o[a-z]* ?', '', 'g')) // 4 AS f FROM documents)",
    ),
    "pf18_pruned_rules": (
        lambda s, d: t.table(s, d, "documents").select("doc_id", F.md5(tf.pruned(F.col("text"), "bug_fix", ["onoring"])).alias("digest")),
        f"SELECT doc_id, md5(array_to_string(list_filter({LINES}, lambda x: regexp_matches(lower(x), 'warning|issue|debug|safety|agent|onoring'))[1:80], chr(10))) AS digest FROM documents",
    ),
}
