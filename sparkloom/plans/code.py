"""Queries over symbols: rules, categories, summaries, token counts and code filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import codefilter as cf
from ..operators import extraction as ex
from ..operators import rules as r
from ..sources import tables as t

#: Where this machine has the vocabulary that queries count tokens by.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DIRS = ("src/api/", "src/services/", "lib/", "src/components/", "tests/", "src/actions/", "core/", "./src/middleware/", "src/repository/")


def symbols(s, d):
    """Symbols of parts: a folder by key, a file by brand, complexity by size."""
    p = t.table(s, d, "part")
    n = F.col("p_partkey")
    folder = F.get(F.array(*[F.lit(x) for x in DIRS]), F.pmod(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"), F.lit(len(DIRS))))
    return p.select(
        F.concat(folder, F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(n % 3 == 0, F.lit(".ts")).otherwise(F.lit(".py"))).alias("file"),
        F.when(n % 10 == 0, F.lit("GET")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.when(n % 4 == 0, "class").otherwise("function").alias("kind"),
        F.when(n % 3 == 0, "typescript").otherwise("python").alias("language"), F.col("p_type").alias("body"), F.col("p_size").cast("int").alias("complexity"), (n % 2 == 0).alias("exported"),
        F.when(n % 50 == 0, F.array(F.lit("tests"))).otherwise(F.array().cast("array<string>")).alias("tags"), n.alias("start"),
    )


SYM = (
    "sym AS (SELECT [" + ", ".join(f"'{x}'" for x in DIRS) + "][regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER % 9 + 1] || lower(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 3 = 0 THEN '.ts' ELSE '.py' END AS file, "
    "CASE WHEN p_partkey % 10 = 0 THEN 'GET' ELSE replace(p_name, ' ', '_') END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'class' ELSE 'function' END AS kind, p_size AS complexity, p_partkey % 2 = 0 AS exported, p_partkey % 50 = 0 AS test, p_partkey AS start, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'typescript' ELSE 'python' END AS language, p_type AS body FROM part), "
    "f AS (SELECT file, regexp_replace(lower(file), '^(\\./)+', '') AS path, count(*) AS n, sum(complexity)::BIGINT AS cx, bool_or(test) AS test, bool_or(exported) AS ex, bool_or(exported) AND bool_or(name = 'GET') AND bool_or(kind = 'function') AS api, bool_or(starts_with(name, 'test_')) AS tn, min(language) AS language FROM sym GROUP BY file), "
    "g AS (SELECT *, list_sort(list_filter([CASE WHEN test THEN 'tests' END, CASE WHEN regexp_matches(path, '(^|/)(api)(/|$)') AND api THEN 'api-route' END, CASE WHEN regexp_matches(path, '(^|/)(middleware|webhook|webhooks)(/|\\.|$)') THEN 'edge-guards' END], lambda x: x IS NOT NULL)) AS signals, test OR tn OR contains(path, '/tests/') AS is_test FROM f)"
)
CATEGORY = (
    "CASE WHEN regexp_matches(path, '(^|/)(api)(/|$)') OR list_contains(signals, 'api-route') THEN 'api-surface' WHEN regexp_matches(path, '(^|/)(actions)(/|$)') THEN 'server-actions' WHEN regexp_matches(path, '(^|/)(components)(/|$)') THEN 'ui-components' "
    "WHEN regexp_matches(path, '(^|/)(services|repositories|adapters|facades)(/|$)') THEN 'domain-services' WHEN regexp_matches(path, '(^|/)(tests?|spec)(/|$)') OR list_contains(signals, 'tests') THEN 'tests' "
    "WHEN regexp_matches(path, '(^|/)(lib|shared)(/|$)') THEN 'shared-library' WHEN is_test THEN 'tests' WHEN ex THEN 'shared-library' ELSE 'application-logic' END"
)


def _files(s, d):
    return r.files_of(symbols(s, d))


def _sample_code(s, d):
    """Pages' html as text of a language with comment signs."""
    return t.table(s, d, "pages").select("page_id", F.regexp_replace("html", "><", ">\n<").alias("text"))


PLANS = {
    "pf13_pattern_tags": (lambda s, d: _files(s, d).select("file", F.array_join("signals", ",").alias("signals")), f"WITH {SYM} SELECT file, array_to_string(signals, ',') AS signals FROM g"),
    "pf12_file_categories": (lambda s, d: r.categorized(_files(s, d)).select("file", "category"), f"WITH {SYM} SELECT file, {CATEGORY} AS category FROM g"),
    "ag10_project_summary": (
        lambda s, d: r.project_summary(_files(s, d)),
        f"WITH {SYM} SELECT count(*) AS files, sum(n)::BIGINT AS functions, least(round(sum(cx) / (sum(n) * 12), 6), 1.0) AS complexity_score, round(count(*) FILTER (regexp_matches(path, '\\.(ts|tsx|rs|go|java|cs|kt|swift)$')) / count(*), 6) AS type_coverage, round(count(*) FILTER (is_test) / count(*), 6) AS test_share FROM g",
    ),
    "ag10_languages": (lambda s, d: r.languages(_files(s, d)), f"WITH {SYM} SELECT language, count(*) AS files FROM g GROUP BY language"),
    "ag11_fingerprints": (
        lambda s, d: r.fingerprints(_files(s, d)),
        f"WITH {SYM} SELECT file, sum(complexity)::BIGINT AS complexity, CASE WHEN bool_or(exported) THEN string_agg(name, ',' ORDER BY start) FILTER (exported) ELSE array_to_string(list(name ORDER BY start)[1:5], ',') END AS exports FROM sym GROUP BY file",
    ),
    "ag12_error_style": (
        lambda s, d: r.dominant_style(symbols(s, d), [("brass", ["BRASS"], 1), ("steel", ["STEEL", "TIN"], 1), ("copper", ["COPPER"], 10**9)]),
        """SELECT CASE WHEN a >= b AND a >= 1 THEN 'brass' WHEN b >= 1 THEN 'steel' ELSE 'mixed' END AS style FROM (SELECT sum(len(regexp_extract_all(p_type, 'BRASS'))) AS a, sum(len(regexp_extract_all(p_type, 'STEEL|TIN'))) AS b FROM part)""",
    ),
    "ag13_architecture": (
        lambda s, d: r.architecture(r.categorized(_files(s, d)), 3, True),
        f"WITH {SYM}, c AS (SELECT {CATEGORY} AS category FROM g) SELECT CASE WHEN count(DISTINCT category) FILTER (category IN ('api-surface', 'server-actions', 'ui-components', 'domain-services')) = 4 THEN 'server-first/modular-monolith' ELSE 'modular-monolith' END AS architecture FROM c",
    ),
    "pf15_commit_decisions": (
        lambda s, d: r.commit_decisions(t.table(s, d, "part").select(F.col("p_partkey").alias("commit"), F.concat(F.element_at(F.array(*[F.lit(x) for x in ("use ", "adopt ", "migrate to ", "fix ", "switch to ")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" for "), F.col("p_type")).alias("message"))),
        "SELECT p_partkey AS commit, replace(p_name, ' ', '_') AS tool, CASE WHEN p_partkey % 5 = 2 THEN 'for ' ELSE '' END || p_type AS purpose FROM part WHERE p_partkey % 5 <> 3",
    ),
    "pf14_decisions": (
        lambda s, d: r.decisions(t.table(s, d, "part").select(F.col("p_partkey").alias("signal"), F.lit("dependency").alias("kind"), F.lit("Added").alias("trigger"), F.col("p_type").alias("subject")), [r.Decision("steel", "dependency", "added", "STEEL$", "Use {name}"), r.Decision("any", "dependency", "added", None, "Added {name}"), r.Decision("none", "directory", "added", None, "x")]),
        "SELECT p_partkey AS signal, 'steel' AS rule, 'Use ' || p_type AS title FROM part WHERE p_type LIKE '%STEEL' UNION ALL SELECT p_partkey, 'any', 'Added ' || p_type FROM part",
    ),
    "jn6_resolved_calls": (
        lambda s, d: ex.resolve_calls(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("caller_file"), F.col("l_linenumber").alias("caller"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("callee_file"), (F.col("l_partkey") % 50).alias("callee")), t.table(s, d, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") % 50).alias("name"))),
        """WITH c AS (SELECT l_orderkey AS caller_file, l_linenumber AS caller, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS cf, l_partkey % 50 AS callee FROM lineitem), d AS (SELECT s_suppkey AS file, s_suppkey % 50 AS name FROM supplier)
          SELECT caller_file, caller, callee, cf AS callee_file FROM c WHERE EXISTS (SELECT 1 FROM d WHERE file = cf AND name = callee)
          UNION ALL SELECT caller_file, caller, callee, file FROM c JOIN d ON name = callee WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.file = cf AND e.name = callee)""",
    ),
    "sf10_token_counts": (lambda s, d: t.table(s, d, "documents").select("doc_id", tk.count_tokens(F.col("text"), VOCABULARY).alias("tokens")), None),
    "tf4_without_comments": (lambda s, d: _sample_code(s, d).select("page_id", F.md5(cf.applied(F.col("text"), F.lit("typescript"))).alias("digest")), None),
    "tf6_smart_truncation": (lambda s, d: _sample_code(s, d).select("page_id", F.md5(cf.applied(F.col("text"), F.lit("typescript"), _short)).alias("digest")), None),
    "sc14_symbols": (lambda s, d: ex.extract(_sample_code(s, d).select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".ts")).alias("file"), F.regexp_replace("text", "<script>", "<script>\nfunction page() {").alias("text"))).select("file", "name", "kind", "start", "complexity"), None),
}


def _short(text: str, language: str) -> str:
    return cf.smart_truncate(text, 20)
