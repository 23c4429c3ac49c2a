"""Vector and keyword search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, keyword_score
from .cut import cut_lineage


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of greatest cosine; none for a query without length or of another dimension. The query is a
    literal, so this is one scan and a bounded top-n."""
    if not any(query):
        return vectors.select("vec_id", F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size("embedding") == len(query))
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def hybrid_topk(rows: DataFrame, query_vector: list[float], query: str, k: int = 10) -> DataFrame:
    """0.8 of the scaled cosine and 0.2 of the keyword score. rows: id, embedding, content."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    score = 0.8 * (cosine(F.col("embedding"), q) + 1) * 0.5 + 0.2 * keyword_score(query, F.col("content"))
    return rows.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def best_reference(vectors: DataFrame, references: list[tuple[str, list[float]]], threshold: float) -> DataFrame:
    """For each vector its best reference at or over a threshold; references are literals of a rule file."""
    scored = F.array(*[F.struct(F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in v])), 6).alias("score"), F.lit(n).alias("name")) for n, v in references])
    return vectors.select("vec_id", F.array_max(scored).alias("b")).select("vec_id", F.col("b.name").alias("name"), F.col("b.score").alias("score")).where(F.col("score") >= threshold)


WORD = "[a-z0-9]+"


def term_table(rows: DataFrame) -> DataFrame:
    """(id, term, tf): the inverted index of rows (id, content)."""
    return rows.select("id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(rows: DataFrame, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k rows of greatest BM25 score. One scan counts lengths and the query's terms in a row."""
    terms = sorted(set(re.findall(WORD, query.lower())))
    words = F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))
    own = rows.select("id", words.alias("w")).select("id", F.size("w").alias("len"), *[F.size(F.filter("w", _equals(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    own = cut_lineage(own)  # counts only, so that texts are read and cut into words once
    stats = own.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])  # one row
    all_ = own.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"t{i}")
        idf = F.ln(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return all_.select("id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


_CLAUSE = re.compile(r'([+-]?)(?:"([^"]*)"|(\S+))')


def parsed(query: str) -> list[tuple[str, list[str]]]:
    """Clauses (must, not or should; words) of a query: words and "phrases" with + or - before them, AND and OR between, NOT
    before. AND makes both its neighbours needed."""
    out: list[list] = []
    both = negate = False
    for sign, phrase, word in _CLAUSE.findall(query):
        if not sign and word in ("AND", "OR", "NOT"):
            both, negate = both or word == "AND", negate or word == "NOT"
            if word == "AND" and out and out[-1][0] == "should":
                out[-1][0] = "must"
            continue
        words = re.findall(WORD, (phrase or word).lower())
        if words:
            out.append(["not" if sign == "-" or negate else "must" if sign == "+" or both else "should", words])
        both = negate = False
    return [(k, w) for k, w in out]


def matching(rows: DataFrame, query: str) -> DataFrame:
    """Rows (id, content) that a query allows: all that is needed, nothing that is excluded, and of the rest one word or
    phrase at least where nothing is needed."""
    text = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    clauses = [(k, F.col("_t").contains(f" {' '.join(w)} ")) for k, w in parsed(query)]
    must, should = [c for k, c in clauses if k == "must"], [c for k, c in clauses if k == "should"]
    ok = F.lit(bool(must or should))
    for k, c in clauses:
        ok = ok & c if k == "must" else ok & ~c if k == "not" else ok
    if not must and should:
        one = F.lit(False)
        for c in should:
            one = one | c
        ok = ok & one
    return rows.withColumn("_t", text).where(ok).drop("_t")


def nearest_by_group(rows: DataFrame, group: str, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", r).where(F.col("rank") <= k)
