"""Queries of the persistent text index: built from documents, with deletions, replacements, commits and a merge."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.cut import shared_folder
from ..operators.textindex import TextIndex
from ..sources import tables as t

ASKED = ["the onoring from than of", 'los -from "of the" NOT onoring OR que', '+the AND of "and the"', '"the the" "in and of"']
ADDED = " los of the"


def _index(s, d, merged: bool) -> TextIndex:
    """All documents; then without those in German, and every tenth with words added."""
    docs = t.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    index = TextIndex(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}", buckets=8, parts=2)
    index.insert(docs)
    index.commit()
    index.delete(docs.where("lang = 'de'"))
    index.replace(docs.where("id % 10 = 0").select("id", F.concat("content", F.lit(ADDED)).alias("content")))
    index.commit()
    if merged:
        index.merge()
    index.delete(docs.where("lang = 'en'"))  # not committed, so not seen
    return index


def _found(s, d, merged=False):
    index, out = _index(s, d, merged), None
    for i, q in enumerate(ASKED):
        part = index.search(q, 20).select(F.lit(i).alias("query"), "id", "score")
        out = part if out is None else out.unionByName(part)
    return out


FINAL = f"""f AS (SELECT doc_id::VARCHAR AS id, regexp_extract_all(lower(coalesce(CASE WHEN doc_id % 10 = 0 THEN text || '{ADDED}' ELSE text END, '')), '[a-z0-9]+') AS w
  FROM documents WHERE doc_id % 10 = 0 OR lang IS DISTINCT FROM 'de'), g AS (SELECT id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM f)"""
HAS = "contains(t, ' {} ')"
RULES = [
    (["the", "onoring", "from", "than", "of"], " OR ".join(HAS.format(x) for x in ("the", "onoring", "from", "than", "of"))),
    (["los", "of", "the", "que"], f"({HAS.format('los')} OR {HAS.format('of the')} OR {HAS.format('que')}) AND NOT {HAS.format('from')} AND NOT {HAS.format('onoring')}"),
    (["the", "of", "and"], f"{HAS.format('the')} AND {HAS.format('of')}"),
    (["the", "in", "and", "of"], f"({HAS.format('the the')} OR {HAS.format('in and of')})"),
]
SQL = (
    f"WITH {FINAL}, s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM f), p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, unnest(w) AS term, len(w) AS l FROM f) GROUP BY id, term), "
    "d AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term), b AS (SELECT id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al)) AS x FROM p JOIN d USING (term), s) "
    + " UNION ALL ".join(
        f"(SELECT {i} AS query, id, round(sum(x), 6) AS score FROM b JOIN g USING (id) WHERE term IN ({', '.join(repr(w) for w in words)}) AND ({rule}) GROUP BY id ORDER BY score DESC, id LIMIT 20)" for i, (words, rule) in enumerate(RULES)
    )
)
COUNTS = f"WITH {FINAL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, sum(sp)::BIGINT AS places FROM (SELECT id, term, count(*) AS tf, sum(i) AS sp FROM (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM f) GROUP BY id, term) WHERE term IN ('the', 'of', 'los', 'onoring') GROUP BY term"


def _postings(s, d):
    rows = _index(s, d, True).postings(["the", "of", "los", "onoring"], "positions")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("places"))


PLANS = {
    "vs6_index_search": (_found, SQL),
    "vs6_merged_index_search": (lambda s, d: _found(s, d, True), SQL),
    "vs6_index_postings": (_postings, COUNTS),
}
