"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Only DataFrame functions. A canonical URL sets eight bits of one block of 512, so the filter is a table of
(block, eight words) built by bit_or with map-side combine, and a probe reads one block. Pages that miss a bit are done
where they were scanned; only possible hits travel to the exact hash join with the list, which removes false positives.

The filter is broadcast while its blocks are known to take at most BROADCAST_BYTES (the list is counted first);
a longer one is joined by block as the planner sees fit. The list is never broadcast by this code. Pages of one hot
URL meet one row of the list (it is distinct), so a skewed partition of pages can be split.

Defined cases: a null url, or one without "://", has an empty host and path, no canonical form, fits no rule and is not
listed; null and such urls in the list are left out, repeated ones count once; repeated pages give repeated rows; a null
page_id is carried; of rules of equal length that fit, the one of the longer host wins; urls of any length are judged
whole; a list or table without rows gives no hits or no rows. Columns beside page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, table

#: The rules (verdict, host, path), and parameters that name a visit and not a page.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"

WORDS = 8
KEYS_PER_BLOCK = 32
#: A broadcast block: its number and words, and what a hash table adds to a row.
BLOCK_BYTES = 8 * (WORDS + 1) + 48
BROADCAST_BYTES = 64 << 20


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?]*([^?]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for urls of one page: no scheme, user, www., default port, final slashes, fragment or tracking
    parameters; parameters in order. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r"\.?(:80|:443|:)?\z", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(_after_scheme(url), r"(?s)^[^?]*\?(.*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_columns(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # longer ones go outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _block_and_masks(url: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and one bit for each of its words."""
    bits = F.xxhash64(url, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)), masks


def bloom_filter(urls: DataFrame, n_urls: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) for a column `listed_url` of n_urls distinct canonical URLs, and the number of blocks."""
    n_blocks = max(1, -(-n_urls // KEYS_PER_BLOCK))
    block, masks = _block_and_masks(F.col("listed_url"), n_blocks)
    rows = urls.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def judge(pages: DataFrame, listed: DataFrame, rules=None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per page its host, path, canonical_url, rule, whether it is listed, and verdict: the rule's; without one,
    block for listed URLs and else allow. listed has a column `url`."""
    known = materialize(listed.select(canonical(F.col("url")).alias("listed_url")).where(F.col("listed_url").isNotNull()).distinct(), "urls")
    blocks, n_blocks = bloom_filter(known, known.count())
    if n_blocks * BLOCK_BYTES <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    block, masks = _block_and_masks(F.col("canonical_url"), n_blocks)
    url = F.col("url")
    probed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url"))
    probed = probed.withColumn("block", block).join(blocks, "block", "left")
    passes = F.lit(True)
    for i, mask in enumerate(masks):
        passes = passes & (F.col(f"w{i}").bitwiseAND(mask) != 0)
    possible = F.col("canonical_url").isNotNull() & F.coalesce(passes, F.lit(False))
    own = ["page_id", "host", "path", "canonical_url"]
    hits = probed.where(possible).select(*own).join(known, F.col("canonical_url") == F.col("listed_url"), "left")
    misses = probed.where(~possible).select(*own, F.lit(None).cast("string").alias("listed_url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    listed_here = F.col("listed_url").isNotNull()
    return hits.unionByName(misses).select(
        *own,
        rule.alias("rule"),
        listed_here.alias("listed"),
        F.coalesce(verdict, F.when(listed_here, F.lit("block")).otherwise("allow")).alias("verdict"),
    )


def toxic_urls(spark, sf_dir: str) -> DataFrame:
    """The list of the query: urls of pages whose id has a label that says toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", "url").join(toxic, "page_id", "left_semi").select("url")


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), toxic_urls(spark, sf_dir))


#: The same for DuckDB, by plain comparison with the list.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(substr(url, instr(url, '://') + 3), '#', 1) END AS s FROM pages),
h AS (SELECT page_id, s, coalesce(translate(regexp_extract(s, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(s, '^[^/?]*([^?]*)', 1), '') AS path FROM a),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '\.?(:80|:443|:)?\z', ''), '^www\.', '') AS site,
  list_sort(list_filter(string_split(regexp_extract(s, '(?s)^[^?]*\?(.*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS q FROM h),
c AS (SELECT *, CASE WHEN site <> '' THEN site || regexp_replace(path, '/+\z', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical_url FROM k),
l AS (SELECT DISTINCT canonical_url AS u FROM c WHERE canonical_url IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r(says, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT c.*, list(r.h || r.p ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) FILTER (r.h IS NOT NULL) AS names, list(r.says ORDER BY length(r.h || r.p) DESC, length(r.h) DESC) FILTER (r.h IS NOT NULL) AS says
  FROM (SELECT row_number() OVER () AS i, page_id, host, path, canonical_url FROM c) c LEFT JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, canonical_url, names[1] AS rule, l.u IS NOT NULL AS listed, coalesce(says[1], CASE WHEN l.u IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN l ON l.u = b.canonical_url
"""
