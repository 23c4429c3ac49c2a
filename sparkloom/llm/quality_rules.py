"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much go.

Only DataFrame functions; every step works inside a row, so no task ever holds more than one text.

Defined cases: a null or empty text has no words and fails the base rule; a loss of max_loss_percent exactly is
kept; a null doc_id is carried as it is; a text of any length is one row, at some 40 bytes of memory a word. Repeated rows give repeated rows; nothing is ranked, so there are no ties.
Columns of the input with the names of this operator's results are left out; others are not carried. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import spread, table

#: White space between words, symbols, ends of sentences, and phrases of boilerplate.
SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
#: A line ends as a sentence does, or has a sentence mark inside (a passage that was cut off).
ENDS = r"[.!?…:;。！？\"'”’»)\]][ \t-\r]*$|[.,;!?…] "
SHOUTS = r"(?<![!?])([!?]{2,}+[^!?]++){3}"  # from the start of a run on and without backtracking, so in linear time
MENU = r"([|»›•][^|»›•]*){3}"
BOILERPLATE = (
    r"(?i)all rights reserved|privacy policy|terms of (use|service)|use of cookies|accepts? cookies|enable javascript"
    r"|lorem ipsum|click here|subscribe to|licen[sc]ed under|released under|copyright ©"
)
#: Low bits of a packed window key that hold its position.
POSITION_BITS = 24


def _word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_passes(line: Column) -> Column:
    """Whether a line stays: punctuation, navigation and boilerplate rules. A line without a word stays."""
    symbols = F.length(F.regexp_replace(line, NOT_SYMBOLS, ""))
    punctuation = line.rlike(ENDS) & ~line.rlike(SHOUTS) & ~((symbols >= 3) & (symbols * 20 > F.length(line)))
    return ~line.rlike(r"[^ \t-\r]") | (punctuation & ~line.rlike(MENU) & ~line.rlike(BOILERPLATE))


def clean(docs: DataFrame, max_loss_percent: int = 30, min_words: int = 50) -> DataFrame:
    """One row a document: base counts, counts of lines, the text without failing lines, and the verdict.

    A document is kept if it passes the base rule and its failing lines hold at most max_loss_percent of
    its words.

    Words inside 3-word windows that occur twice or more are counted so: windows become 64-bit keys, the
    high bits a hash and the low bits the position, and one primitive sort brings equal windows together
    with their positions. Neighbours of equal high bits are compared as words; if a pair differs (a
    collision), or a text outgrows the position bits, the row takes the path of whole strings instead."""
    mask = (1 << POSITION_BITS) - 1
    word = lambda i: F.get("_words", i)
    window = lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2))
    starts = F.sequence(F.lit(0), F.col("_n") - 3)
    high = lambda j: F.shiftrightunsigned(F.get("_keys", j), POSITION_BITS)
    low = lambda j: F.get("_keys", j).bitwiseAND(F.lit(mask)).cast("int")
    whole = lambda j, f: F.get("_whole", j)[f]
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    df = df.select("doc_id", "_text", _word_list(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_lines"))
    df = df.select(
        "*",
        F.size("_words").alias("_n"),
        F.filter("_lines", lambda x: x.rlike(r"[^ \t-\r]")).alias("_worded"),
        F.filter("_lines", line_passes).alias("_passed"),
    )
    df = df.select(
        "*",
        F.when(
            F.col("_n") >= 4,
            F.sort_array(F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))),
        ).alias("_keys"),
    )
    df = df.select(
        "*",
        F.when(F.col("_n") >= 4, F.filter(F.sequence(F.lit(1), F.col("_n") - 3), lambda j: high(j) == high(j - 1))).alias("_same"),
    )
    collided = (F.col("_n") >= mask) | F.exists("_same", lambda j: window(low(j)) != window(low(j - 1)))
    df = df.select(
        *[c for c in df.columns if c != "_keys"],
        "_keys",
        F.when((F.col("_n") >= 4) & collided, F.array_sort(F.transform(starts, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))).alias("_whole"),
    )
    pairs = F.when(
        F.col("_whole").isNotNull(),
        F.transform(
            F.filter(F.sequence(F.lit(1), F.col("_n") - 3), lambda j: whole(j, "w") == whole(j - 1, "w")),
            lambda j: F.array(whole(j - 1, "i"), whole(j, "i")),
        ),
    ).otherwise(F.transform("_same", lambda j: F.array(low(j - 1), low(j))))
    df = df.select(
        "doc_id", "_text", "_n", "_lines", "_worded", "_passed", F.array_sort(F.array_distinct(F.flatten(pairs))).alias("_spots"), F.array_join("_passed", "\n").alias("clean_text")
    )
    covered = F.aggregate(
        F.transform("_spots", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_spots", i + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    df = df.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_passed")).cast("long").alias("n_failed_lines"),
        F.size(_word_list(F.col("clean_text"))).cast("long").alias("n_clean_words"),
        "clean_text",
    )
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    loss = (F.col("n_words") - F.col("n_clean_words")) * 100 > F.col("n_words") * max_loss_percent
    return df.withColumns({"base_failed": base}).withColumn("kept", ~(F.col("base_failed") | loss))


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "n_clean_words"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(spread(docs, "doc_id")).select(*DIGEST)


#: The same rules for DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT r, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM w),
g AS (SELECT r, i, x, NOT regexp_matches(x, '[^ \t-\r]') AS blank,
  length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS sy FROM l),
p AS (SELECT *, blank OR (regexp_matches(x, '[.!?…:;。！？"''”’»)\]][ \t-\r]*$|[.,;!?…] ') AND NOT regexp_matches(x, '([!?]{2,}[^!?]+){3}')
  AND NOT (sy >= 3 AND sy * 20 > length(x)) AND NOT regexp_matches(x, '([|»›•][^|»›•]*){3}')
  AND NOT regexp_matches(x, '(?i)all rights reserved|privacy policy|terms of (use|service)|use of cookies|accepts? cookies|enable javascript|lorem ipsum|click here|subscribe to|licen[sc]ed under|released under|copyright ©')) AS ok FROM g),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (NOT ok) AS n_failed_lines,
  count(*) FILTER (NOT blank) - count(DISTINCT CASE WHEN NOT blank THEN x END) AS n_dup_lines,
  coalesce(sum(CASE WHEN ok THEN len(list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda y: y <> '')) END), 0) AS n_clean_words FROM p GROUP BY r),
k AS (SELECT r, len(ws) AS n, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM k),
v AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM (SELECT r, i, unnest([0, 1, 2]) AS o FROM q WHERE c > 1) GROUP BY r),
z AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, n_clean_words::BIGINT AS n_clean_words
  FROM w JOIN a USING (r) LEFT JOIN v USING (r)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM z)
SELECT *, NOT (base_failed OR (n_words - n_clean_words) * 100 > n_words * 30) AS kept FROM b
"""
