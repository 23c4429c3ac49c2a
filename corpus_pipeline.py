"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

All but the last stage return the columns of their input. Columns beside doc_id and text travel packed in one
struct, so none of their names can clash with an operator's. Where a stage changes a text, n_chars (if there is
such a column) is counted anew.

Defined cases: a null text counts as empty in every stage and stays null up to the last, which encodes it as empty; empty
and null texts are in no group of near copies. Rows of a null doc_id are judged, cut and encoded like others and are never
duplicates. Repeated rows of one doc_id are one document: its rows all stay or all go. Of a group of near copies the
smallest doc_id stays. Nulls in other columns are carried. Texts are never shortened; a very long one is a task's largest
batch, at the memory that the operators state. Empty tables of documents, labels or test items give an empty result, a
model that keeps what the one known grade says, and unchanged texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import fm_index, lsh_forest, ordinal, pii, sp_sample
from sparkloom.llm.base import materialize, spread, table

REST = "_rest"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one struct."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias(REST))


def _unpacked(df: DataFrame, docs: DataFrame, changed=None) -> DataFrame:
    """The columns of docs again; changed tells where n_chars is to be counted anew."""

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        own = F.col(REST)[c]
        if c == "n_chars" and changed is not None:
            own = F.when(changed, F.length("text").cast("long")).otherwise(own)
        return own.alias(c)

    return df.select(*[column(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a good grade is high enough; what the classifier rejects goes."""
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    scored = ordinal.score(spread(_packed(docs), "doc_id"), model, carry=["text", REST])
    return _unpacked(scored.where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; all of those without an id."""
    kept = lsh_forest.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items; clean documents stay as they are."""
    cut = fm_index.cut(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(cut, docs, F.col("was_cut"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each personal span replaced by its kind."""
    found = pii.find_pii(spread(_packed(docs), "doc_id"), carry=[REST], redact=True)
    return _unpacked(found.withColumn("text", F.col("redacted_text")), docs, F.col("n_spans") > 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each text, with their inclusion scores."""
    return sp_sample.encode(spread(docs.select("doc_id", "text"), "doc_id"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", privacy),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the tagger nor the sampler.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
