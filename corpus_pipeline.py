"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, and further columns of docs as they are, whatever their names.

In every stage: a null text is kept by the stages that find nothing in it, and the quality rules reject it like an empty one, so it gets no
further in the whole pipeline; null languages and sources are values of their own, null doc_ids come last where the smallest one
is kept; texts of any length are worked on whole; repeated rows are copies, of which line dedup or near dedup leaves one;
ties go to the smallest doc_id, then to the smallest text hash; no rows in gives no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontaminate, line_dedup, quality, sentencepiece_codec, simhash
from loomstone.llm.common import plain, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (base rules, robust outliers)."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on several sites, and passages that stand in several documents, stay at their first place only; documents left
    without a word go. n_chars follows the new text."""
    return _recounted(line_dedup.remove_boilerplate(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, the one with the smallest doc_id.

    The SimHash operator's similarity mode: documents are linked whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
    SimHashes are compared in tiles and their links checked on the whole sets; wider fingerprints find the links beyond their radius.
    """
    return simhash.keep_one_of_each(docs, jaccard=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the spans of benchmark words are cut. n_chars follows the new text."""
    return _recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (SentencePiece token ids), n_tokens, exact (whether the ids decode to the text) and parity (whether the
    sentencepiece library gives the same ids)."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    found = sentencepiece_codec.encode(docs, keep=keep)
    size = F.coalesce(F.size("_ids"), F.lit(0)).cast("long")
    row = [F.col(f"_row.{c}").alias(c) for c in keep]
    return found.select(*row, F.col("_ids").alias("ids"), size.alias("n_tokens"), F.col("_exact").alias("exact"), F.col("_parity").alias("parity"))


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it has such a column, counted again."""
    if "n_chars" not in docs.columns:
        return docs
    bare, own = plain(docs)
    return bare.withColumn(own["n_chars"], F.length(own["text"]).cast("long")).toDF(*docs.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", tokenisation),
]

#: Robust covariance and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", docs)
    return STAGES[-1][1](spark, docs, sf_dir)
