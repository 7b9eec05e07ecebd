"""A corpus cleaned and packed in stages, each one reading all that its predecessor kept.

Every stage takes `(spark, docs, sf_dir)`; all but the last return the columns of `documents`. Results are
written as Parquet and read again between stages, so a stage survives lost executors and none is recomputed.
Columns of the caller's that are named like one of an operator's own come through unchanged; very long texts pass
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, carried, materialize, table, without
from tidemark.llm.decontamination import decontaminate as mark_benchmark_words
from tidemark.llm.lines import dedup_lines
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import packed_pieces
from tidemark.llm.quality import classify

#: Similarity of shingle sets, in per cent, from which on documents are one.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither low in quality nor toxic.

    Null and empty texts, null sources and languages are judged like others (by their site and length); without
    labels all are kept; repeated rows are judged alike; an empty table stays empty.
    """
    bounded(spark)
    narrow, restored = carried(docs, "doc_id", "text")
    sites = narrow.withColumns({"host": F.col("carried.source").cast("string"), "path": F.col("carried.lang").cast("string")})
    return restored(classify(sites, table(spark, sf_dir, "labels")).where("keep"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, and their new `n_chars`; a document of nothing else goes.

    A null text stays null and an empty one empty, and both are kept; a row without id is kept as it is; of repeated
    rows each keeps the same lines; an empty table stays empty.
    """
    bounded(spark)
    narrow, restored = carried(docs, "doc_id", "text", "n_chars")
    found = dedup_lines(narrow)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return restored(found.where(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows of one id go together.

    Null and empty texts and rows without id are no duplicates and are kept; an empty table stays empty.
    """
    bounded(spark)
    narrow, restored = carried(docs, "doc_id", "text")
    kept = near_duplicates(narrow, NEAR_PERCENT).where("doc_id is not null")
    gone = materialize(kept.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "gone")
    return restored(without(narrow, gone, "doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and are kept; an empty benchmark leaves all; repeated rows are judged alike; an
    empty table stays empty.
    """
    bounded(spark)
    narrow, restored = carried(docs, "doc_id", "text")
    return restored(mark_benchmark_words(narrow, table(spark, sf_dir, "benchmark")).where(F.size("hit_words") == 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left.

    A null or empty text is its end token; a null source is the queue of the empty name; rows of one id are documents
    of their own; an empty table gives no pieces.
    """
    bounded(spark)
    return packed_pieces(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Several stages (trained classifiers, tokenizers) are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
