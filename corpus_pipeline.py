"""Corpus preparation: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import exactdup, neardup, packing, pii, toxicity
from linkwright.llm.queries import vocabulary
from linkwright.llm.runtime import documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more go. Null and empty texts stay, rows that repeat are judged each, an empty table stays empty."""
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty, A-Z folded) the row with the largest doc_id stays; of rows that repeat both, one. An empty table
    stays empty."""
    return exactdup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id. Rows without doc_id or words stay, and so do all rows of a
    doc_id that stays. An empty table stays empty."""
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` becomes [KIND], n_chars is counted anew. No row goes; null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its token ids and place in a sequence; a null or empty text is one piece with the end id."""
    return packing.pack(docs, vocabulary(packing.VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("pii", redact), ("packing", pack)]

#: Scores, similarities and tokens can't be had in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
