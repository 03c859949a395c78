"""The corpus pipeline: documents in, token ids of what is worth keeping out.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and
returns those that it keeps, with the columns of documents; the last returns
the token ids of each text.  Stages are written as Parquet and read again, so
a lost executor costs no more than the stage that runs.

In all stages: an empty table gives an empty one, extra columns stay whatever
their names, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from inkwell.llm.kernel import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null texts go; texts without tokens stay, and so do all texts where labels of
    both classes are missing.  Repeated rows and ties at the border stay or go
    together; rows with a null doc_id are judged like others.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of documents with the same text, the least doc_id.

    The index is of the first half of the ids, the others are looked up in it.
    Rows with a null doc_id or text stay; empty texts are copies of one another;
    of rows that repeat doc_id and text one stays.
    """
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents connected by similar pairs, the least doc_id.

    Rows with a null doc_id or text and texts without words stay.  Rows that
    repeat a doc_id stay or go together.  Pairs exactly at the threshold count.
    """
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark item stands.

    Null and empty texts stay, and null or empty items match nothing; rows with a
    null doc_id are judged like others, repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of each document, a row for each row.

    A null text has null ids, an empty one none; a null doc_id stays null.
    """
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenise),
]
#: SQL can express neither the classifier nor BPE; tests/llm/test_pipeline.py holds all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(spark, docs, f"stage-{k}")
    return docs
