"""Spelling correction and type-ahead: terms that share a trigram, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

MAX_EDIT_DISTANCE = 10
CANDIDATES = 10


#: Trigrams by which terms are filtered before each is parted into its own; more of them are only joined.
LOOKED_FOR = 1000


def sharing(terms: DataFrame, unknown: DataFrame) -> DataFrame:
    """(trigram, term) of the terms that share a trigram with an unknown one, so few of many terms are joined."""
    asked = unknown.select(F.explode(F.array_distinct(X.trigrams(F.col("term")))).alias("trigram")).distinct()
    few = [r[0] for r in asked.limit(LOOKED_FOR + 1).collect()]
    if len(few) <= LOOKED_FOR:
        terms = terms.where(F.arrays_overlap(X.trigrams(F.col("term")), F.array(*map(F.lit, few)).cast("array<string>")))
    return terms.select(F.explode(F.array_distinct(X.trigrams(F.col("term")))).alias("trigram"), "term")


def corrections(unknown: DataFrame, trigrams: DataFrame, most: int = MAX_EDIT_DISTANCE, keep: int = CANDIDATES) -> DataFrame:
    """(term, is_last, candidate, dist, rank) for each distinct (term, is_last), rank from 0.

    Candidates share a trigram with the term.  One that begins with a last term
    is at distance 0; others count by edit distance, up to most.  The nearest
    come first, of those the ones of fewer bytes, then by the alphabet.

    Lengths part most pairs before the distance is computed, and pairs are made
    distinct first, so a frequent trigram costs a join row and no more.
    """
    asked = unknown.select("term", "is_last").distinct()
    grams = asked.select("term", "is_last", F.explode(F.array_distinct(X.trigrams(F.col("term")))).alias("trigram"))
    pairs = grams.join(trigrams.withColumnRenamed("term", "candidate"), "trigram")
    ahead = F.col("is_last") & F.col("candidate").startswith(F.col("term"))
    near = F.abs(F.length("candidate") - F.length("term")) <= most
    pairs = pairs.where(ahead | near).select("term", "is_last", "candidate").distinct()
    dist = F.when(ahead, F.lit(0)).otherwise(X.edit_distance(F.col("term"), F.col("candidate"), most))
    rated = pairs.withColumn("dist", dist).where(F.col("dist") >= 0)
    by = Window.partitionBy("term", "is_last").orderBy("dist", F.octet_length("candidate"), "candidate")
    # On the row number itself, so that each slice keeps its nearest before they meet by term.
    first = rated.withColumn("row", F.row_number().over(by)).where(F.col("row") <= keep)
    return first.select("term", "is_last", "candidate", "dist", (F.col("row") - 1).alias("rank"))
