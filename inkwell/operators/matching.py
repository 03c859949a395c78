"""Query terms to candidates, and candidates to the documents that have them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import written
from .correction import CANDIDATES, corrections, sharing
from .index import SearchIndex

MAX_ATTEMPTS = 10
#: Terms that are pushed to the scan of the postings; more of them are only joined.
PUSHED_TERMS = 1000
#: How many times more corrections are taken, at first and again, where some may have gone.
NEARER = 8


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, q_idx, term, is_last, n_terms) of queries(query_id, text)."""
    rows = queries.select("query_id", X.words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.select("query_id", F.size("words").alias("n_terms"), F.posexplode("words").alias("q_idx", "word"))
    return rows.select("query_id", "q_idx", F.lower("word").alias("term"), (F.col("q_idx") == F.col("n_terms") - 1).alias("is_last"), "n_terms")


def pushed(rows: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """The rows whose column may be among the terms, by a filter that reaches the scan if the terms are few."""
    few = [r[0] for r in terms.distinct().limit(PUSHED_TERMS + 1).collect()]
    return rows.where(F.col(column).isin(few)) if len(few) <= PUSHED_TERMS else rows


def counts(terms: DataFrame, index: SearchIndex) -> DataFrame:
    """(term, postings_len) of those among the terms that stand in some document.

    The vocabulary of a saved index that was changed would have to be corrected
    by all texts that went; the places of few terms are counted instead.
    """
    if index.changes is None:
        return pushed(index.vocabulary.select("term", "postings_len"), "term", terms)
    places = pushed(index.postings.select("term", "document_id"), "term", terms).join(terms.select("term").distinct(), "term", "left_semi")
    return places.groupBy("term").agg(F.count(F.lit(1)).alias("postings_len"))


def nearest(missed: DataFrame, index: SearchIndex) -> DataFrame:
    """(term, is_last, candidate, rank, postings_len): the corrections of these terms.

    Where terms may have gone, more than the nearest are taken, and as many
    more as it needs until enough of them still stand in some document.
    """
    grams, keep = sharing(index.terms, missed), CANDIDATES
    if index.changes is None:
        found = corrections(missed, grams)
        return found.join(index.vocabulary.select(F.col("term").alias("candidate"), "postings_len"), "candidate").select("term", "is_last", "candidate", "rank", "postings_len")
    while True:
        keep *= NEARER
        rated = written(corrections(missed, grams, keep=keep), "rated")
        live = rated.join(counts(rated.select(F.col("candidate").alias("term")), index).withColumnRenamed("term", "candidate"), "candidate", "left")
        live = written(live, "live")
        short = live.groupBy("term", "is_last").agg(F.count(F.lit(1)).alias("n"), F.count("postings_len").alias("n_live")).where((F.col("n") == keep) & (F.col("n_live") < CANDIDATES))
        if short.isEmpty():
            break
    by = Window.partitionBy("term", "is_last").orderBy("rank")
    first = live.where("postings_len is not null").withColumn("row", F.row_number().over(by)).where(F.col("row") <= CANDIDATES)
    return first.select("term", "is_last", "candidate", (F.col("row") - 1).alias("rank"), "postings_len")


def candidates(terms: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, q_idx, n_terms, rank, candidate, postings_len, corrected) for each query term.

    A term that stands in some document is its own only candidate; any other
    gets its corrections.
    """
    # Written, as what is near is looked for by the few terms that were missed.
    told = written(terms.join(counts(terms.select("term"), index), "term", "left"), "terms-told")
    exact = told.where(F.col("postings_len").isNotNull()).select("query_id", "q_idx", "n_terms", F.lit(0).alias("rank"), F.col("term").alias("candidate"), "postings_len", F.lit(False).alias("corrected"))
    missed = told.where(F.col("postings_len").isNull()).select("query_id", "q_idx", "n_terms", "term", "is_last")
    if missed.isEmpty():
        return exact
    near = missed.join(nearest(missed, index), ["term", "is_last"])
    return exact.unionByName(near.select("query_id", "q_idx", "n_terms", "rank", "candidate", "postings_len", F.lit(True).alias("corrected")))


def attempts(found: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(query_id, attempt, q_idx, n_terms, candidate, corrected): the combinations that are tried, in order.

    The first takes the best candidate of each term.  After each failure the
    term whose candidate stands in the fewest places moves on to its next; when
    it has none, the walk ends.  Which term moves depends on the counts alone:
    a term's k-th move comes when the greatest count among its first k
    candidates is the least of all terms', so the order of the moves is one
    sort, and a candidate is current from the move that brings it to the one
    that ends it.
    """
    by_term = Window.partitionBy("query_id", "q_idx").orderBy("rank")
    by_query = Window.partitionBy("query_id")
    rows = found.withColumn("most", F.max("postings_len").over(by_term.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("is_end", F.lead("rank").over(by_term).isNull())
    rows = rows.withColumn("move", F.row_number().over(by_query.orderBy("most", "q_idx", "rank")))
    rows = rows.withColumn("ends", F.min(F.when(F.col("is_end"), F.col("move"))).over(by_query))
    rows = rows.withColumn("resolved", F.size(F.collect_set("q_idx").over(by_query)))
    rows = rows.withColumn("low", F.coalesce(F.lag("move").over(by_term), F.lit(0)))
    rows = rows.withColumn("high", F.least(F.col("move") - 1, F.col("ends") - 1, F.lit(most - 1)))
    rows = rows.where((F.col("resolved") == F.col("n_terms")) & (F.col("low") <= F.col("high")))
    return rows.select("query_id", F.explode(F.sequence("low", "high")).alias("attempt"), "q_idx", "n_terms", "candidate", "corrected")


def match(tried: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame]:
    """(query_id, q_idx, term, corrected) of the first attempt that finds documents, and (query_id, document_id).

    Documents are counted by (query, attempt, document), a key that spreads
    however frequent a term is.
    """
    asked = tried.select(F.col("candidate").alias("term")).distinct()
    stands = pushed(index.postings, "term", asked).join(asked, "term", "left_semi").select("term", "document_id").distinct()
    met = tried.select("query_id", "attempt", "n_terms", F.col("candidate").alias("term")).join(stands, "term")
    whole = met.groupBy("query_id", "attempt", "document_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_terms").alias("n_terms")).where("n = n_terms")
    # The first attempts, the terms chosen, the documents and what is joined to them would each read the postings again.
    whole = written(whole.select("query_id", "attempt", "document_id"), "met")
    first = whole.groupBy("query_id").agg(F.min("attempt").alias("attempt"))
    chosen = tried.join(first, ["query_id", "attempt"]).select("query_id", "q_idx", F.col("candidate").alias("term"), "corrected")
    return chosen, whole.join(first, ["query_id", "attempt"]).select("query_id", "document_id")


def positions(chosen: DataFrame, documents: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, document_id, field_index, term_indices), positions in order and distinct."""
    asked = chosen.select("query_id", "term").distinct()
    places = pushed(index.postings, "term", asked.select("term")).join(asked, "term").join(documents, ["query_id", "document_id"], "left_semi")
    return places.groupBy("query_id", "document_id", "field_index").agg(F.sort_array(F.collect_set("term_index")).alias("term_indices"))


def intersect_documents(a: DataFrame, b: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of both whose document is in both, distinct; an empty side gives the other, as it does when folding.

    That identity holds only for sides that are known to be empty, which is
    asked once.
    """
    if a.isEmpty():
        return b.distinct()
    if b.isEmpty():
        return a.distinct()
    return a.join(b.select(key).distinct(), key, "left_semi").unionByName(b.join(a.select(key).distinct(), key, "left_semi")).distinct()


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that are in both, distinct."""
    return a.intersect(b)
