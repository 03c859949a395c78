"""Free-text conjunctive search: a batch of queries against an index, as one plan.

All terms of a query must stand in a document, in whatever field.  There is no
ranking and no limit; hits are in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import SearchIndex
from ..operators.matching import attempts, candidates, match, positions, query_terms
from ..operators.snippets import with_snippets
from ..sources.tables import written

SNIPPET = "struct<term_indices: array<int>, body: string>"
HIT = f"struct<document_id: bigint, fields: map<int, string>, field_snippets: map<int, {SNIPPET}>>"


def _resolved(queries: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Query terms, those that were searched for, and the documents that have them.

    The few rows of terms and attempts are written, so the vocabulary and the
    trigrams are read once, and the scans of postings get their terms pushed.
    """
    terms = query_terms(queries)
    chosen, documents = match(written(attempts(candidates(terms, index)), "attempts"), index)
    return terms, written(chosen, "chosen"), documents


def search_documents(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, document_id) of each hit."""
    return _resolved(queries, index)[2]


def search_hits(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, document_id, field_index, term_indices, body), a row for each field of each hit.

    The form for results of any size: nothing is gathered by query.
    """
    _, chosen, documents = _resolved(queries, index)
    return with_snippets(positions(chosen, documents, index), index.field_text)


def query_outcomes(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, spelling_correction, query_terms, n_hits) of each query.

    query_terms are those that were searched for: the corrected ones where that
    found something, else those of the query.
    """
    terms, chosen, documents = _resolved(queries, index)
    return _outcomes(queries, terms, chosen).join(documents.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits")), "query_id", "left").select("query_id", "spelling_correction", "query_terms", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "term"))), lambda x: x["term"]).alias("terms"), F.max("corrected").alias("corrected"))


def _outcomes(queries: DataFrame, terms: DataFrame, chosen: DataFrame) -> DataFrame:
    asked = _in_order(terms.withColumn("corrected", F.lit(False))).withColumnRenamed("terms", "asked").drop("corrected")
    found = _in_order(chosen)
    rows = queries.select("query_id").join(asked, "query_id", "left").join(found, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.coalesce("corrected", F.lit(False)).alias("spelling_correction"), F.coalesce("terms", "asked", none).alias("query_terms"))


def search(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, spelling_correction, query_terms, hits), a row for each query(query_id, text).

    A hit has the names of the fields that matched and their snippets, by the
    index of the field.  An empty or null query, one with a term that nothing
    resembles, and one whose terms no document has together have no hits.
    """
    terms, chosen, documents = _resolved(queries, index)
    rows = with_snippets(positions(chosen, documents, index), index.field_text)
    name = F.element_at(F.array(*map(F.lit, index.fields)) if index.fields else F.array(F.lit("")), F.col("field_index") + 1)
    snippet = F.struct("term_indices", "body")
    of_doc = rows.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("field_index", name.alias("field"), snippet.alias("snippet")))).alias("f"))
    hit = F.struct(
        "document_id",
        F.map_from_entries(F.transform("f", lambda x: F.struct(x["field_index"], x["field"]))).alias("fields"),
        F.map_from_entries(F.transform("f", lambda x: F.struct(x["field_index"], x["snippet"]))).alias("field_snippets"),
    )
    by_id = lambda a, b: F.when(a["document_id"] < b["document_id"], -1).when(a["document_id"] > b["document_id"], 1).otherwise(0)
    hits = of_doc.select("query_id", hit.alias("hit")).groupBy("query_id").agg(F.array_sort(F.collect_list("hit"), by_id).alias("hits"))
    out = _outcomes(queries, terms, chosen).join(hits, "query_id", "left")
    return out.select("query_id", "spelling_correction", "query_terms", F.coalesce("hits", F.array().cast(f"array<{HIT}>")).alias("hits"))


def as_json(results: DataFrame) -> DataFrame:
    """(query_id, json) of search results; map keys become strings."""
    return results.select("query_id", F.to_json(F.struct("spelling_correction", "query_terms", "hits")).alias("json"))


def messages(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, messages): the lines that stand over the results of each query(query_id, text)."""
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.size("hits")
    nothing = F.concat(F.lit("No hits found for query: "), F.col("text"))
    instead = F.concat(F.lit("Searching instead for: "), F.array_join("query_terms", " "))
    found = F.concat(F.lit("Found "), n.cast("string"), F.when(n == 1, F.lit(" result.")).otherwise(F.lit(" results.")))
    lines = F.when(F.length("text") == 0, F.array(F.lit("Type a search."))).when(n == 0, F.array(nothing)).when(F.col("spelling_correction"), F.array(nothing, instead, found)).otherwise(F.array(found))
    return results.join(asked, "query_id").select("query_id", lines.alias("messages"))


def result_list(results: DataFrame) -> DataFrame:
    """(query_id, place, title, field_results): a row for each hit in order, with name and snippet of its fields in theirs."""
    rows = results.select("query_id", F.posexplode("hits").alias("place", "hit"))
    by_field = F.array_sort(F.map_entries("hit.fields"), lambda a, b: a["key"] - b["key"])
    fields = F.transform(by_field, lambda f: F.struct(f["value"].alias("field_name"), F.element_at(F.col("hit.field_snippets"), f["key"])["body"].alias("snippet")))
    return rows.select("query_id", "place", F.concat(F.lit("Document ID "), F.col("hit.document_id").cast("string")).alias("title"), fields.alias("field_results"))


def search_one(spark: SparkSession, index: SearchIndex, query: str | None) -> DataFrame:
    """The result of one query, one row."""
    if query is None:
        raise ValueError("query required")
    return search(spark.createDataFrame([(0, query)], "query_id long, text string"), index).drop("query_id")
