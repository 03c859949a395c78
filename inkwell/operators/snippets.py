"""Snippets: the words around the hits of a field, hits marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WINDOW = 10
OPEN, CLOSE = "<em>", "</em>"


def body(words: Column, gaps: Column, spaced: Column, hits: Column, window: int = WINDOW) -> Column:
    """The snippet of a text, of its words, the gaps before them, both together, and the sorted positions of its hits.

    A word is shown within the window of some hit.  Shown neighbours keep what
    stands between them; elsewhere stands " ... ", in front "... ".  A last word
    that alone is hidden goes without a mark, more of them leave " ...".
    Nothing is escaped.

    Each hit brings what stands between it and the one before, and the last the
    words after it, so every word that is shown is touched once.
    """
    def run(first: Column, end: Column) -> Column:
        """Words first to end - 1, from 0, with the gaps before them."""
        return F.array_join(F.slice(spaced, first + 1, F.greatest(end - first, F.lit(0))), "")

    def apart(first: Column, hit: Column) -> Column:
        """Words first to hit - 1 without the gap in front, and the gap before the hit."""
        return F.when(first < hit, F.concat(F.element_at(words, first + 1), run(first + 1, hit), F.element_at(gaps, hit + 1))).otherwise(F.lit(""))

    def piece(hit: Column, k: Column) -> Column:
        before = F.element_at(hits, F.greatest(k, F.lit(1)))
        first = F.greatest(hit - window, F.lit(0))
        start = F.concat(F.when(first > 0, F.lit("... ")).otherwise(F.lit("")), apart(first, hit))
        near = F.concat(run(before + 1, hit), F.element_at(gaps, hit + 1))
        far = F.concat(run(before + 1, before + 1 + window), F.lit(" ... "), apart(first, hit))
        lead = F.when(k == 0, start).when(first <= before + window + 1, near).otherwise(far)
        return F.concat(lead, F.lit(OPEN), F.element_at(words, hit + 1), F.lit(CLOSE))

    last = F.element_at(hits, -1)
    end = F.when(last + window + 2 < F.size(words), F.lit(" ...")).otherwise(F.lit(""))
    return F.concat(F.array_join(F.transform(hits, piece), ""), run(last + 1, F.least(last + 1 + window, F.size(words))), end)


def with_snippets(hits: DataFrame, field_text: DataFrame, window: int = WINDOW) -> DataFrame:
    """hits(query_id, document_id, field_index, term_indices) with body.

    Only the fields that have hits are cut into words.  Words and gaps, and both
    together, pass a generator before they are used, so each text meets the
    regular expression once a row and not once a word or a hit.
    """
    rows = hits.join(field_text, ["document_id", "field_index"])
    cut = rows.select("query_id", "document_id", "field_index", "term_indices", F.explode(F.array(F.struct(X.words(F.col("text")).alias("words"), X.gaps(F.col("text")).alias("gaps")))).alias("c"))
    both = F.explode(F.array(F.zip_with("c.words", "c.gaps", lambda w, g: F.concat(g, w)))).alias("spaced")
    cut = cut.select("query_id", "document_id", "field_index", "term_indices", "c", both)
    return cut.select("query_id", "document_id", "field_index", "term_indices", body(F.col("c.words"), F.col("c.gaps"), F.col("spaced"), F.col("term_indices"), window).alias("body"))
