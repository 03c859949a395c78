"""The inverted index as DataFrames: postings, and what derives from them.

Only the text of each field is input.  Postings follow from it by one
projection without a shuffle; vocabulary, trigrams, phonetic codes and document
frequencies follow from the postings.  An index that was built is a plan; one
that was saved is a set of tables laid out for lookups (see sources.store).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import written

FIELD_TEXT = "document_id long, field_index int, text string"
POSTINGS = "term string, document_id long, field_index int, term_index int"


def texts(docs: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """(document_id, field_index, text) of each document and field; a missing field has empty text."""
    each = [F.struct(F.lit(i).alias("field_index"), X.field_text(docs, f).alias("text")) for i, f in enumerate(fields)]
    if not each:
        return docs.sparkSession.createDataFrame([], FIELD_TEXT)
    rows = docs.where(docs[key].isNotNull()).select(docs[key].cast("long").alias("document_id"), F.explode(F.array(*each)).alias("f"))
    return rows.select("document_id", "f.field_index", "f.text")


def postings_of(field_text: DataFrame) -> DataFrame:
    """(term, document_id, field_index, term_index) of every word."""
    rows = field_text.select("document_id", "field_index", F.posexplode(X.terms(F.col("text"))).alias("term_index", "term"))
    return rows.select("term", "document_id", "field_index", "term_index")


def counted(postings: DataFrame) -> DataFrame:
    """(term, postings_len, df): in how many places and documents each term stands."""
    by_doc = postings.groupBy("term", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("term").agg(F.sum("n").alias("postings_len"), F.count(F.lit(1)).alias("df"))


def vocabulary_of(field_text: DataFrame) -> DataFrame:
    """counted of the postings of these texts.

    Texts are shuffled by document before they are cut, so the terms of each
    document, of which there are more bytes, needn't be.
    """
    return counted(postings_of(field_text.repartition("document_id")))


@dataclass(frozen=True)
class Changes:
    """What was done to a saved index: its vocabulary, the texts of each change with -1 if they went and 1 if they came, and the postings that came."""

    vocabulary: DataFrame
    texts: tuple[tuple[DataFrame, int], ...] = ()
    postings: tuple[DataFrame, ...] = ()


@dataclass(frozen=True)
class SearchIndex:
    """fields in order of preference; field_text and postings as above; stored: the vocabulary that was saved; cut: postings are those of field_text; changes: to what was saved."""

    fields: list[str]
    field_text: DataFrame
    postings: DataFrame
    stored: DataFrame | None = None
    cut: bool = False
    changes: Changes | None = None

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(term, postings_len, df): in how many places and documents each term stands."""
        if self.stored is not None:
            return self.stored
        if self.changes is not None:
            return _corrected(self.changes)
        if self.cut:
            return vocabulary_of(self.field_text)
        return counted(self.postings)

    @cached_property
    def trigrams(self) -> DataFrame:
        """(trigram, term), distinct."""
        return trigram_table(self.vocabulary)

    @property
    def terms(self) -> DataFrame:
        """(term), distinct: all that stand somewhere, and of a saved index that was changed also those that went, which are cheaper to tell apart when few are left."""
        if self.changes is None:
            return self.vocabulary.select("term")
        known = self.changes.vocabulary.select("term")
        for came in self.changes.postings:
            known = known.unionByName(came.select("term"))
        return known.distinct() if self.changes.postings else known

    @cached_property
    def soundex(self) -> DataFrame:
        """(code, term), distinct."""
        return self.vocabulary.select(X.soundex(F.col("term")).alias("code"), "term")

    @property
    def document_terms(self) -> DataFrame:
        """(document_id, term), distinct."""
        return self.postings.select("document_id", "term").distinct()


def trigram_table(vocabulary: DataFrame) -> DataFrame:
    """(trigram, term), distinct, as the terms are."""
    return vocabulary.select(F.explode(F.array_distinct(X.trigrams(F.col("term")))).alias("trigram"), "term")


def empty(spark: SparkSession, fields: list[str]) -> SearchIndex:
    return SearchIndex(fields, spark.createDataFrame([], FIELD_TEXT), spark.createDataFrame([], POSTINGS))


def build(docs: DataFrame, fields: list[str], key: str = "document_id") -> SearchIndex:
    """The index of these documents.  Ids should be distinct; rows without one are left out."""
    field_text = texts(docs, fields, key)
    return SearchIndex(list(fields), field_text, postings_of(field_text), cut=True)


def from_postings(fields: list[str], field_text: DataFrame, postings: DataFrame) -> SearchIndex:
    return SearchIndex(list(fields), field_text, postings)


def _corrected(changes: Changes) -> DataFrame:
    """The whole vocabulary after the changes: only the terms of the texts that went and came are counted."""
    both = changes.vocabulary.select("term", "postings_len", "df")
    for field_text, sign in changes.texts:
        both = both.unionByName(vocabulary_of(field_text).select("term", *((F.col(c) * sign).alias(c) for c in ("postings_len", "df"))))
    return both.groupBy("term").agg(F.sum("postings_len").alias("postings_len"), F.sum("df").alias("df")).where("postings_len > 0")


def _without(index: SearchIndex, ids: DataFrame, new: SearchIndex | None = None) -> SearchIndex:
    gone = written(ids.select(F.col(ids.columns[0]).cast("long").alias("document_id")).where("document_id is not null").distinct(), "ids-gone")
    field_text, postings = (x.join(gone, "document_id", "left_anti").select(*x.columns) for x in (index.field_text, index.postings))
    if new is not None:
        field_text, postings = field_text.unionByName(new.field_text), postings.unionByName(new.postings)
    before = Changes(index.stored) if index.stored is not None else index.changes
    if before is None:
        return SearchIndex(index.fields, field_text, postings)
    went, came = (index.field_text.join(gone, "document_id", "left_semi"), -1), [] if new is None else [new]
    changes = Changes(before.vocabulary, (*before.texts, went, *((x.field_text, 1) for x in came)), (*before.postings, *(x.postings for x in came)))
    return SearchIndex(index.fields, field_text, postings, changes=changes)


def remove(index: SearchIndex, ids: DataFrame) -> SearchIndex:
    """The index without the documents whose ids are in the first column; unknown ids change nothing.

    All that derives from postings forgets them, too: a term that no document
    has any more is neither found nor proposed.  A search counts the terms that
    it looks up in what is left; the whole vocabulary of a saved index, if it is
    asked for, is corrected by what the removed texts held.
    """
    return _without(index, ids)


def upsert(index: SearchIndex, docs: DataFrame, key: str = "document_id") -> SearchIndex:
    """The index with these documents in place of those of the same ids."""
    return _without(index, docs.select(key), build(docs, index.fields, key))
