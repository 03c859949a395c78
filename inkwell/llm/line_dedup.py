"""Line dedup: lines that stand in more than max_docs documents are dropped.

Lines are exploded with their position and normalised (lower case, runs of
blanks made one, trimmed); 128 bits of hash stand for each.  Distinct documents
are counted per hash, and texts are put together again without the lines over
the threshold, by position.  The counting shuffles hashes and ids alone; lines
are split once, into a table of their hashes, with which the repeated ones are
joined.  Only texts that lose a line are moved, to meet their positions.

Defined results: empty lines are never counted nor dropped.  A text that loses
all its lines becomes empty; a null text stays null.  Rows with a null doc_id
are kept unchanged and not counted.  Rows that repeat a doc_id count as one
document; where their texts differ, each keeps its own positions.  Ties don't
occur: all lines over the threshold go.  Empty tables give no rows, other
columns may have any name, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import forget, fresh, parted, written

MAX_DOCS = 10
BLANKS = "[ \\t\\r\\f]+"


def normal(line):
    return F.lower(F.trim(F.regexp_replace(line, BLANKS, " ")))


def line_dedup(docs: DataFrame, max_docs: int = MAX_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text rewritten, and n_dropped, the number of lines that went."""
    lines = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("of"), F.posexplode(F.split(docs[text], "\n")).alias("pos", "line"))
    lines = lines.select("id", "of", "pos", normal(F.col("line")).alias("line")).where("line <> ''")
    spark = docs.sparkSession
    lines = written(spark, lines.select("id", "of", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")), "lines")
    hot = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("h1", "h2")
    drop = lines.join(hot, ["h1", "h2"]).groupBy("id", "of").agg(F.collect_set("pos").alias("drop"))
    id_, of, gone, count = fresh(docs, "line_id", "line_of", "line_drop", "n_dropped")
    drop = written(spark, drop.toDF(id_, of, gone), "line-drop")
    forget(lines)
    stay, others = parted(docs, F.xxhash64(docs[key], F.xxhash64(docs[text])), drop.select(F.xxhash64(id_, of)))
    out = others.join(drop, (others[key] == drop[id_]) & (F.xxhash64(others[text]) == drop[of]), "left")
    rest = F.array_join(F.filter(F.split(others[text], "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    new = F.when(F.col(gone).isNull(), others[text]).otherwise(rest)
    same = [others[c] if c != text else new.alias(text) for c in docs.columns]
    return stay.withColumn(count, F.lit(0)).union(out.select(*same, F.coalesce(F.size(gone), F.lit(0)).alias(count)))


SQL = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
n AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g'))) AS norm FROM l),
hot AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT doc_id) > 10)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE norm NOT IN (SELECT norm FROM hot)), '') AS text,
       CAST(count(*) FILTER (WHERE norm IN (SELECT norm FROM hot)) AS INTEGER) AS n_dropped
FROM n GROUP BY doc_id
"""
