"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, jaccard, line_dedup, lm_score, pii, quality, secrets, suffix_array


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the index of those that came first, the lower half of the ids."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.repeats(docs, exact_dedup.build_index(exact_dedup.first_half(docs), exact_dedup.shards_for(docs)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_spans(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a match, with their class and number of matches."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_suffix_array": op4_suffix_array,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_lm_score": op9_lm_score,
    "op10_pii": op10_pii,
}
SQL: dict[str, str] = {
    "op2_exact_dedup": """
SELECT doc_id, winner_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS winner_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) AS t
WHERE doc_id <> winner_id""",
    "op4_suffix_array": r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS passage, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
hit AS (SELECT doc_id, i FROM win WHERE n = 50 AND passage IN (SELECT passage FROM win WHERE n = 50 GROUP BY passage HAVING count(DISTINCT doc_id) > 1)),
cut AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM hit),
span AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM cut)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word, CAST(max(i) + 50 - min(i) AS INTEGER) AS n_words FROM span GROUP BY doc_id, island""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: list_slice(w, i, i + 2))) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g AS x JOIN g AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM o JOIN s AS sa ON sa.doc_id = a JOIN s AS sb ON sb.doc_id = b WHERE 3 * c >= sa.n + sb.n),
r AS (SELECT a AS id, least(a, b) AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.id = e.a WHERE r.label < e.b)
SELECT a AS doc_id, (SELECT min(label) FROM r WHERE r.id = e.a) AS class_id, count(*) AS links FROM e GROUP BY a""",
    "op7_line_dedup": line_dedup.SQL,
}
