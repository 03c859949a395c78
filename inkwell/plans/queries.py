"""The registered queries of the search engine, each with its SQL.

All run over whole tables.  Lookups and searches go to an index that is saved
in the shared folder once for each state of the tables, as an engine's user would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import index as I
from ..operators import matching, ordered_map
from ..operators.correction import corrections, sharing
from ..sources import demo, store
from ..sources.tables import shared_folder, table, version
from . import search as S

EXACT = [(1, "the THIS"), (2, "queen entre"), (3, "Tioning Lement"), (4, "blend"), (5, "pathetic verst thater"), (6, "the"), (7, ""), (8, "erver das")]
CORRECTED = [(1, "blendd tioning"), (2, "thetionx wh"), (3, "pathetik"), (4, "zzzzqqqq the"), (5, "lementt entr"), (6, "einberx geheitt"), (7, "thlyntt thndlyx"), (8, "erverr quee"), (9, "the blen"), (10, "5")]
TALKED = [(1, "user blend"), (2, "blendd"), (3, ""), (4, "qqzzqq blend"), (5, "user tioning")]
LOOKED_UP = ["blend", "pathetic", "einber", "queen"]
SPELLED = [(1, "blendd", False), (2, "patheti", True), (3, "tionsing", False), (4, "quee", True), (5, "einberr", False), (6, "thx", True)]

_SAVED: dict[tuple[str, str, str], str] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as documents of two fields."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), "role", "text")


def saved(spark: SparkSession, sf_dir: str, name: str, docs: Callable[[SparkSession, str], DataFrame], fields: list[str]) -> I.SearchIndex:
    """The index of a table, saved when it is first asked for, and again when the table has changed."""
    at = (spark.sparkContext.applicationId, name, version(spark, sf_dir, name))
    if at not in _SAVED:
        path = f"{shared_folder(spark)}/index-{name}-{at[2]}-{at[0]}"
        store.save(I.build(docs(spark, sf_dir), fields), path)
        _SAVED[at] = path
    return store.load(spark, _SAVED[at], fields)


def documents_index(spark: SparkSession, sf_dir: str) -> I.SearchIndex:
    return saved(spark, sf_dir, "documents", corpus, ["text"])


def talks_index(spark: SparkSession, sf_dir: str) -> I.SearchIndex:
    return saved(spark, sf_dir, "conversations", talks, ["role", "text"])


def asked(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(queries, "query_id long, text string")


def flat_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "document_id", "field_index", F.array_join(F.col("term_indices").cast("array<string>"), ",").alias("term_indices"), "body")


def flat_outcomes(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "spelling_correction", F.array_join("query_terms", " ").alias("query_terms"), "n_hits")


# -- the queries


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.postings_of(I.texts(corpus(spark, sf_dir), ["text"])).select("document_id", "term_index", "term")


def term_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each document as one string."""
    return corpus(spark, sf_dir).select("document_id", F.array_join(X.terms(F.col("text")), " ").alias("terms"))


def demo_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the corpus to try the engine on, which no table has."""
    return I.build(demo.documents(spark), demo.FIELDS).postings


def postings_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(corpus(spark, sf_dir), ["text"]).postings


def df_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(corpus(spark, sf_dir), ["text"]).vocabulary


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(talks(spark, sf_dir), ["role", "text"]).document_terms


def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).trigrams


def trigram_terms_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).trigrams.where("trigram = 'ble'").select("term")


def soundex_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).soundex


def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each term of the documents to a few words."""
    words = F.explode(F.array(*map(F.lit, LOOKED_UP))).alias("word")
    return documents_index(spark, sf_dir).vocabulary.select("term", words).select("word", "term", X.edit_distance(F.col("word"), F.col("term")).alias("dist"))


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_documents(asked(spark, EXACT), documents_index(spark, sf_dir))


def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_outcomes(S.query_outcomes(asked(spark, EXACT), documents_index(spark, sf_dir)))


def corrected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_outcomes(S.query_outcomes(asked(spark, CORRECTED), documents_index(spark, sf_dir)))


def corrected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_documents(asked(spark, CORRECTED), documents_index(spark, sf_dir))


def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = spark.createDataFrame([(w, last) for _, w, last in SPELLED], "term string, is_last boolean")
    return corrections(unknown, sharing(documents_index(spark, sf_dir).terms, unknown))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every query, the one for a term that most documents have included."""
    return flat_hits(S.search_hits(asked(spark, EXACT), documents_index(spark, sf_dir)))


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_hits(S.search_hits(asked(spark, [(1, "user the"), (2, "Assistant la"), (3, "user blend")]), talks_index(spark, sf_dir)))


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.as_json(S.search(asked(spark, TALKED), talks_index(spark, sf_dir)))


def search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, TALKED)
    told = S.messages(S.search(queries, talks_index(spark, sf_dir)), queries)
    return told.select("query_id", F.array_join("messages", " / ").alias("messages"))


def search_result_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits as a page lists them, with their places."""
    rows = S.result_list(S.search(asked(spark, TALKED), talks_index(spark, sf_dir)))
    fields = F.array_join(F.transform("field_results", lambda f: F.concat(f["field_name"], F.lit(": "), f["snippet"])), " | ")
    return rows.select("query_id", "place", "title", fields.alias("fields"))


def search_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to one query, as it goes over the wire."""
    found = S.search_one(spark, talks_index(spark, sf_dir), TALKED[0][1])
    return S.as_json(found.withColumn("query_id", F.lit(TALKED[0][0]).cast("long"))).select("json")


def empty_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_outcomes(S.query_outcomes(asked(spark, EXACT), I.empty(spark, ["text"])))


def remove_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    gone = corpus(spark, sf_dir).where("lang = 'en'").select("document_id")
    return S.search_documents(asked(spark, EXACT), I.remove(index, gone))


def upsert_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    new = corpus(spark, sf_dir).where("lang = 'en'").select("document_id", F.concat(F.lit("Renewed queen: "), "lang", F.lit(" "), "source").alias("text"))
    return flat_hits(S.search_hits(asked(spark, [(1, "renewed queen"), (2, "blend")]), I.upsert(index, new)))


def postings_of_term(spark: SparkSession, sf_dir: str, term: str) -> DataFrame:
    return documents_index(spark, sf_dir).postings.where(F.col("term") == term).select("document_id", "field_index", "term_index")


def intersect_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.intersect_documents(postings_of_term(spark, sf_dir, "the"), postings_of_term(spark, sf_dir, "blend"))


def intersect_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that stand both in documents and in conversations, by all columns of the rows."""
    said = talks_index(spark, sf_dir).vocabulary.select("term")
    return matching.intersect_rows(documents_index(spark, sf_dir).vocabulary.select("term"), said)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).vocabulary.select(F.col("term").alias("key"), F.col("df").cast("string").alias("value"))


def map_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_map.get(entries(spark, sf_dir), "blend")


def map_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("blend", "replaced"), ("blended-in", "added")], "key string, value string")
    return ordered_map.put(entries(spark, sf_dir), new)


def map_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return spark.createDataFrame([(ordered_map.length(rows), ordered_map.is_empty(rows))], "length long, is_empty boolean")


def map_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value changed where it is, and a key that isn't there."""
    changed = ordered_map.update(entries(spark, sf_dir), "blend", F.concat("value", F.lit(" times")))
    return ordered_map.update(changed, "unknown key", F.lit("nothing"))


def map_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_map.remove(entries(spark, sf_dir), spark.createDataFrame([("blend",), ("unknown key",)], "key string"))


def map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_map.scan(entries(spark, sf_dir))


def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_map.scan_prefix(entries(spark, sf_dir), "ble")


def range_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_map.scan_from(entries(spark, sf_dir), "queen")


def json_field_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a nested column: the turns of each conversation, structures with a role and a text."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("text", "role").alias("said")))), lambda x: x["said"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select("conv_id", X.field_text(rows, "turns").alias("text"))


def raw_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of JSON strings."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("text", "role").alias("said")))), lambda x: x["said"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("json"))
    return rows.select("conv_id", X.json_field_text(F.col("json"), "turns").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize, term_strings, demo_postings, postings_by_term, df_by_term, document_terms, trigram_index, trigram_terms_for, soundex_terms, edit_distance_pairs,
        exact_search, search_outcomes, corrected_search, corrected_documents, spelling_candidates, snippets, conversation_search, search_json, search_messages, search_result_list, search_get, empty_index_search,
        remove_then_search, upsert_then_search, intersect_prefix, intersect_full, map_get, map_put, map_length, map_update, map_remove, map_scan, prefix_scan,
        range_scan_from, json_field_text, raw_json_text,
    )
}


# -- their SQL

_W = X.WORD.replace("'", "''")
_TEXTS = {
    "documents": "field_text AS (SELECT doc_id AS document_id, CAST(0 AS INTEGER) AS field_index, text FROM documents)",
    "conversations": "field_text AS (SELECT conv_id * 1000 + turn AS document_id, CAST(0 AS INTEGER) AS field_index, role AS text FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 1, text FROM conversations)",
}
_TOK = f"tok AS (SELECT document_id, field_index, CAST(i AS INTEGER) AS term_index, lower(w) AS term, w AS word, g AS gap FROM (SELECT document_id, field_index, unnest(ws) AS w, unnest(range(len(ws))) AS i, unnest(gs[1:len(ws)]) AS g FROM (SELECT document_id, field_index, regexp_extract_all(text, '{_W}') AS ws, string_split_regex(text, '{_W}') AS gs FROM field_text)))"
_VOCAB = "vocab AS (SELECT term, count(*) AS postings_len, count(DISTINCT document_id) AS df FROM tok GROUP BY term)"
_TRI = "SELECT DISTINCT trigram, term FROM (SELECT term, unnest(list_transform(range(1, length(term) + 1), lambda i: substr('$' || term || '$', i, 3))) AS trigram FROM {0})"


def _distance(a: str, b: str) -> str:
    """Of characters, where DuckDB counts bytes: terms have no capitals, which stand in for accented letters."""
    one = lambda x: f"translate({x}, 'ßäçèéêíñóöüàâáëìîïòôùûúœæå', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    return f"levenshtein({one(a)}, {one(b)})"


def _asked(queries: list[tuple[int, str]]) -> str:
    values = ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, t in queries)
    return f"q(query_id, text) AS (VALUES {values}), qt AS (SELECT query_id, lower(w) AS term, CAST(i AS INTEGER) AS q_idx, n AS n_terms, i = n - 1 AS is_last FROM (SELECT query_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM (SELECT query_id, regexp_extract_all(text, '{_W}') AS ws FROM q)))"


#: Candidates of every term, the walk by moves, and the first attempt with documents.
_WALK = f"""{_VOCAB}, missed AS (SELECT DISTINCT term, is_last FROM qt WHERE term NOT IN (SELECT term FROM vocab)),
grams AS ({_TRI.format("vocab")}), asked_grams AS ({_TRI.format("missed")}),
pairs AS (SELECT DISTINCT m.term, m.is_last, g.term AS candidate FROM missed m JOIN asked_grams a ON a.term = m.term JOIN grams g ON g.trigram = a.trigram),
rated AS (SELECT *, CASE WHEN is_last AND starts_with(candidate, term) THEN 0 ELSE {_distance('term', 'candidate')} END AS dist FROM pairs),
corr AS (SELECT term, is_last, candidate, dist, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term, is_last ORDER BY dist, strlen(candidate), candidate) AS rn FROM rated WHERE dist <= 10) WHERE rn <= 10),
cand AS (SELECT query_id, q_idx, n_terms, 0 AS rank, qt.term AS candidate, postings_len, false AS corrected FROM qt JOIN vocab USING (term)
  UNION ALL SELECT query_id, q_idx, n_terms, c.rank, c.candidate, v.postings_len, true FROM qt JOIN corr c ON c.term = qt.term AND c.is_last = qt.is_last JOIN vocab v ON v.term = c.candidate),
w1 AS (SELECT *, max(postings_len) OVER (PARTITION BY query_id, q_idx ORDER BY rank ROWS UNBOUNDED PRECEDING) AS most, lead(rank) OVER (PARTITION BY query_id, q_idx ORDER BY rank) IS NULL AS is_end FROM cand),
w2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY most, q_idx, rank) AS move FROM w1),
w3 AS (SELECT *, min(move) FILTER (WHERE is_end) OVER (PARTITION BY query_id) AS ends FROM w2),
att AS (SELECT query_id, unnest(range(0, least(ends, 10))) AS attempt FROM (SELECT DISTINCT query_id, ends FROM w3)),
rk AS (SELECT a.query_id, a.attempt, w.q_idx, count(*) FILTER (WHERE w.move <= a.attempt) AS rank FROM att a JOIN w3 w USING (query_id) GROUP BY ALL),
tried AS (SELECT r.query_id, r.attempt, r.q_idx, c.candidate AS term, c.n_terms, c.corrected FROM rk r JOIN cand c ON c.query_id = r.query_id AND c.q_idx = r.q_idx AND c.rank = r.rank),
met AS (SELECT query_id, attempt, document_id FROM tried JOIN (SELECT DISTINCT term, document_id FROM tok) USING (term) GROUP BY query_id, attempt, document_id HAVING count(DISTINCT q_idx) = max(n_terms)),
best AS (SELECT query_id, min(attempt) AS attempt FROM met GROUP BY query_id),
docs AS (SELECT query_id, document_id FROM met JOIN best USING (query_id, attempt)),
chosen AS (SELECT query_id, q_idx, term, corrected FROM tried JOIN best USING (query_id, attempt))"""
_OUTCOMES = """SELECT q.query_id, coalesce(c.corrected, false) AS spelling_correction, coalesce(c.terms, o.terms, '') AS query_terms, coalesce(n.n, 0) AS n_hits FROM q
LEFT JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY q_idx) AS terms, bool_or(corrected) AS corrected FROM chosen GROUP BY query_id) c USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY q_idx) AS terms FROM qt GROUP BY query_id) o USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM docs GROUP BY query_id) n USING (query_id)"""
_HITS = """marked AS (SELECT s.query_id, s.document_id, t.field_index, t.term_index, t.word, t.gap, t.term IN (SELECT term FROM chosen c WHERE c.query_id = s.query_id) AS hit FROM docs s JOIN tok t USING (document_id)),
framed AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY query_id, document_id, field_index ORDER BY term_index ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) > 0 AS seen, count(*) OVER (PARTITION BY query_id, document_id, field_index) AS n FROM marked),
pieces AS (SELECT *, lag(term_index) OVER (PARTITION BY query_id, document_id, field_index ORDER BY term_index) AS before FROM framed WHERE seen)
SELECT query_id, document_id, field_index, string_agg(term_index, ',' ORDER BY term_index) FILTER (WHERE hit) AS term_indices,
  string_agg(CASE WHEN before IS NULL THEN CASE WHEN term_index > 0 THEN '... ' ELSE '' END WHEN before = term_index - 1 THEN gap ELSE ' ... ' END || CASE WHEN hit THEN '<em>' || word || '</em>' ELSE word END, '' ORDER BY term_index)
  || CASE WHEN max(term_index) FILTER (WHERE hit) + 12 < max(n) THEN ' ...' ELSE '' END AS body
FROM pieces GROUP BY query_id, document_id, field_index"""
#: The results of the queries as nested values: hits in order, with names and snippets of fields by their index.
_RESULTS = f"""found AS (WITH {_HITS}), fielded AS (SELECT query_id, document_id, list(field_index ORDER BY field_index) AS f, list(['role', 'text'][field_index + 1] ORDER BY field_index) AS names,
  list({{'term_indices': list_transform(string_split(term_indices, ','), lambda x: CAST(x AS INTEGER)), 'body': body}} ORDER BY field_index) AS snippets FROM found GROUP BY query_id, document_id),
listed AS (SELECT query_id, list({{'document_id': document_id, 'fields': map(f, names), 'field_snippets': map(f, snippets)}} ORDER BY document_id) AS hits FROM fielded GROUP BY query_id),
outcomes AS ({_OUTCOMES}), results AS (SELECT query_id, spelling_correction, query_terms, n_hits, coalesce(hits, []) AS hits FROM outcomes LEFT JOIN listed USING (query_id))"""


def _searched(queries: list[tuple[int, str]], last: str, texts: str = _TEXTS["documents"]) -> str:
    return f"WITH {texts}, {_TOK}, {_asked(queries)}, {_WALK}{last}"


_DOCS = " SELECT query_id, document_id FROM docs"
_D = f"WITH {_TEXTS['documents']}, {_TOK}"
_C = f"WITH {_TEXTS['conversations']}, {_TOK}"
_PLACES = "SELECT DISTINCT document_id, field_index, term_index FROM tok WHERE term = '{0}' AND document_id IN (SELECT document_id FROM tok WHERE term = '{1}')"
_ENTRIES = f"{_D}, {_VOCAB}, e AS (SELECT term AS key, CAST(df AS VARCHAR) AS value FROM vocab)"
_TURNS = "SELECT conv_id, string_agg(role || ' ' || text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
_WITHOUT = "field_text AS (SELECT doc_id AS document_id, CAST(0 AS INTEGER) AS field_index, text FROM documents WHERE lang <> 'en')"
_RENEWED = "field_text AS (SELECT doc_id AS document_id, CAST(0 AS INTEGER) AS field_index, CASE WHEN lang = 'en' THEN 'Renewed queen: ' || lang || ' ' || source ELSE text END AS text FROM documents)"


def _code(term: str) -> str:
    """The phonetic code in SQL whose regular expressions have no back-references: each digit's runs in turn."""
    codes = f"translate(regexp_replace(substr({term}, 2), '[^a-z]', '0', 'g'), 'aeiouhwybfpvcgjkqsxzdtlmnr', '00000000111122222222334556')"
    for d in range(7):
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN length({term}) <= 1 THEN {term} ELSE substr({term}, 1, 1) || substr(rpad(replace({codes}, '0', ''), 3, '0'), 1, 3) END"


SQL: dict[str, str] = {
    "tokenize": f"{_D} SELECT document_id, term_index, term FROM tok",
    "term_strings": f"{_D} SELECT doc_id AS document_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN (SELECT document_id, string_agg(term, ' ' ORDER BY term_index) AS terms FROM tok GROUP BY document_id) ON document_id = doc_id",
    "demo_postings": f"""WITH field_text(document_id, field_index, text) AS (VALUES (CAST(1 AS BIGINT), CAST(0 AS INTEGER), 'Mara Quill'), (1, 1, 'Turin Italy'), (1, 2, 'Mara repairs harbour cranes and tower clocks. On Sundays she sails to the lighthouse.'),
  (2, 0, 'Odd Ferrant'), (2, 1, ''), (2, 2, 'Odd keeps bees behind the old clock works in Bergen')), {_TOK} SELECT term, document_id, field_index, term_index FROM tok""",
    "postings_by_term": f"{_D} SELECT term, document_id, field_index, term_index FROM tok",
    "df_by_term": f"{_D}, {_VOCAB} SELECT term, postings_len, df FROM vocab",
    "document_terms": f"{_C} SELECT DISTINCT document_id, term FROM tok",
    "trigram_index": f"{_D} {_TRI.format('(SELECT DISTINCT term FROM tok)')}",
    "trigram_terms_for": f"{_D} SELECT DISTINCT term FROM tok WHERE contains('$' || term || '$', 'ble')",
    "soundex_terms": f"{_D} SELECT {_code('term')} AS code, term FROM (SELECT DISTINCT term FROM tok)",
    "edit_distance_pairs": f"{_D} SELECT word, term, CAST({_distance('word', 'term')} AS INTEGER) AS dist FROM (SELECT DISTINCT term FROM tok), (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in LOOKED_UP)}) AS w(word)",
    "exact_search": _searched(EXACT, _DOCS),
    "search_outcomes": _searched(EXACT, _OUTCOMES),
    "corrected_search": _searched(CORRECTED, _OUTCOMES),
    "corrected_documents": _searched(CORRECTED, _DOCS),
    "spelling_candidates": f"""{_D}, vocab AS (SELECT DISTINCT term FROM tok), qt(q, term, is_last) AS (VALUES {', '.join(f"({i}, '{w}', {str(last).lower()})" for i, w, last in SPELLED)}),
grams AS ({_TRI.format('vocab')}), asked_grams AS ({_TRI.format('qt')}),
pairs AS (SELECT DISTINCT m.term, m.is_last, g.term AS candidate FROM qt m JOIN asked_grams a ON a.term = m.term JOIN grams g ON g.trigram = a.trigram),
rated AS (SELECT *, CASE WHEN is_last AND starts_with(candidate, term) THEN 0 ELSE {_distance('term', 'candidate')} END AS dist FROM pairs)
SELECT term, is_last, candidate, CAST(dist AS INTEGER) AS dist, CAST(rn - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term, is_last ORDER BY dist, strlen(candidate), candidate) AS rn FROM rated WHERE dist <= 10) WHERE rn <= 10""",
    "snippets": _searched(EXACT, f", {_HITS}"),
    "search_json": _searched(TALKED, f""", {_RESULTS} SELECT query_id, CAST(to_json({{'spelling_correction': spelling_correction, 'query_terms': CASE WHEN query_terms = '' THEN [] ELSE string_split(query_terms, ' ') END, 'hits': hits}}) AS VARCHAR) AS json FROM results""", _TEXTS["conversations"]),
    "search_get": _searched(TALKED[:1], f""", {_RESULTS} SELECT CAST(to_json({{'spelling_correction': spelling_correction, 'query_terms': string_split(query_terms, ' '), 'hits': hits}}) AS VARCHAR) AS json FROM results""", _TEXTS["conversations"]),
    "empty_index_search": f"WITH {_asked(EXACT)} SELECT q.query_id, false AS spelling_correction, coalesce(string_agg(term, ' ' ORDER BY q_idx), '') AS query_terms, CAST(0 AS BIGINT) AS n_hits FROM q LEFT JOIN qt USING (query_id) GROUP BY q.query_id",
    "search_messages": _searched(TALKED, f""", {_RESULTS} SELECT query_id, CASE WHEN text = '' THEN 'Type a search.' WHEN n_hits = 0 THEN 'No hits found for query: ' || text
  ELSE CASE WHEN spelling_correction THEN 'No hits found for query: ' || text || ' / Searching instead for: ' || query_terms || ' / ' ELSE '' END || 'Found ' || n_hits || CASE WHEN n_hits = 1 THEN ' result.' ELSE ' results.' END END AS messages FROM results JOIN q USING (query_id)""", _TEXTS["conversations"]),
    "search_result_list": _searched(TALKED, f""", rows AS ({{0}}) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY document_id) - 1 AS INTEGER) AS place, 'Document ID ' || document_id AS title,
  string_agg(['role', 'text'][field_index + 1] || ': ' || body, ' | ' ORDER BY field_index) AS fields FROM rows GROUP BY query_id, document_id""".replace("{0}", "WITH " + _HITS), _TEXTS["conversations"]),
    "conversation_search": _searched([(1, "user the"), (2, "Assistant la"), (3, "user blend")], f", {_HITS}", _TEXTS["conversations"]),
    "remove_then_search": _searched(EXACT, _DOCS, _WITHOUT),
    "upsert_then_search": _searched([(1, "renewed queen"), (2, "blend")], f", {_HITS}", _RENEWED),
    "intersect_prefix": f"{_D} {_PLACES.format('the', 'blend')} UNION {_PLACES.format('blend', 'the')}",
    "intersect_full": f"WITH {_TEXTS['documents']}, {_TOK}, talk AS (SELECT unnest(regexp_extract_all(role || ' ' || text, '{_W}')) AS w FROM conversations) SELECT term FROM tok INTERSECT SELECT lower(w) AS term FROM talk",
    "map_get": f"{_ENTRIES} SELECT * FROM e WHERE key = 'blend'",
    "map_put": f"{_ENTRIES} SELECT * FROM e WHERE key NOT IN ('blend', 'blended-in') UNION ALL VALUES ('blend', 'replaced'), ('blended-in', 'added')",
    "map_length": f"{_ENTRIES} SELECT count(*) AS length, count(*) = 0 AS is_empty FROM e",
    "map_update": f"{_ENTRIES} SELECT key, CASE WHEN key = 'blend' THEN value || ' times' ELSE value END AS value FROM e",
    "map_remove": f"{_ENTRIES} SELECT * FROM e WHERE key <> 'blend'",
    "map_scan": f"{_ENTRIES} SELECT * FROM e ORDER BY key",
    "prefix_scan": f"{_ENTRIES} SELECT * FROM e WHERE starts_with(key, 'ble') ORDER BY key",
    "range_scan_from": f"{_ENTRIES} SELECT * FROM e WHERE key >= 'queen' AND EXISTS (SELECT 1 FROM e WHERE key = 'queen') ORDER BY key",
    "json_field_text": _TURNS,
    "raw_json_text": _TURNS,
}
