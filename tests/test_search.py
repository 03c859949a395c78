import itertools
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import index as I
from inkwell.operators import matching
from inkwell.operators.correction import corrections
from inkwell.operators.snippets import with_snippets
from inkwell.plans import search as S
from inkwell.sources.tables import from_json_strings, json_documents

PEOPLE = f"file://{pathlib.Path(__file__).parent}/people.jsonl"


@pytest.fixture(scope="module")
def long_index(spark):
    return I.build(json_documents(spark, PEOPLE, ["name", "bio"]), ["name", "bio"])


@pytest.fixture(scope="module")
def flat_index(spark):
    rows = [
        (1, "Jane Smith", "Jane is from the San Francisco Bay Area and serves as CEO of Foo Inc."),
        (2, "Samuel Wu", "The first memory Samuel has is of playing basketball with his mother in Manhattan"),
    ]
    return I.build(spark.createDataFrame(rows, "document_id long, name string, bio string"), ["name", "bio"])


def ask(spark, index, query):
    return S.search_one(spark, index, query).first().asDict(recursive=True)


def test_simple_search(spark, flat_index):
    found = ask(spark, flat_index, "SAn francIsco")
    assert not found["spelling_correction"] and found["query_terms"] == ["san", "francisco"]
    body = "Jane is from the <em>San</em> <em>Francisco</em> Bay Area and serves as CEO of Foo Inc"
    assert found["hits"] == [{"document_id": 1, "fields": {1: "bio"}, "field_snippets": {1: {"term_indices": [4, 5], "body": body}}}]


def test_two_fields(spark, flat_index):
    (hit,) = ask(spark, flat_index, "basketball samuel")["hits"]
    assert hit["document_id"] == 2 and hit["fields"] == {0: "name", 1: "bio"}
    assert hit["field_snippets"][0] == {"term_indices": [0], "body": "<em>Samuel</em> Wu"}
    assert hit["field_snippets"][1] == {"term_indices": [3, 8], "body": "The first memory <em>Samuel</em> has is of playing <em>basketball</em> with his mother in Manhattan"}


def test_long_snippet(spark, long_index):
    found = ask(spark, long_index, "CEO foo inc Computer science electrical engineering")
    (hit,) = found["hits"]
    assert found["query_terms"] == ["ceo", "foo", "inc", "computer", "science", "electrical", "engineering"] and not found["spelling_correction"]
    assert hit["fields"] == {1: "bio"}
    assert hit["field_snippets"][1]["term_indices"] == [11, 13, 14, 46, 47, 73, 74]
    assert hit["field_snippets"][1]["body"] == (
        "... grew up near a windy harbour town and now is <em>CEO</em> at <em>Foo</em> <em>Inc</em>. Two small museums and a choir for retired sailors also"
        " ... about cooling server rooms. At twenty she finished a degree, <em>Computer</em> <em>Science</em>, at Stanford College by 1998. There followed some years of"
        " ... nobody else would mend. Later came a long doctorate about <em>Electrical</em> <em>Engineering</em> in Turin. Her favorite day off means fresh snow, an ..."
    )


def test_correction(spark, long_index):
    found = ask(spark, long_index, "engineer electric")
    assert found["spelling_correction"] and found["query_terms"] == ["engineering", "electrical"]
    (hit,) = found["hits"]
    assert hit["document_id"] == 1 and hit["field_snippets"][1]["term_indices"] == [73, 74]
    assert hit["field_snippets"][1]["body"] == (
        "... nobody else would mend. Later came a long doctorate about <em>Electrical</em> <em>Engineering</em> in Turin. Her favorite day off means fresh snow, an ..."
    )


@pytest.mark.parametrize("query", ["", "  ...", "zzqq", "z", "jane qqzzqq", "jane samuel"])
def test_nothing_found_keeps_the_terms(spark, long_index, query):
    found = ask(spark, long_index, query)
    assert found["hits"] == [] and not found["spelling_correction"]
    assert found["query_terms"] == [t for t in query.replace(".", " ").split()]


def test_type_ahead_counts_as_correction(spark, long_index):
    found = ask(spark, long_index, "jane stan")
    assert found["spelling_correction"] and found["query_terms"] == ["jane", "stanford"]


def test_duplicate_terms(spark, flat_index):
    assert [h["document_id"] for h in ask(spark, flat_index, "jane JANE jane")["hits"]] == [1]


def test_missing_query_raises(spark, flat_index):
    with pytest.raises(ValueError, match="query required"):
        S.search_one(spark, flat_index, None)


def test_batch_equals_single(spark, long_index):
    queries = ["jane", "engineer electric", "", "samuel zzz", "her favorite"]
    batch = S.search(spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), long_index).orderBy("query_id").collect()
    for row, query in zip(batch, queries):
        one = ask(spark, long_index, query)
        assert {k: v for k, v in row.asDict(recursive=True).items() if k != "query_id"} == one


def test_json_and_messages(spark, long_index):
    results = S.search(spark.createDataFrame([(1, "engineer electric"), (2, "qqzz"), (3, "jane")], "query_id long, text string"), long_index)
    found = {r["query_id"]: json.loads(r["json"]) for r in S.as_json(results).collect()}
    assert found[2] == {"spelling_correction": False, "query_terms": ["qqzz"], "hits": []}
    assert found[1]["hits"][0]["fields"] == {"1": "bio"} and found[1]["hits"][0]["field_snippets"]["1"]["term_indices"] == [73, 74]
    assert [tuple(r) for r in S.result_list(results).where("query_id = 3").select("place", "title", "field_results.field_name").collect()] == [(0, "Document ID 1", ["name", "bio"])]


def test_messages(spark, flat_index):
    queries = spark.createDataFrame([(1, "basketbal"), (2, "qqzz"), (3, "jane"), (4, ""), (5, None), (6, "of")], "query_id long, text string")
    said = dict(S.messages(S.search(queries, flat_index), queries).collect())
    assert said == {
        1: ["No hits found for query: basketbal", "Searching instead for: basketball", "Found 1 result."],
        2: ["No hits found for query: qqzz"],
        3: ["Found 1 result."],
        4: ["Type a search."],
        5: ["Type a search."],
        6: ["Found 2 results."],
    }


def test_demo_corpus_without_locations(spark):
    fields = ["name", "location", "bio"]
    index = I.build(json_documents(spark, PEOPLE, fields), fields)
    assert index.field_text.where("field_index = 1 and text = ''").count() == 2
    assert ask(spark, index, "Manhattan")["hits"][0]["fields"] == {2: "bio"}


def test_nested_document(spark):
    raw = '{"id": 123, "name": "Jane Smith", "locations": ["Dayton, Ohio", "Denver, Colorado"], "bio": {"title": "Jane Smith - Bio", "text": "The great Jane was born and raised in the very neat Denver, Colorado"}}'
    fields = ["name", "locations", "bio"]
    rows = spark.createDataFrame([(raw,)], "value string")
    index = I.build(from_json_strings(rows, "value", fields, F.get_json_object("value", "$.id").cast("long")), fields)
    assert index.vocabulary.count() == 16 and index.postings.count() == 22 and index.document_terms.count() == 16
    jane = index.postings.where("term = 'jane'").orderBy("document_id", "field_index", "term_index").collect()
    assert [tuple(r)[1:] for r in jane] == [(123, 0, 0), (123, 2, 2), (123, 2, 13)]
    assert sorted(r["term"] for r in index.trigrams.where("trigram = 'eat'").collect()) == ["great", "neat"]


def test_remove_and_upsert(spark, flat_index):
    gone = I.remove(flat_index, spark.createDataFrame([(1,), (99,)], "document_id long"))
    assert {r[0] for r in gone.postings.select("document_id").distinct().collect()} == {2}
    assert gone.vocabulary.where("term = 'francisco'").count() == 0
    new = spark.createDataFrame([(2, "Samuel Renewed", "nothing of sport"), (3, "Jane Third", None)], "document_id long, name string, bio string")
    index = I.upsert(flat_index, new)
    assert [h["document_id"] for h in ask(spark, index, "jane")["hits"]] == [1, 3]
    # Nothing of the old text is left, so the word is corrected to what resembles it, or not found.
    assert index.postings.where("term = 'basketball'").count() == 0
    empty = I.remove(flat_index, flat_index.field_text.select("document_id"))
    assert empty.postings.count() == empty.vocabulary.count() == 0
    assert ask(spark, empty, "jane")["hits"] == []


def test_empty_index(spark):
    index = I.empty(spark, ["name"])
    assert index.postings.count() == 0 and ask(spark, index, "jane doe")["query_terms"] == ["jane", "doe"]


def test_accents_and_one_letter_words(spark):
    index = I.build(spark.createDataFrame([(1, "é à l'été"), (2, None), (None, "é")], "document_id long, t string"), ["t", "absent"])
    assert [h["document_id"] for h in ask(spark, index, "É")["hits"]] == [1]
    assert ask(spark, index, "x")["hits"] == []


def brute_corrections(term, last, vocabulary):
    grams = lambda t: {f"${t}$"[i : i + 3] for i in range(len(t))}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, diagonal = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(diagonal[j] + 1, row[-1] + 1, diagonal[j - 1] + (x != y)))
        return row[-1]

    found = [(0 if last and v.startswith(term) else distance(term, v), len(v.encode()), v) for v in vocabulary if grams(term) & grams(v)]
    return [(d, v) for d, _, v in sorted(f for f in found if f[0] <= 10)[:10]]


def test_corrections_against_brute_force(spark, sf):
    index = I.build(spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "document_id"), ["text"])
    vocabulary = [r[0] for r in index.vocabulary.select("term").collect()][:3000]
    asked = [("blendd", False), ("thé", True), ("tionsing", False), ("th", True), ("éauoi", True), ("xyzzyxyzzyxyzzy", False), ("q", True)]
    trigrams = I.trigram_table(spark.createDataFrame([(v,) for v in vocabulary], "term string"))
    found = corrections(spark.createDataFrame(asked, "term string, is_last boolean"), trigrams).collect()
    for term, last in asked:
        mine = [(r["dist"], r["candidate"]) for r in sorted((r for r in found if (r["term"], r["is_last"]) == (term, last)), key=lambda r: r["rank"])]
        assert mine == brute_corrections(term, last, vocabulary)


def walk(lists):
    """The combinations that are tried, step by step."""
    at, out = [0] * len(lists), []
    while len(out) < 10:
        out.append(tuple(at))
        q = min(range(len(lists)), key=lambda q: (lists[q][at[q]], q))
        at[q] += 1
        if at[q] == len(lists[q]):
            break
    return out


def test_attempts_against_the_walk(spark):
    rng = random.Random(5)
    cases = [[[rng.randint(1, 6) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 4))] for _ in range(150)]
    rows = [(c, q, len(lists), r, f"{q}-{r}", n, True) for c, lists in enumerate(cases) for q, ns in enumerate(lists) for r, n in enumerate(ns)]
    found = matching.attempts(spark.createDataFrame(rows, "query_id long, q_idx int, n_terms int, rank int, candidate string, postings_len long, corrected boolean")).collect()
    mine = {}
    for r in found:
        mine.setdefault((r["query_id"], r["attempt"]), {})[r["q_idx"]] = int(r["candidate"].split("-")[1])
    for c, lists in enumerate(cases):
        tried = [tuple(mine[c, a][q] for q in range(len(lists))) for a in itertools.takewhile(lambda a: (c, a) in mine, range(20))]
        assert tried == walk(lists)


def test_unresolved_terms_end_the_query(spark):
    rows = [(1, 0, 2, 0, "a", 1, False)]
    assert matching.attempts(spark.createDataFrame(rows, "query_id long, q_idx int, n_terms int, rank int, candidate string, postings_len long, corrected boolean")).isEmpty()


def test_a_later_attempt_finds_documents(spark):
    # "alphx" resembles alpha best, but only alpho stands with beta.
    docs = spark.createDataFrame([(1, "alpha gamma"), (2, "alpho beta"), (3, "beta beta")], "document_id long, t string")
    found = ask(spark, I.build(docs, ["t"]), "alphx beta")
    assert found["spelling_correction"] and found["query_terms"] == ["alpho", "beta"] and [h["document_id"] for h in found["hits"]] == [2]


def brute_snippet(words, gaps, hits, window=10):
    seen = [i for i in range(len(words)) if any(abs(i - h) <= window for h in hits)]
    out, before = ("... " if seen[0] else ""), None
    for i in seen:
        if before is not None:
            out += gaps[i] if before == i - 1 else " ... "
        out += f"<em>{words[i]}</em>" if i in hits else words[i]
        before = i
    return out + (" ..." if hits[-1] + 12 < len(words) else "")


def test_snippets_against_brute_force(spark):
    rng = random.Random(3)
    rows, texts, expected = [], [], {}
    for k in range(60):
        n = rng.choice([1, 2, 11, 12, 13, 22, 23, 24, 60])
        words, gaps = [f"w{i}" for i in range(n)], [rng.choice([" ", ", ", "\n", " - "]) for _ in range(n)]
        hits = sorted(rng.sample(range(n), rng.randint(1, min(n, 3))))
        texts.append((k, 0, "".join(g + w for g, w in zip(gaps, words)) + "!"))
        rows.append((0, k, 0, hits))
        expected[k] = brute_snippet(words, gaps, hits)
    for k, (n, hits) in enumerate([(40, [0, 21]), (40, [0, 22]), (12, [0]), (13, [0]), (14, [0])], 100):
        words = [f"w{i}" for i in range(n)]
        texts.append((k, 0, " ".join(words)))
        rows.append((0, k, 0, hits))
        expected[k] = brute_snippet(words, [" "] * n, hits)
    hits = spark.createDataFrame(rows, "query_id long, document_id long, field_index int, term_indices array<int>")
    found = with_snippets(hits, spark.createDataFrame(texts, I.FIELD_TEXT)).collect()
    assert {r["document_id"]: r["body"] for r in found} == expected


def test_vocabulary_shuffles_no_terms_of_documents(spark, sf):
    """Repeated ids and several fields are one document; no exchange is by term and document."""
    docs = spark.createDataFrame([(1, "b A a", "a c"), (1, "a B", None), (2, "", "É é"), (3, None, None)], "document_id long, t string, u string")
    index = I.build(docs, ["t", "u"])
    assert {tuple(r) for r in index.vocabulary.collect()} == {("a", 4, 1), ("b", 2, 1), ("c", 1, 1), ("é", 2, 1)}
    by_postings = I.from_postings(index.fields, index.field_text, index.postings)
    assert index.vocabulary.schema == by_postings.vocabulary.schema and index.vocabulary.exceptAll(by_postings.vocabulary).isEmpty()
    exchanges = [by.split(",")[:2] for by in index.vocabulary._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert not any(by[0].startswith("term") and by[1].strip().startswith("document_id") for by in exchanges)


def test_words_of_scripts_letter_by_letter(spark):
    """A text without such letters takes the plain expression; both agree where it does."""
    texts = ["it's 1,000.5 a_b _x", "naïve — “quote” 🙂 Ω", "日本 kana ひ", "ไทย thai", "က ក ລ", "\U00020000x", "\U0001f200", "ﬁ ｱ ﬀ", "", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.words(F.col("t")).alias("w"), X.gaps(F.col("t")).alias("g"), F.regexp_extract_all("t", F.lit(X.JVM_WORD), F.lit(0)).alias("w1"), F.split("t", X.JVM_WORD, -1).alias("g1")).collect()
    assert all(r["w"] == r["w1"] and r["g"] == r["g1"] for r in found) and X.PLAIN_WORD != X.JVM_WORD


def test_nearest_are_kept_before_they_meet(spark):
    """Each slice keeps its nearest, so a term's pairs needn't all be sorted in one place."""
    trigrams = I.trigram_table(spark.createDataFrame([(f"word{i}",) for i in range(50)], "term string"))
    found = corrections(spark.createDataFrame([("wordx", False)], "term string, is_last boolean"), trigrams)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 10


def test_postings_are_read_once_to_match(spark, flat_index):
    rows = [(1, 0, 0, 1, "jane", False)]
    tried = spark.createDataFrame(rows, "query_id long, attempt int, q_idx int, n_terms int, candidate string, corrected boolean")
    chosen, documents = matching.match(tried, flat_index)
    assert [tuple(r) for r in documents.collect()] == [(1, 1)] and [r["term"] for r in chosen.collect()] == ["jane"]
    assert "posexplode" not in documents._jdf.queryExecution().executedPlan().toString()
