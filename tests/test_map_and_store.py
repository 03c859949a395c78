import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.operators import index as I
from inkwell.operators import ordered_map as M
from inkwell.plans import search as S
from inkwell.sources import store
from inkwell.streaming.ingest import ingest

KEYS = ["apple", "banana", "bandana", "cucumber", "daisy"]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(k, f"value{i}") for i, k in enumerate(KEYS, 1)], "key string, value string")


def keys(df):
    return [r["key"] for r in df.collect()]


def test_map(spark, entries):
    assert M.length(M.empty(spark)) == 0 and M.length(entries) == 5
    assert M.get(entries, "bandana").first()["value"] == "value3" and M.get(entries, "unknown key").isEmpty()
    changed = M.update(entries, "apple", F.concat("value", F.lit("-updated")))
    assert M.get(changed, "apple").first()["value"] == "value1-updated" and M.length(changed) == 5
    assert keys(M.scan(entries)) == KEYS
    assert keys(M.scan_from(entries, "banana")) == KEYS[1:] and keys(M.scan_from(entries, "b")) == []
    assert keys(M.scan_prefix(entries, "ban")) == ["banana", "bandana"]
    less = M.remove(entries, spark.createDataFrame([("cucumber",), ("unknown key",)], "k string"))
    assert keys(M.scan(less)) == ["apple", "banana", "bandana", "daisy"]
    assert M.get(less, "cucumber").isEmpty() and M.scan_from(less, "cucumber").isEmpty() and M.scan_prefix(less, "cucumber").isEmpty()


def test_put_takes_the_last(spark, entries):
    new = spark.createDataFrame([("apple", "b", 2), ("apple", "z", 1), ("egg", "e", 1)], "key string, value string, n int")
    out = M.put(entries, new, F.col("n"))
    assert M.length(out) == 6 and M.get(out, "apple").collect()[0]["value"] == "b"
    assert M.get(M.put(entries, new.drop("n")), "apple").first()["value"] == "z"


def test_intersections(spark):
    schema = "record_id long, field_id long, timestamp long"
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 3), (3, 1, 2), (3, 9, 2), (4, 1, 9)], schema)
    b = spark.createDataFrame([(1, 1, 5), (1, 2, 2), (2, 8, 3), (4, 1, 4), (5, 4, 4)], schema)
    assert [tuple(r) for r in M.intersect_rows(a, b).collect()] == [(1, 2, 2)]
    both = M.intersect_documents(a, b, "record_id").orderBy("record_id", "field_id", "timestamp")
    assert [tuple(r) for r in both.collect()] == [(1, 1, 1), (1, 1, 5), (1, 2, 2), (1, 2, 3), (4, 1, 4), (4, 1, 9)]
    assert M.intersect_documents(a.limit(0), b, "record_id").count() == 5 and M.intersect_documents(a, b.limit(0), "record_id").count() == 6


DOC = "document_id long, name string, bio string"


def ids(spark, index, query):
    return sorted(r["document_id"] for r in S.search_documents(spark.createDataFrame([(0, query)], "query_id long, text string"), index).collect())


def test_store(spark, tmp_path):
    s = store.IndexStore(spark, f"file://{tmp_path}/index", ("name", "bio"))
    s.index(spark.createDataFrame([(1, "Jane", "great skier"), (2, "Samuel", "great player")], DOC), 0)
    assert ids(spark, s.load(), "great") == [1, 2]
    s.index(spark.createDataFrame([(2, "Samuel", "quiet now"), (3, "Ann", "great too")], DOC), 1)
    assert ids(spark, s.load(), "great") == [1, 3] and ids(spark, s.load(), "quiet") == [2]
    s.remove(spark.createDataFrame([(1,), (77,)], "document_id long"), 2)
    assert ids(spark, s.load(), "great") == [3]
    s.index(spark.createDataFrame([(2, "Samuel", "quiet now"), (3, "Ann", "great too")], DOC), 1)  # a batch that is run again
    assert ids(spark, s.load(), "great") == [3]
    small = s.compact(f"file://{tmp_path}/small")
    assert ids(spark, small, "great") == [3] and small.stored and small.vocabulary.where("term = 'skier'").isEmpty()
    assert small.postings.count() == s.load().postings.count() == 6


def test_saved_index_equals_built(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), "role", "text")
    built = I.build(docs, ["role", "text"])
    store.save(built, f"file://{tmp_path}/x")
    read = store.load(spark, f"file://{tmp_path}/x", ["role", "text"])
    for name in ("postings", "vocabulary", "trigrams", "soundex", "field_text"):
        a, b = getattr(built, name), getattr(read, name)
        b = b.select(*a.columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_lookups_reach_the_scan(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "document_id")
    store.save(I.build(docs, ["text"]), f"file://{tmp_path}/x")
    plan = store.load(spark, f"file://{tmp_path}/x", ["text"]).postings.where("term = 'blend'").select("document_id")._jdf.queryExecution().toString()
    assert "EqualTo(term,blend)" in plan and "term_index" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_stream(spark, tmp_path):
    schema = DOC + ", deleted boolean"
    batches = [
        [(1, "Jane", "great", False), (2, "Sam", "great", False), (2, "Sam", "great", False)],
        [(1, None, None, True), (3, "Ann", "great", None), (2, "Sam", "quiet", False)],
    ]
    s = store.IndexStore(spark, f"file://{tmp_path}/index", ("name", "bio"))
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/checkpoint", availableNow=True)
        query.awaitTermination()
        assert ids(spark, s.load(), "great") == ([1, 2] if k == 0 else [3])
    assert ids(spark, s.load(), "quiet") == [2]


def test_saved_postings_are_slices_sorted_by_term(spark, sf, tmp_path, monkeypatch):
    """Texts are cut once for the postings, no range of terms is sampled, and a lookup finds all documents in all slices."""
    monkeypatch.setattr(store, "SLICE_BYTES", 1 << 16)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "document_id")
    built = I.build(docs, ["text"])
    store.save(built, f"file://{tmp_path}/i")
    plan = store.by_term(built.field_text, f"file://{tmp_path}/i/field_text")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(document_id" in plan
    found = store.load(spark, f"file://{tmp_path}/i", ["text"])
    assert len(found.postings.inputFiles()) > 4
    for name in ("postings", "vocabulary", "trigrams"):
        assert found.__getattribute__(name).exceptAll(getattr(built, name)).isEmpty() and found.__getattribute__(name).count() == getattr(built, name).count()


@pytest.fixture
def kept(spark, tmp_path):
    """A saved index of near words that only document 1 has, and a farther one of document 2."""
    near = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))
    docs = spark.createDataFrame([(1, f"{near} beta Beta"), (2, "wordfarther beta"), (3, None)], "document_id long, t string")
    store.save(I.build(docs, ["t"]), f"file://{tmp_path}/kept")
    return store.load(spark, f"file://{tmp_path}/kept", ["t"])


def test_saved_vocabulary_is_told_by_the_slices(spark, tmp_path, monkeypatch):
    """Texts aren't cut again for it; fields and repeated ids are one document."""
    docs = spark.createDataFrame([(1, "b A a", "a c"), (1, "a B", None), (2, "", "É é"), (3, None, None)], "document_id long, t string, u string")
    built = I.build(docs, ["t", "u"])
    expected = {tuple(r) for r in built.vocabulary.collect()}

    def cut(*_):
        raise AssertionError("cut again")

    for at, name in ((I, "vocabulary_of"), (I, "counted"), (store, "vocabulary_of")):
        monkeypatch.setattr(at, name, cut, raising=False)
    store.save(built, f"file://{tmp_path}/x")
    found = store.load(spark, f"file://{tmp_path}/x", ["t", "u"])
    assert {tuple(r) for r in found.vocabulary.collect()} == expected == {("a", 4, 1), ("b", 2, 1), ("c", 1, 1), ("é", 2, 1)}
    assert sorted(map(tuple, found.postings.collect())) == sorted(map(tuple, built.postings.collect()))


def test_search_after_removal_counts_no_texts(spark, kept, monkeypatch):
    """Only what is looked up is counted, and the nearest are taken until enough of them still stand somewhere."""
    gone = I.remove(kept, spark.createDataFrame([(1,), (9,)], "document_id long"))
    assert {tuple(r) for r in gone.vocabulary.collect()} == {("wordfarther", 1, 1), ("beta", 1, 1)}

    def count(*_):
        raise AssertionError("all terms counted")

    monkeypatch.setattr(I, "counted", count)
    monkeypatch.setattr(I, "vocabulary_of", count)
    gone = I.remove(kept, spark.createDataFrame([(1,), (9,)], "document_id long"))
    found = S.search_one(spark, gone, "betta wordaa").first()
    assert found["query_terms"] == ["beta", "wordfarther"] and [h["document_id"] for h in found["hits"]] == [2]


@pytest.mark.parametrize("rows", [1, 3, 7, 1 << 16])
def test_sorted_slice_against_brute_force(monkeypatch, rows):
    """Whatever rows leave at once and however texts come: the places and documents of a term stand at its first posting."""
    monkeypatch.setattr(store, "ROWS", rows)
    rng = random.Random(rows)
    texts = [(rng.randint(1, 8), f, [rng.choice(["a", "b", "é", "zz", "𐐀", "ﬁ"]) for _ in range(rng.randint(0, 6))]) for f in (1, 0) for _ in range(12)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([t[i] for t in part], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.list_(pa.string())))], names=["document_id", "field_index", "terms"])
    found = [r for b in store._sorted_slice(iter([batch(texts[:5]), batch([]), batch(texts[5:])])) for r in b.to_pylist()]
    postings = [(t, d, f, i) for d, f, terms in texts for i, t in enumerate(terms)]
    assert sorted(tuple(r.values())[:4] for r in found) == sorted(postings)
    keys = [(r["term"].encode(), r["document_id"], r["field_index"]) for r in found]
    assert keys == sorted(keys)
    told = {r["term"]: (r["places"], r["documents"]) for r in found if r["places"] is not None}
    assert told == {t: (sum(p[0] == t for p in postings), len({p[1] for p in postings if p[0] == t})) for t in {p[0] for p in postings}}
    assert not list(store._sorted_slice(iter([]))) and not list(store._sorted_slice(iter([batch([(1, 0, [])])])))


def test_search_after_upsert_counts_no_texts(spark, kept, monkeypatch):
    """New terms are found and proposed, replaced ones aren't; changes add up as if the texts were indexed anew."""
    one = spark.createDataFrame([(1, "wordnew alpha"), (4, "alpha Beta")], "document_id long, t string")
    two = spark.createDataFrame([(4, "alpha gamma gamma"), (5, None)], "document_id long, t string")

    def changed():
        return I.remove(I.upsert(I.upsert(kept, one), two), spark.createDataFrame([(2,), (77,)], "document_id long"))

    anew = I.build(spark.createDataFrame([(1, "wordnew alpha"), (4, "alpha gamma gamma"), (3, None), (5, None)], "document_id long, t string"), ["t"])
    for name in ("vocabulary", "trigrams", "postings", "field_text"):
        a, b = getattr(anew, name), getattr(changed(), name)
        assert sorted(map(tuple, b.select(*a.columns).collect())) == sorted(map(tuple, a.collect())), name

    def count(*_):
        raise AssertionError("all terms counted")

    monkeypatch.setattr(I, "counted", count)
    monkeypatch.setattr(I, "vocabulary_of", count)
    for query in ("wordaa", "gama alpa", "alpha wordn", "beta", "wordfarther"):
        found = S.search_one(spark, changed(), query).first()
        expected = {"wordaa": (["wordnew"], [1]), "gama alpa": (["gamma", "alpha"], [4]), "alpha wordn": (["alpha", "wordnew"], [1]), "beta": (None, None), "wordfarther": (["wordnew"], [1])}[query]
        if expected[0]:
            assert (found["query_terms"], [h["document_id"] for h in found["hits"]]) == expected, query
        assert "beta" not in found["query_terms"] or not found["hits"]
