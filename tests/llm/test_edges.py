"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import bpe, decontaminate, exact_dedup, jaccard, line_dedup, lm_score, pii, quality, secrets, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, slice string, homes string, gone_id long, key double, n_dropped int, good boolean, fit string, member string, h long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
TEXT = "one passage of clean words that stands twice in this small table"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, TEXT), (2, TEXT), (2, TEXT), (3, None), (None, TEXT), (None, None), (4, ""), (5, ""), (6, LONG), (7, LONG + " more"), (8, "a"), (9, "é\n\né\n…"), (10, "x" * 100_000), (11, " \n\t ")]
    extra = (None, 7, None, "h", 5, 0.5, None, True, None, "m", None)
    return spark.createDataFrame([(i, t, "en", None, *extra) for i, t in texts], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, None, 0), (None, 1, 0), (8, 0, 0), (6, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one passage of clean words. That stands twice in this small table"), (2, None), (3, ""), (None, "word1 word2 word3 word4 word5 word6 word7 word8"), (1, "..."), (5, "a")], "item_id long, text string")


def operators(labels, items):
    return {
        "bpe": lambda d: bpe.encode(d),
        "exact_dedup": lambda d: exact_dedup.dedup(d),
        "secrets": lambda d: secrets.secrets(d),
        "suffix_array": lambda d: suffix_array.repeated_spans(d),
        "leaks": lambda d: decontaminate.leaks(d, items),
        "decontaminate": lambda d: decontaminate.decontaminate(d, items),
        "jaccard": lambda d: jaccard.similar_pairs(d),
        "groups": lambda d: jaccard.similar_groups(d),
        "keep_one": lambda d: jaccard.keep_one(d),
        "line_dedup": lambda d: line_dedup.line_dedup(d, 1),
        "resample": lambda d: quality.resample(d, labels),
        "keep_good": lambda d: quality.keep_good(d, labels),
        "lm_score": lambda d: lm_score.score(d, lm_score.train(d)),
        "pii": lambda d: pii.find_pii(d),
    }


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x))


def test_defined_results(odd, labels, items):
    ops = operators(labels, items)
    encoded = {(r["doc_id"], r["n_tokens"]) for r in ops["bpe"](odd).collect()}
    assert {(3, None), (4, 0), (5, 0), (None, None)} <= encoded and ops["bpe"](odd).where("not round_trip").isEmpty()
    kept = ops["exact_dedup"](odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 3, 4, 6, 7, 8, 9, 10, 11, None, None]
    assert {tuple(r) for r in ops["suffix_array"](odd).select("doc_id", "start_word", "end_word").collect()} == {(6, 0, 30_000), (7, 0, 30_000)}
    assert {(r["doc_id"], r["item_id"]) for r in ops["leaks"](odd).collect()} >= {(1, 1), (2, 1), (None, 1)}
    clean = ops["decontaminate"](odd)
    assert clean.columns == odd.columns and {3, 4, 5, 10} <= set(ids(clean)) and not {1, 2} & set(ids(clean))
    assert [r["text"] for r in clean.where("doc_id is null").collect()] == [None]
    pairs = {tuple(r) for r in ops["jaccard"](odd).select("doc_id_a", "doc_id_b").collect()}
    assert pairs == {(1, 2), (6, 7)}
    assert {tuple(r) for r in ops["groups"](odd).collect()} == {(1, 1, 1), (2, 1, 1), (6, 6, 1), (7, 6, 1)}
    kept = ops["keep_one"](odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 3, 4, 5, 6, 8, 9, 10, 11, None, None]
    lines = ops["line_dedup"](odd)
    assert lines.columns[: len(odd.columns)] == odd.columns and lines.count() == odd.count()
    assert {r["text"] for r in lines.where("doc_id in (1, 2)").collect()} == {""} and lines.where("doc_id is null and text is not null").first()["text"] == TEXT
    scored = {r["doc_id"]: r for r in ops["lm_score"](odd).collect()}
    assert scored[3]["n_words"] is None and scored[4]["n_words"] == 0 and scored[4]["log_prob"] == 0 and scored[4]["perplexity"] is None
    assert scored[6]["n_words"] == 30_000 and scored[10]["n_words"] == 1
    good = ops["keep_good"](odd)
    assert good.columns == odd.columns and 3 not in ids(good)
    assert ops["secrets"](odd).isEmpty() and ops["pii"](odd).isEmpty()


def test_empty_table(odd, labels, items):
    for name, op in operators(labels, items).items():
        assert op(odd.limit(0)).isEmpty(), name


def test_nothing_but_nulls(odd, labels, items):
    nulls = odd.withColumns({c: F.lit(None).cast(t) for c, t in odd.dtypes})
    kept = {"bpe", "exact_dedup", "decontaminate", "keep_one", "line_dedup", "lm_score"}
    for name, op in operators(labels, items).items():
        assert op(nulls).count() == (odd.count() if name in kept else 0), name


def test_no_labels_and_no_items(odd, labels, items):
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.where("text is not null").count()
    assert decontaminate.leaks(odd, items.limit(0)).isEmpty()


def test_pipeline_stages(spark, odd, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, rows in enumerate((odd, odd.limit(0))):
        docs = rows
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if n + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == odd.columns
            docs.write.parquet(f"{tmp_path}/out-{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/out-{k}-{n}")
        assert docs.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]
