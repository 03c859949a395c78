"""The whole pipeline against its stages in plain Python, with cases planted in the rows."""

import pathlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_dedup import brute_groups
from test_models import brute_leaks

import corpus_pipeline
from inkwell.llm import bpe, jaccard, quality


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The tables of the smallest scale, and beside them copies, near copies and a benchmark item in some text."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "benchmark"))
    good = [r["text"] for r in docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").where("length(text) between 800 and 3000").orderBy("doc_id").limit(6).collect()]
    item = items.orderBy("item_id").first()["text"]
    planted = [(9000, good[0]), (9001, good[0]), (9002, good[1] + " and one more"), (9003, "Before it. " + good[2]), (9004, good[3][:400] + " " + item + " " + good[3][400:])]
    more = spark.createDataFrame(planted, "doc_id long, text string")
    for c, kind in docs.dtypes:
        if c not in more.columns:
            more = more.withColumn(c, F.lit(None).cast(kind))
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_brute_force(spark, folder):
    found = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, folder).collect()}
    docs, labels, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    texts = dict(docs.select("doc_id", "text").collect())
    left = {r[0] for r in quality.resample(docs, labels).select("doc_id").collect()}
    least = {}
    for i in sorted(left):
        least.setdefault(texts[i], i)
    left = set(least.values())
    groups = brute_groups({i: texts[i] for i in left}, jaccard.N, jaccard.THRESHOLD)
    left -= {i for i, label, _ in groups if i != label}
    leaks = {d for d, _ in brute_leaks([(i, texts[i]) for i in left], [(r["item_id"], r["text"]) for r in items.collect()])}
    left -= leaks
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})
    assert found == {i: coder.encode_ordinary(texts[i]) for i in left}
    assert not {9000, 9001, 9002, 9003, 9004} & set(found)


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    assert "test_pipeline" in pathlib.Path(corpus_pipeline.__file__).read_text()
