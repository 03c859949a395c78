import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import bpe


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = P.path(request.param)
    return bpe.codec(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def encode(codec, texts):
    ids, at = codec.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_documents(pair, spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert encode(pair[0], texts) == [pair[1].encode_ordinary(t) for t in texts]


TEXTS = st.text(st.one_of(st.sampled_from(" \n\t'stmdrevl  éñ1٣a!?中😀́"), st.characters(exclude_categories=["Cs"])), max_size=60)


def test_any_text(pair):
    codec, other = pair

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXTS, max_size=5))
    def run(texts):
        assert encode(codec, texts) == [other.encode_ordinary(t) for t in texts]
        ids, at = codec.encode(pa.array(texts, pa.string()))
        raw, ends = codec.decode(ids, at)
        assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == texts

    run()


def test_long_words(pair):
    rng = random.Random(1)
    texts = ["a" * 3000, "".join(rng.choice("abcde") for _ in range(2000)), "".join(rng.choice("étaoin") for _ in range(700)), "=" * 1000 + " x"]
    assert encode(pair[0], texts) == [pair[1].encode_ordinary(t) for t in texts]


def test_round_trip_and_nulls(spark):
    rows = [(1, "Hello  wörld\n"), (2, None), (3, ""), (4, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = bpe.encode(docs)
    assert tokens.where("not round_trip").isEmpty() and np.all([r["n_tokens"] == len(r["token_ids"]) for r in tokens.where("token_ids is not null").collect()])
    assert sorted(tuple(r) for r in bpe.decode(tokens).collect()) == rows
