"""Exact dedup, line dedup, n-gram Jaccard join and suffix arrays against brute force."""

import collections
import random

import numpy as np
import pytest
import regex

from inkwell.llm import exact_dedup, jaccard, queries, suffix_array
from inkwell.llm import line_dedup as L


@pytest.fixture(scope="module")
def texts(spark, sf):
    return dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_suffix_array", "op6_jaccard_join", "op7_line_dedup"])
def test_sql(spark, sf, duck, same, name):
    same(queries.QUERIES[name](spark, sf).toArrow(), duck.sql(queries.SQL[name]).to_arrow_table())


def test_exact_dedup_with_history(spark):
    rng = random.Random(2)
    old = [(i, f"text {rng.randint(0, 30)}") for i in range(40)]
    new = [(rng.randint(100, 160), f"text {rng.randint(0, 60)}") for _ in range(80)]
    docs = spark.createDataFrame(new, "doc_id long, text string")
    found = sorted(tuple(r) for r in exact_dedup.dedup(docs, spark.createDataFrame(old, "doc_id long, text string")).collect())
    seen = {t for _, t in old}
    least = {}
    for i, t in new:
        if t not in seen:
            least[t] = min(i, least.get(t, i))
    assert found == sorted((i, t) for t, i in least.items())


def test_exact_dedup_ties(spark):
    """Rows of one id and text: the same one stays, however rows are ordered."""
    rows = [(1, "a", x) for x in "pqrst"] + [(2, "a", "u"), (3, "b", "v")]
    kept = [{tuple(r) for r in exact_dedup.dedup(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect()} for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and sorted(r[:2] for r in kept[0]) == [(1, "a"), (3, "b")]


def test_index_knows_its_shards(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    index = exact_dedup.build_index(docs.where("doc_id < 100"), 7)
    assert {r[0] for r in index.select("shards").collect()} == {7}
    assert {tuple(r) for r in exact_dedup.repeats(docs, index).collect()} == {(i, i % 50) for i in range(50, 200)}


def test_minimal_perfect_hash():
    words = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    levels, slot = exact_dedup.build_levels(words[:4000])
    assert sorted(slot) == list(range(4000)) and np.array_equal(exact_dedup.find_slots(levels, words[:4000]), slot)
    assert exact_dedup.find_slots(levels, words[4000:]).max() < 4000


def test_line_dedup_positions(spark):
    docs = spark.createDataFrame([(1, "Same  line\na\n\nsame line"), (2, "b\nSAME LINE "), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.line_dedup(docs, 1).collect()) == [(1, "a\n", 2), (2, "b", 1), (3, None, 0)]


def gram_sets(texts, n):
    out = {}
    for i, t in texts.items():
        w = regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())
        if w:
            k = min(n, len(w))
            out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    return out


def brute_pairs(texts, n, t):
    sets = gram_sets(texts, n)
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    out = {(least[s], i): 1.0 for i, s in sets.items() if least[s] != i}
    own = sorted(least.values())
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            x, y = sets[own[a]], sets[own[b]]
            if (v := len(x & y) / len(x | y)) >= t:
                out[own[a], own[b]] = v
    return out


def test_jaccard_on_documents(spark, texts):
    found = {tuple(r)[:2]: r[2] for r in jaccard.similar_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == pytest.approx(brute_pairs(texts, jaccard.N, jaccard.THRESHOLD))


def test_jaccard_in_large_regions(spark):
    """Groups of near copies above SMALL, many of them alike, and hot n-grams that all share."""
    rng = random.Random(4)
    texts, hot = {}, [f"h{i}" for i in range(6)]
    for g in range(3):
        base = [f"g{g}w{rng.randint(0, 40)}" for _ in range(30)]
        for k in range(70):
            words = [rng.choice(base) if rng.random() < 0.12 * (k % 4) else w for w in base]
            texts[1000 * g + k] = " ".join(hot + words)
    found = {tuple(r)[:2]: r[2] for r in jaccard.similar_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == pytest.approx(brute_pairs(texts, jaccard.N, jaccard.THRESHOLD))


def brute_groups(texts, n, t):
    """Of each document that matches any other: the least it is connected to, and how many it matches."""
    sets = gram_sets(texts, n)
    near = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t] for i in sets}
    label = {i: i for i in sets}
    while (new := {i: min([label[i], *(label[j] for j in near[i])]) for i in sets}) != label:
        label = new
    return {(i, label[i], len(near[i])) for i in sets if near[i]}


def clusters(count, size, step):
    """Groups of near copies, many of them alike, and hot n-grams that all share."""
    rng = random.Random(4)
    texts, hot = {}, [f"h{i}" for i in range(6)]
    for g in range(count):
        base = [f"g{g}w{rng.randint(0, 40)}" for _ in range(30)]
        for k in range(size):
            texts[1000 * g + k] = " ".join(hot + [rng.choice(base) if rng.random() < step * (k % 4) else w for w in base])
    return texts


def test_groups_of_clusters(spark):
    texts = clusters(3, 90, 0.1)
    found = jaccard.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == brute_groups(texts, jaccard.N, jaccard.THRESHOLD)


def test_groups_in_blocks(spark, monkeypatch):
    """A region over REGION_BYTES is cut into a grid."""
    monkeypatch.setattr(jaccard, "REGION_BYTES", 4000)
    texts = clusters(2, 60, 0.1)
    found = jaccard.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == brute_groups(texts, jaccard.N, jaccard.THRESHOLD)


def test_repeated_ids_of_unlike_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (3, b + " more")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.similar_groups(docs).collect()) == [(1, 1, 2), (2, 1, 2), (3, 1, 1)]


def test_regions_split_at_this_scale(spark):
    """A region of a few clusters is parted by pivots, without a smaller LEAF, and windows leave documents out."""
    rng = np.random.default_rng(5)
    grams = []
    for _ in range(6):
        base = rng.integers(0, 2**60, 60).astype(np.uint64)
        grams += [np.unique(np.concatenate([base[rng.random(60) > 0.15], rng.integers(0, 2**60, 3).astype(np.uint64)])) for _ in range(30)]
    region = jaccard.Region(grams, np.array([len(g) for g in grams]), 0.5)
    compared, real = [], jaccard.Region.compared
    region.compared = lambda a, b, within: compared.append(len(a) * len(b) // (1 + within)) or real(region, a, b, within)
    found = {(min(i, j), max(i, j)) for a, b, _ in region.pairs(np.arange(len(grams))) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(180) for j in range(i + 1, 180) if len(set(grams[i]) & set(grams[j])) / len(set(grams[i]) | set(grams[j])) >= 0.5}
    assert region.splits > 1 and sum(compared) < 0.5 * 180 * 179 / 2


def test_regions_of_documents_are_split(spark, monkeypatch):
    """On sf0.1 there are regions over LEAF as it is, so cells and windows are at work there."""
    sizes, homes = [], jaccard.homes

    def seen(members):
        sizes.extend(r[1] for r in members.groupBy("region").count().collect())
        return homes(members)

    monkeypatch.setattr(jaccard, "homes", seen)
    found = jaccard.similar_groups(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert found.where("links < 1 or class_id > doc_id").isEmpty() and max(sizes) > jaccard.LEAF


@pytest.mark.parametrize("cross", [False, True])
def test_metric_pairs(cross):
    rng = np.random.default_rng(3)
    grams = [np.unique(rng.integers(0, 60 if k % 3 else 25, rng.integers(3, 30))).astype(np.uint64) for k in range(190)]
    region, every, side = jaccard.Region(grams, np.array([len(g) for g in grams]), 0.5), np.arange(190), rng.integers(0, 2, 190)
    found = list(region.pairs(every[side == 0], every[side == 1]) if cross else region.pairs(every))
    rows = [(min(i, j), max(i, j), v) for a, b, x in found for i, j, v in zip(a.tolist(), b.tolist(), x)]
    expected = {}
    for a in range(190):
        for b in range(a + 1, 190):
            x, y = set(grams[a].tolist()), set(grams[b].tolist())
            if len(x & y) / len(x | y) >= 0.5 and not (cross and side[a] == side[b]):
                expected[a, b] = len(x & y) / len(x | y)
    assert len(rows) == len(expected) and {r[:2]: r[2] for r in rows} == pytest.approx(expected)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (55, 60), (70, 71)]
    found = dict(jaccard.components(spark.createDataFrame(edges, "doc_id_a long, doc_id_b long")).collect())
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50, 70: 70, 71: 70}


@pytest.mark.parametrize("letters", [1, 2, 4, 30])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 10, 60, 300):
        s = np.append(rng.integers(1, letters + 1, n), 0)
        order = suffix_array.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        shared = suffix_array.common_prefixes(s, order)
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert shared[b] == k


def brute_spans(texts, k):
    where = collections.defaultdict(set)
    words = {i: t.encode().split() for i, t in texts.items()}
    for i, w in words.items():
        for j in range(len(w) - k + 1):
            where[tuple(w[j : j + k])].add(i)
    out = set()
    for i, w in words.items():
        start = end = None
        for j in range(len(w) - k + 1):
            if len(where[tuple(w[j : j + k])]) > 1:
                if end is None or j > end:
                    if end is not None:
                        out.add((i, start, end))
                    start = j
                end = j + k
        if end is not None:
            out.add((i, start, end))
    return out


def test_spans_on_documents(spark, texts):
    found = suffix_array.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {tuple(r)[:3] for r in found.collect()} == brute_spans(texts, suffix_array.K)


def test_spans_of_shuffled_passages(spark):
    rng = random.Random(6)
    passages = [" ".join(rng.choice("a b c d e f".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 30))) for _ in range(12)]
    texts = {i: " ".join(rng.choice(passages) if rng.random() < 0.5 else f"u{rng.randint(0, 999)} v{i}" for _ in range(rng.randint(1, 10))) for i in range(60)}
    found = suffix_array.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 10, 4)
    assert {tuple(r)[:3] for r in found.collect()} == brute_spans(texts, 10)


@pytest.mark.parametrize("swapped", [False, True])
def test_second_place_in_the_first_holder(spark, swapped):
    """Two documents share X P Y; the one with the lesser id, or the greater, holds P again elsewhere."""
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    texts = {}
    for i in range(0, 40, 2):
        x, p, y = some(80), some(60), some(80)
        texts[i + swapped] = f"{x} {p} {y} {some(70)} {p} {some(70)}"
        texts[i + (not swapped)] = f"{x} {p} {y} {some(70)}"
    found = suffix_array.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {tuple(r)[:3] for r in found.collect()} == brute_spans(texts, suffix_array.K)
