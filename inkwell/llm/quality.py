"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, word pairs and word stems,
the first bytes of words): one of the target, the documents labelled good and
not toxic, one of all raw text.  A passage of PASSAGE tokens has as weight the
ratio of the two models' probabilities, and a document that of the worst passage
that begins at any of its tokens, so a few bad words aren't drowned in a long text.  A second weight
looks at the whole document: the ratios of its telling stems, those under
TELLING, added up and divided by the root of its length, so a stem that good
text has now and then counts when it keeps coming back.  Each is divided by the
threshold that best parts the held-out half of the labelled sample, and the
worse of the two is the document's log weight, with -1 as the border.  The
documents with the k largest keys, log weight / temperature + Gumbel noise, are
the sample; k is the number of documents on the good side of the border.

The raw model counts every token of every document.  At most `labelled` rows of
labels, the least by hash, are used: half fit the target model, half set the
thresholds.  Models have a fixed size and are broadcast; the labelled sample is
broadcast under that same bound.  The noise is a function of doc_id and seed,
so a lost task that runs again draws the same.  No text is shuffled.

Defined results: a null text is rejected; a text without tokens has weight 0.
A null doc_id draws the noise of 0.  Repeated rows have equal keys and stand or
fall together: ties at the k-th key are all kept.  Labels with nulls are
ignored, repeated ones count as the worst of them.  Without labels of both
classes nothing is rejected but null texts.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Words, chunks, filtered, mapped, mix, written

BUCKETS = 1 << 20
STEM_BUCKETS = 1 << 22
SIZE = 2 * BUCKETS + STEM_BUCKETS
SLICES = 64
WIDTH = SIZE // SLICES
STEMS = (4, 5, 6, 7, 8)
PASSAGE = 8
TELLING = -1.0
LABELLED = 20_000
TEMPERATURE = 0.05
SEED = 17
#: Pseudo-counts of words, pairs and stems, in units of the target's counts; a passage's stems are those of 4 bytes.
PRIOR = (1.0, 50.0, 3.0)
TWICE = np.uint64(12345)


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, token) of each n-gram: words, pairs, then stems by length."""
    size = np.uint64(BUCKETS)
    grams, at = words.grams(2)
    if len(at):
        grams = np.where(words.hash[at] == words.hash[at + 1], TWICE, grams)
    every = np.arange(len(words.start))
    out = [((words.hash % size).astype(np.int64), every), ((mix(grams + np.uint64(99)) % size).astype(np.int64) + BUCKETS, at)]
    padded = np.concatenate([words.buf, np.zeros(max(STEMS), np.uint8)])
    length = words.end - words.start
    prefix = np.zeros(len(every), np.uint64)
    for k in range(max(STEMS)):
        prefix |= padded[words.start + k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in STEMS:
            long = np.flatnonzero(length > k + 1)
            out.append(((mix(prefix[long] * np.uint64(77) + np.uint64(k)) % np.uint64(STEM_BUCKETS)).astype(np.int64) + 2 * BUCKETS, long))
    return out


def log_weights(column: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least log weight of a passage, and the weight of the telling stems, for each text."""
    words = Words(column, "both")
    value, stem = np.zeros(len(words.start), np.int64), np.zeros(len(words.start))
    for k, (bucket, at) in enumerate(features(words)):
        if k < 3:
            value[at] += np.rint(ratio[bucket] * 65536.0).astype(np.int64)  # whole numbers: a text weighs the same in whatever batch it is
        if k >= 2:
            stem[at] = np.minimum(stem[at], ratio[bucket])
    worst, whole = np.zeros(len(column)), np.zeros(len(column))
    if len(value):
        total, at = np.concatenate([[0], np.cumsum(value)]), np.arange(len(value))
        last = words.first[words.doc + 1]
        starts = np.flatnonzero((at + PASSAGE <= last) | (at == words.first[words.doc]))
        sums = (total[np.minimum(starts + PASSAGE, last[starts])] - total[starts]) / 65536.0
        full = np.flatnonzero(words.counts)
        worst[full] = np.minimum(np.minimum.reduceat(sums, np.searchsorted(starts, words.first[:-1][full])), 0.0)
        whole = np.bincount(words.doc, np.where(stem < TELLING, stem, 0.0), minlength=len(column)) / np.sqrt(words.counts + 50)
    return worst, np.round(whole, 6)


def count_models(docs: DataFrame, sample: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets in all texts and in the target's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(SIZE, np.uint32), np.zeros(SIZE, np.uint32)
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), "both")
                fit = part.column("fit").to_numpy(zero_copy_only=False).astype(bool)[words.doc]
                for bucket, at in features(words):
                    np.add.at(raw, bucket, np.uint32(1))
                    np.add.at(target, bucket[fit[at]], np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(SLICES):
            r, t = raw[k * WIDTH : (k + 1) * WIDTH], target[k * WIDTH : (k + 1) * WIDTH]
            at = np.flatnonzero(r)
            if len(at):
                run = pack.compress(b"".join(a.astype(np.uint32).tobytes() for a in (np.diff(at, prepend=0), r[at], t[at])))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([run], pa.binary())], names=["slice", "run"])

    def add(rows: pa.Table) -> pa.Table:
        total, unpack = np.zeros((2, WIDTH), np.int64), zstandard.ZstdDecompressor()
        for run in rows.column("run"):
            gap, raw, target = np.frombuffer(unpack.decompress(run.as_py()), np.uint32).reshape(3, -1)
            at = np.cumsum(gap, dtype=np.int64)
            total[0, at] += raw
            total[1, at] += target
        return pa.table({"slice": rows.column("slice").slice(0, 1).combine_chunks(), "raw": pa.array([total[0].astype(np.float32).tobytes()], pa.binary()), "target": pa.array([total[1].astype(np.float32).tobytes()], pa.binary())})

    rows = _flagged(docs, sample, key, text).select("text", (F.coalesce("good", F.lit(False)) & F.coalesce("fit", F.lit(False))).alias("fit"))
    slices = rows.transform(mapped, count, "slice int, run binary").groupBy("slice").applyInArrow(add, "slice int, raw binary, target binary").collect()
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    for row in slices:
        at = slice(row["slice"] * WIDTH, (row["slice"] + 1) * WIDTH)
        raw[at], target[at] = np.frombuffer(row["raw"], np.float32), np.frombuffer(row["target"], np.float32)
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    share = target[:BUCKETS].sum() / max(1.0, raw[:BUCKETS].sum())
    prior = np.repeat(PRIOR, [BUCKETS, BUCKETS, STEM_BUCKETS])
    return np.log((target + prior) / (raw * share + prior)).astype(np.float32)


def _flagged(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.where(docs[text].isNotNull()).select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    return rows.join(F.broadcast(sample), rows["id"] == sample["label_id"], "left")


def labelled_sample(labels: DataFrame, bound: int) -> DataFrame:
    """(label_id, good, fit) of at most so many labelled documents."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("sample"), "label_id")).orderBy("h", "label_id").limit(bound)
    return rows.select("label_id", "good", (F.pmod(F.xxhash64(F.lit("half"), "label_id"), F.lit(2)) == 0).alias("fit"))


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap that leaves the fewest on the wrong side."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    good, bad = np.sort(good), np.sort(bad)
    wrong = np.searchsorted(good, cuts) + len(bad) - np.searchsorted(bad, cuts)
    best = np.flatnonzero(wrong == wrong.min())
    return float(cuts[best[len(best) // 2]])


def gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(key, F.lit(0))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096, small: int = 20_000) -> float:
    """The exact k-th largest value of a column, by counting in ever finer bins."""
    row = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    low, high, n = row
    if not n or k >= n:
        return -np.inf if low is None else low
    while True:
        inside = scores.where(F.col(column).between(low, high))
        if n <= small or low == high:
            values = sorted((r[0] for r in inside.groupBy(column).count().orderBy(F.desc(column)).limit(small).collect()), reverse=True) if low != high else [low]
            counts = {r[0]: r[1] for r in inside.groupBy(column).count().collect()} if low != high else {low: k}
            for v in values:
                k -= counts[v]
                if k <= 0:
                    return v
            return low
        step = (high - low) / bins
        found = inside.groupBy(F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]


def best_pair(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Thresholds of the two weights, n x 2, that together leave few on the wrong side: each in turn, the other held."""
    cuts = [-np.inf, -np.inf]
    for k in (0, 1, 0, 1):
        here = [x[x[:, 1 - k] >= cuts[1 - k]][:, k] for x in (good, bad)]
        cuts[k] = min(best_threshold(*here), -1e-3)
    return cuts[0], cuts[1]


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", labelled: int = LABELLED, temperature: float = TEMPERATURE, seed: int = SEED) -> tuple[DataFrame, Callable[[float], DataFrame]]:
    """(doc_id, log_weight, key) of all texts, in the shared folder, and the rows of docs from a key on."""
    spark = docs.sparkSession
    sample = written(spark, labelled_sample(labels, labelled), "labelled")
    model = spark.sparkContext.broadcast(log_ratio(*count_models(docs, sample, key, text)))

    def weigh(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [log_weights(part.column("text"), model.value) for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        worst, whole = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0), np.zeros(0))
        return worst, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, weigh(batch.column("text")))], names=["doc_id", "worst", "whole"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("worst", T.DoubleType()), T.StructField("whole", T.DoubleType())])
    rows = docs.where(docs[text].isNotNull())
    told = written(spark, rows.select(docs[key].alias("id"), docs[text].alias("text")).transform(mapped, run, schema), "quality")
    held = told.join(F.broadcast(sample.where("not fit")), told["doc_id"].cast("long") == sample["label_id"]).select("good", "worst", "whole").collect()
    sides = [np.array([r[1:] for r in held if r[0] == side], float).reshape(-1, 2) for side in (True, False)]
    worst, whole = best_pair(*sides)

    def keys(w1, w2, noise, least=F.least):
        return least(w1 / -worst, w2 / -whole) / temperature + noise

    told = told.withColumn("key", keys(F.col("worst"), F.col("whole"), gumbel(F.col("doc_id").cast("long"), seed)))
    told = told.select("doc_id", F.least(F.col("worst") / -worst, F.col("whole") / -whole).alias("log_weight"), "key")

    def at_least(least: float) -> DataFrame:
        column = docs.columns.index(docs.select(docs[text]).columns[0])
        return filtered(rows, gumbel(docs[key].cast("long"), seed), lambda batch, noise: keys(*weigh(batch.column(column)), noise.to_numpy(), np.minimum) >= least)

    return told, at_least


def least_key(told: DataFrame) -> float:
    """The k-th largest key, for as many documents as are on the good side."""
    k = told.where("log_weight >= -1").count()
    return kth_largest(told, "key", k) if k else np.inf


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(doc_id, log_weight, key) of the documents that are kept."""
    told, _ = scores(docs, labels, key, text, **more)
    return told.where(F.col("key") >= least_key(told))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Texts are weighed once more where they lie, which costs less than to bring
    each text and its weight together.
    """
    told, at_least = scores(docs, labels, key, text, **more)
    return at_least(float(least_key(told)))
