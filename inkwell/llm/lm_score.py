"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the whole corpus and cut to
levels, 1 + floor(log_b count).  Into a Bloom filter goes (n-gram, j) for each
j up to its level; a count is read back by probing j = 1, 2, ... until one
isn't a member, so it is never too low, and by one level too high with
probability 2**-PROBES.  Scores are interpolated probabilities of the counts
read back.

Tasks send their distinct hashes and counts as sorted binary runs, cut by the
leading bits of the hash; each slice is merged by one task, which also builds
its part of the filter.  Nothing but the filter reaches the driver.  It grows
with the number of distinct n-grams, those seen once included, and its size is
checked: it is broadcast in segments of at most segment_bytes, which the
workers probe one after another, so a worker holds one segment at a time, and
asks it for the n-grams of a whole batch of texts.  Slices are as many as the
text needs, so that a task merges about the same at any size.

Defined results: a null text has null scores, a text without words has zero
words, log probability 0 and perplexity null.  Repeated rows count and score
each by itself.  A null doc_id is scored.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Words, chunks, mapped, mix, slots

PROBES = 6
BITS = PROBES / np.log(2)
BASE = 2.0
MIN_COUNT = 1
WEIGHT = 0.7
RUN = 2_000_000
SEGMENT_BYTES = 256 << 20
SLICE_BYTES = 8 << 20
PAIR = np.uint64(0xA5A5A5A5DEADBEEF)


def hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, at = words.grams(2)
    return words.hash, mix(grams ^ PAIR), at


def pack(h: np.ndarray, n: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """Sorted hashes and counts as runs of each slice: 48 bits a hash, one byte a count below 255."""
    edges = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate([[0], edges, [len(h)]])
    low = (h << np.uint64(bits)) >> np.uint64(16)
    out = []
    for k in np.flatnonzero(np.diff(edges)):
        part = slice(edges[k], edges[k + 1])
        size, count = len(low[part]), n[part]
        big = count >= 255
        out.append((int(k), np.int64(size).tobytes() + (low[part] >> np.uint64(32)).astype(np.uint16).tobytes() + low[part].astype(np.uint32).tobytes() + np.where(big, 255, count).astype(np.uint8).tobytes() + count[big].astype(np.int64).tobytes()))
    return out


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    high, low = np.frombuffer(raw, np.uint16, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 2 * n)
    count = np.frombuffer(raw, np.uint8, n, 8 + 6 * n).astype(np.int64)
    count[count == 255] = np.frombuffer(raw[8 + 7 * n :], np.int64)
    return (high.astype(np.uint64) << np.uint64(32)) | low, count


def level(count: np.ndarray, base: float = BASE) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def middle(levels: np.ndarray, base: float = BASE) -> np.ndarray:
    """The count that stands for a level: the middle of its range; 0 for level 0."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(base ** levels.astype(float) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def probe_places(h: np.ndarray, j: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    one = mix(h + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    two = mix(one) | np.uint64(1)
    for k in range(PROBES):
        yield (one + np.uint64(k) * two) % size.astype(np.uint64)


class Segment:
    """Neighbouring slices of the filter: their bits one after another."""

    def __init__(self, first: int, sizes: list[int], raw: list[bytes]):
        self.first, self.sizes = first, np.array(sizes, np.int64)
        self.at = np.concatenate([[0], np.cumsum((self.sizes + 7) // 8)])[:-1] * 8
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def levels(self, low: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Levels of hashes whose slices are here, by repeated membership probes."""
        out = np.zeros(len(low), np.int64)
        which = which - self.first
        left, j = np.flatnonzero(self.sizes[which] > 0), 1
        while len(left):
            member = np.ones(len(left), bool)
            for place in probe_places(low[left], np.full(len(left), j), self.sizes[which[left]]):
                bit = self.at[which[left]] + place.astype(np.int64)
                member &= (self.raw[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            left = left[member]
            out[left] = j
            j += 1
        return out


def slice_bits(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.ceil(np.log2(max(64, 4 * slots(rows.sparkSession), -(-size // SLICE_BYTES)))))


def train(docs: DataFrame, text: str = "text", min_count: int = MIN_COUNT, segment_bytes: int = SEGMENT_BYTES) -> dict:
    """The model: broadcast segments of the filter, tokens and types of the corpus."""
    spark = docs.sparkSession
    rows = docs.where(docs[text].isNotNull()).select(docs[text].alias("text"))
    bits = slice_bits(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for order in (0, 1):
                if held[order]:
                    runs = pack(*np.unique(np.concatenate(held[order]), return_counts=True), bits)
                    held[order].clear()
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in runs], pa.int32()), pa.array([order] * len(runs), pa.int32()), pa.array([r for _, r in runs], pa.binary())], names=["slice", "order", "run"])

        for batch in batches:
            for part in chunks(batch):
                one, two, _ = hashes(Words(part.column("text")))
                held[0].append(one)
                held[1].append(two)
                if sum(map(len, held[1])) > RUN:
                    yield from flush()
        yield from flush()

    def build(rows: pa.Table) -> pa.Table:
        orders, tokens, types, entries = rows.column("order").to_numpy(), 0, 0, []
        for order in (0, 1):
            runs = [unpack(r.as_py()) for r, o in zip(rows.column("run"), orders) if o == order]
            if not runs:
                continue
            h, n = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
            by = np.argsort(h, kind="stable")
            h, n = h[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, n = h[first], np.add.reduceat(n, first)
            if order == 0:
                tokens, types = int(n.sum()), len(n)
            else:
                h, n = h[n >= min_count], n[n >= min_count]
            entries.append((h, level(n)))
        h, top = (np.concatenate(x) for x in zip(*entries))
        size = int(np.ceil(top.sum() * BITS)) + 64
        filled = np.zeros(size, bool)
        for j in range(1, int(top.max(initial=0)) + 1):
            now = h[top >= j]
            for place in probe_places(now, np.full(len(now), j), np.full(len(now), size)):
                filled[place.astype(np.int64)] = True
        raw = np.packbits(filled, bitorder="little").tobytes()
        return pa.table({"slice": rows.column("slice").slice(0, 1).combine_chunks(), "size": pa.array([size], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "types": pa.array([types], pa.int64()), "bits": pa.array([raw], pa.binary())})

    parts = rows.transform(mapped, gather, "slice int, order int, run binary").groupBy("slice").applyInArrow(build, "slice int, size long, tokens long, types long, bits binary")
    from .kernel import written

    parts = written(spark, parts, "lm-filter")
    sizes = {r[0]: r[1:] for r in parts.select("slice", "size", "tokens", "types").collect()}
    segments, start = [], 0
    while start < 1 << bits:
        stop, total = start, 0
        while stop < 1 << bits and (stop == start or total + sizes.get(stop, (0,))[0] // 8 <= segment_bytes):
            total += sizes.get(stop, (0,))[0] // 8
            stop += 1
        raw = {r[0]: bytes(r[1]) for r in parts.where(f"slice >= {start} and slice < {stop}").select("slice", "bits").collect()}
        length = [sizes.get(k, (0,))[0] for k in range(start, stop)]
        segments.append((start, stop, spark.sparkContext.broadcast(Segment(start, length, [raw.get(k, b"") for k in range(start, stop)]))))
        start = stop
    return {"bits": bits, "segments": segments, "tokens": sum(x[1] for x in sizes.values()), "types": sum(x[2] for x in sizes.values())}


def levels_of(model: dict, h: np.ndarray) -> np.ndarray:
    bits = np.uint64(model["bits"])
    which = (h >> (np.uint64(64) - bits)).astype(np.int64)
    low = (h << bits) >> np.uint64(16)
    out = np.zeros(len(h), np.int64)
    for start, stop, held in model["segments"]:
        at = np.flatnonzero((which >= start) & (which < stop))
        out[at] = held.value.levels(low[at], which[at])
        if len(model["segments"]) > 1:
            del held._value  # the next segment takes its place in memory
    return out


def text_scores(columns: list[pa.Array], model: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and log probability of each text of each column; the filter is asked once for all of them."""
    held, asked = [], []
    for column in columns:
        words = Words(column)
        one, two, at = hashes(words)
        (code_one, distinct_one), (code_two, distinct_two) = pd.factorize(one), pd.factorize(two)
        held.append((words.counts, words.first, at, code_one, code_two))
        asked += [distinct_one, distinct_two]
    ends = np.cumsum([0, *map(len, asked)])
    read = middle(levels_of(model, np.concatenate(asked))) if asked else np.zeros(0)
    for k, (counts, first, at, code_one, code_two) in enumerate(held):
        of_one, of_two = read[ends[2 * k] :][code_one], read[ends[2 * k + 1] :][code_two]
        single = (of_one + 0.5) / (model["tokens"] + 0.5 * (model["types"] + 1))
        p = single.copy()
        p[at + 1] = WEIGHT * np.minimum(of_two / np.maximum(of_one[at], 1), 1.0) + (1 - WEIGHT) * single[at + 1]
        total = np.concatenate([[0.0], np.cumsum(np.log(p))])
        yield counts, total[first[1:]] - total[first[:-1]]


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(chunks(batch))
            together = len(parts) if len(model["segments"]) > 1 else 1
            scored = (x for k in range(0, len(parts), together) for x in text_scores([p.column("text") for p in parts[k : k + together]], model))
            for part, (n, log_prob) in zip(parts, scored):
                column = part.column("text")
                null = np.asarray(column.is_null())
                with np.errstate(invalid="ignore", divide="ignore"):
                    perplexity = np.exp(-log_prob / n)
                columns = [pa.array(n.astype(np.int32), mask=null), pa.array(log_prob, mask=null), pa.array(perplexity, mask=null | (n == 0))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n_words", "log_prob", "perplexity"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n_words", T.IntegerType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    return docs.select(docs[key].alias("id"), docs[text].alias("text")).transform(mapped, run, schema).withColumnRenamed("id", key)
