"""Suffix-array dedup: passages of at least K words that stand in several documents.

Shard arrays are built by induced sorting (SA-IS) over word strings: suffixes
are classified in one vectorised pass, leftmost-smaller substrings are sorted
by induction, named, and sorted recursively where names repeat, and the array
is induced from them in linear time.  Common prefixes are permuted (in text
order): only irreducible ones are compared, the rest follow by subtraction.

A shard array finds what repeats within a shard, so windows of K words are
routed by content: a window goes to the shard of the least hash among its
Q-grams.  Equal windows meet whatever document they stand in, and neighbouring
windows mostly share that hash, so a document is cut to few segments.  Hashes
that only one document has drop out before any text moves.  Segments that equal
others are counted by digest, and one of them alone is sent on as reference,
so thousands of copies cost one; it counts as a document of its own, as whatever
equals it stands in several.  Every window that repeats across documents
is found, exactly; runs of them are returned as spans.

Words are what lies between ASCII white space, byte for byte.  Defined results:
null doc_ids, null texts and texts of fewer than K words give no span.  Rows
that repeat a doc_id are one document, so a row repeated whole is no repeat; a
passage that repeats only within its own document isn't reported.  Ties don't
occur: all documents that hold a passage are reported.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import bits_of, dump, groups_of, join64, joined, runs_by_slice, slice_batch, split64
from .kernel import _BASE, _INVERSE, Words, chunks, mapped, mix, parted, ragged, sliding_min, window_hash, written

K = 50
Q = 8
RUN = 500_000


# -- induced sorting


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; s ends with a unique least symbol."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    place = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(place[::-1])[::-1]
    return step[decided] > 0


def induce(s: list[int], small: list[bool], seeds: list[int], counts: np.ndarray) -> list[int]:
    """The suffix order that follows from seeds, leftmost-smaller suffixes put at the ends of their buckets."""
    ends = np.cumsum(counts)
    order = [-1] * len(s)
    tail = ends.tolist()
    for i in reversed(seeds):
        c = s[i]
        tail[c] -= 1
        order[tail[c]] = i
    head = (ends - counts).tolist()
    for i in order:
        if i > 0 and not small[i - 1]:
            i -= 1
            c = s[i]
            order[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for k in range(len(s) - 1, -1, -1):
        i = order[k]
        if i > 0 and small[i - 1]:
            i -= 1
            c = s[i]
            tail[c] -= 1
            order[tail[c]] = i
    return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of s, whose last symbol 0 occurs nowhere else, by induced sorting."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n <= 2:
        return np.array([n - 1, 0][:n], np.int64)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s)
    symbols, types = s.tolist(), small.tolist()
    order = np.array(induce(symbols, types, lms.tolist(), counts), np.int64)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = order[is_lms[order]]
    # Names: neighbours in order with equal substrings, up to the next leftmost-smaller suffix, share one.
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    length[n - 1] = 1
    a, b = by[:-1], by[1:]
    same = length[a] == length[b]
    x, y, size = a[same], b[same], length[a[same]]
    if len(x):
        i, j = ragged(x, size), ragged(y, size)
        equal = (s[i] == s[j]) & (small[i] == small[j])
        same[np.flatnonzero(same)] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    names = np.zeros(n, np.int64)
    names[by] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        inner = suffix_array(reduced)
    else:
        inner = np.empty(len(lms), np.int64)
        inner[reduced] = np.arange(len(lms))
    return np.array(induce(symbols, types, lms[inner].tolist(), counts), np.int64)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """PLCP: the symbols that each suffix shares with the one before it in order, by text position."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    reducible = (before > 0) & (here > 0)
    reducible[reducible] = s[here[reducible] - 1] == s[before[reducible] - 1]
    reducible &= np.concatenate([[False], before[1:] - 1 == before[:-1]])
    start = np.flatnonzero(~reducible)
    length = np.zeros(len(start), np.int64)
    live = np.flatnonzero(before[start] >= 0)
    k = 0
    while len(live):
        i, j = start[live] + k, before[start[live]] + k
        ok = (i < n) & (j < n)
        ok[ok] = s[i[ok]] == s[j[ok]]
        live = live[ok]
        k += 1
        length[live] = k
    of = np.cumsum(~reducible) - 1
    return np.maximum(length[of] - (here - start[of]), 0)


def repeated_starts(s: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Positions whose k symbols stand in texts of at least two documents, in order."""
    order = suffix_array(s)
    prefix = common_prefixes(s, order)[order]
    run = np.cumsum(prefix < k)
    d = doc[order]
    first, length = groups_of(run)
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    return np.sort(order[np.repeat(many & (length > 1), length)])


# -- segments


def segments(words: Words, k: int, q: int) -> tuple[np.ndarray, ...]:
    """(routing hash, digest, text, first word, windows) of the runs of windows with one hash."""
    m = len(words.hash) - k + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    least = sliding_min(window_hash(words.hash, q), k - q + 1)[:m]
    valid = words.doc[:m] == words.doc[k - 1 :]
    edge = np.ones(m + 1, bool)
    edge[1:m] = (least[1:] != least[:-1]) | (words.doc[1:m] != words.doc[: m - 1]) | (valid[1:] != valid[:-1])
    cut = np.flatnonzero(edge)
    start, count = cut[:-1], np.diff(cut)
    ok = valid[start]
    start, count = start[ok], count[ok]
    doc = words.doc[start]
    return least[start], digests(words.hash, start, count + k - 1), doc, start - words.first[doc], count


def digests(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each range of words."""
    n = len(h)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    if n:
        up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(7)) * up, out=total[1:])
    return mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64))


def slice_bits(rows: DataFrame) -> int:
    """As many shards as the text needs, so that one is about the same at any size."""
    return bits_of(rows.sparkSession, 2 * (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0))


def route(rows: DataFrame, k: int, q: int, bits: int) -> DataFrame:
    """(whole, id, hash, start, windows, digest) of the segments whose hash several documents have.

    whole: the segment equals one of another document, so it repeats whole.
    Of the others, and of one of each set of equals, the text is needed (whole null or false).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            v, d, ids, start, count = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.argsort(v)
            v, d, ids, start, count = (x[by] for x in (v, d, ids, start, count))
            yield slice_batch([*runs_by_slice((v >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, v, d, *split64(ids), start.astype(np.uint32), count.astype(np.uint32))])

        for batch in batches:
            for part in chunks(batch):
                v, d, doc, start, count = segments(Words(part.column("text"), "raw"), k, q)
                if len(v):
                    # min-hashes crowd at the low end: mixed, slices are even
                    held.append((mix(v), d, part.column("id").to_numpy()[doc], start, count))
                if sum(len(x[0]) for x in held) > RUN:
                    yield from flush()
        if held:
            yield from flush()

    def meet(part: pa.Table) -> pa.Table:
        v, d, high, low, start, count = joined(part)
        ids = join64(high, low).astype(np.int64)
        by = np.lexsort((start, ids, d, v))
        v, d, ids, start, count = (x[by] for x in (v, d, ids, start.astype(np.int32), count.astype(np.int32)))

        def several(group_first: np.ndarray, length: np.ndarray) -> np.ndarray:
            return np.repeat(np.minimum.reduceat(ids, group_first) != np.maximum.reduceat(ids, group_first), length)

        first, length = groups_of(v)
        live = several(first, length)
        same = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
        first = np.flatnonzero(same)
        length = np.diff(np.append(first, len(v)))
        whole = several(first, length)
        # Text is needed where some segment of the hash is alone; of equals, only of the first.
        begin, size = groups_of(v)
        alone = np.repeat(np.logical_or.reduceat(~whole, begin), size)
        keep = live & (whole | alone)
        ship = live & alone & (~whole | same)
        out = {"whole": whole, "ship": ship, "id": ids, "hash": v.astype(np.int64), "start": start, "windows": count, "digest": d.astype(np.int64)}
        return pa.table({n: a[keep] for n, a in out.items()})

    return rows.transform(mapped, send, "slice int, run binary").groupBy("slice").applyInArrow(meet, "whole boolean, ship boolean, id long, hash long, start int, windows int, digest long")


def shard_spans(part: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first word, end) of the repeated runs in the segments of a shard."""
    words: list[bytes] = []
    lengths = []
    for t in part.column("text"):
        w = t.as_py().split()
        words += w
        lengths.append(len(w))
    length = np.array(lengths, np.int64)
    code, _ = pd.factorize(np.array(words, object))
    n, m = len(lengths), int(code.max(initial=-1)) + 1
    # Each segment ends with a symbol of its own, greater than all words; 0 ends the string.
    s = np.zeros(len(code) + n + 1, np.int64)
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    s[ragged(begin[:-1], length)] = code + 1
    s[begin[1:] - 1] = m + 1 + np.arange(n)
    ids = part.column("id").to_numpy()
    model = np.unique(ids, return_inverse=True)[1]
    # Several documents hold a reference, so it is none of them: a second place in its first holder meets another document.
    model[part.column("whole").to_numpy(zero_copy_only=False)] = n
    doc = np.append(np.repeat(model, length + 1), -1)
    at = repeated_starts(s, doc, k)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.searchsorted(begin, at, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of) > 0)]))
    last = np.append(first[1:], len(at)) - 1
    start = at[first] - begin[of[first]] + part.column("start").to_numpy()[of[first]]
    return ids[of[first]], start, start + (at[last] - at[first]) + k


def repeated_spans(docs: DataFrame, k: int = K, q: int = Q, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words): maximal runs of words covered by repeated windows of k words."""
    spark = docs.sparkSession
    rows = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    bits = slice_bits(rows)
    found = written(spark, route(rows, k, q, bits), "suffix-segments")
    wanted = found.where("ship").groupBy(F.col("id").alias("member")).agg(F.collect_list(F.struct("hash", "start", "windows", "digest", "whole")).alias("wanted"))
    wanted = written(spark, wanted, "suffix-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), "raw")
                lists = part.column("wanted")
                at = np.asarray(lists.offsets, np.int64)
                inner = lists.values.slice(at[0], at[-1] - at[0])
                v, start, windows, digest, whole = (inner.field(x).to_numpy(zero_copy_only=False) for x in range(5))
                doc = np.repeat(np.arange(len(lists)), np.diff(at))
                length = windows.astype(np.int64) + k - 1
                begin = words.first[doc] + start
                good = begin + length <= words.first[doc + 1]
                v, start, digest, whole, doc, length, begin = (x[good] for x in (v, start, digest, whole, doc, length, begin))
                good = digests(words.hash, begin, length).astype(np.int64) == digest
                v, start, whole, doc, length, begin = (x[good] for x in (v, start, whole, doc, length, begin))
                raw = words.buf.tobytes()
                texts = pa.array([raw[a:b] for a, b in zip(words.start[begin].tolist(), words.end[begin + length - 1].tolist())], pa.binary())
                shard = (v.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("id").take(pa.array(doc)), pa.array(start), pa.array(whole), texts], names=["shard", "id", "start", "whole", "text"])

    def build(part: pa.Table) -> pa.Table:
        ids, start, end = shard_spans(part, k)
        return pa.table({"id": ids, "start": start.astype(np.int32), "stop": end.astype(np.int32)})

    _, met = parted(rows, F.xxhash64("id"), wanted.select(F.xxhash64("member")))
    shipped = met.join(wanted, met["id"] == wanted["member"]).select("id", "text", "wanted").transform(mapped, cut, "shard int, id long, start int, whole boolean, text binary")
    inside = shipped.groupBy("shard").applyInArrow(build, "id long, start int, stop int")
    whole = found.where("whole").select("id", "start", (F.col("start") + F.col("windows") + F.lit(k - 1)).alias("stop"))
    spans = whole.unionByName(inside)
    by = Window.partitionBy("id").orderBy("start", "stop")
    edge = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (edge.isNull() | (F.col("start") > edge)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
    return merged.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
