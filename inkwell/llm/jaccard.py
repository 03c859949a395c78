"""Exact Jaccard join of documents on their sets of word n-grams, as a join in a metric space.

Jaccard distance is a metric.  The join is that of pivots, regions and windows;
what goes before it takes away, exactly, what can be in no match, as over
n-gram sets nearly all documents lie at distance 1 from any document chosen as
pivot, where no region can be told from another.

1. Peeling.  A match holds at least ceil(t|x|) n-grams of x.  Tasks send the
   hashes of their documents' n-grams, those that several of their documents
   have only once, and a document goes that has too few n-grams in common with
   all others together.  False positives of the hashes only let more pass.
2. Documents of one same set become a class; its least doc_id stands for it.
   Their n-grams are counted again, those in one class only are cut, and those
   that now have too few go as well.
3. Pivots.  Rare n-grams come first in a global order.  A match shares one of
   the first |x| - ceil(t|x|) + 1 of both; the least document that has an
   n-gram there is the pivot of all others that have it there.  Each pivot's
   region is the documents that it is the pivot of; regions whose pivot belongs
   to another are merged into the least of these, whole.
4. Regions are joined where their sets meet, one task a region; those over
   REGION_BYTES are cut into a grid of blocks.  There, LEAF documents or fewer
   are compared, exactly.  More are split into Voronoi regions: pivots that lie
   far apart, each document to its nearest.  A region of radius rho is joined
   with itself, and with its window: by the triangle inequality only documents
   within rho + (1 - t) of its pivot can match one of it.  Both joins split in
   the same way again until they are small.

The result has a row for each document that has a match, its class and its
number of matches, so thousands of copies or near copies cost a row each and no
match is lost; `similar_pairs` gives the pairs themselves.  Two documents that
meet in several regions are counted in the least of them.

Defined results: null doc_ids, null texts and texts without words match
nothing; doc_id must be a whole number.  Texts of fewer than n words have one
n-gram, all their words.  Rows that repeat a doc_id are one document of several
texts, never paired with one another: what these match is added up, for it and
for the copies that it stands for.  Empty tables give no rows.  Other columns
may have any name.  Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import CHUNK_BYTES, Words, chunks, forget, mapped, mix, parted, ragged, slots, trim, window_hash, without, written

N = 3
THRESHOLD = 0.5
#: Documents that are compared without a further split.
LEAF = 12
#: Pivots of a split.
PIVOTS = 12
#: Bytes of sets in a block of a region.
REGION_BYTES = 16 << 20
#: n-grams that a task holds before it sends them, first of all texts, then of the sets that are left.
RUN = 2_000_000
SET_RUN = 400_000
#: Bytes of text, or of sets, for each slice of a shuffle.
SLICE_BYTES = 12 << 20
NONE = np.int64(np.iinfo(np.int64).min)


# -- sets


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct n-grams of each text, sorted within it, and their offsets."""
    if len(column) > 1 and (len(column) > 60_000 or column.nbytes > 2 * CHUNK_BYTES):
        parts = [sets(p.column(0), n) for p in chunks(pa.RecordBatch.from_arrays([column], names=["text"]))]
        sizes = np.concatenate([np.diff(o) for _, o in parts])
        return np.concatenate([g for g, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])
    words = Words(column)
    g, at = words.grams(n)
    doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
    for k in range(1, n):
        few = np.flatnonzero(words.counts == k)
        if len(few):
            g = np.concatenate([g, window_hash(words.hash, k)[words.first[few]]])
            doc = np.concatenate([doc, few])
    by = np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
    g, doc = g[by], doc[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(column)))])


# -- binary runs: arrays one after another, with their length and widths in front


def dump(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), len(arrays[0]), *(ord(a.dtype.char) for a in arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def parse(raw: bytes) -> list[np.ndarray]:
    count, n = np.frombuffer(raw, np.int64, 2)
    kinds = [np.dtype(chr(c)) for c in np.frombuffer(raw, np.int64, count, 16)]
    out, at = [], 16 + 8 * int(count)
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * kind.itemsize
    return out


def split64(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.uint64)
    return (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)


def join64(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


def runs_by_slice(top: np.ndarray, count: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Runs of each slice; top, the slices, is sorted."""
    edges = np.searchsorted(top, np.arange(count + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), dump(*(a[edges[k] : edges[k + 1]] for a in arrays))


def slice_batch(runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], names=["slice", "run"])


def joined(rows: pa.Table) -> list[np.ndarray]:
    """The runs of a slice, column by column."""
    return [np.concatenate(x) for x in zip(*(parse(r.as_py()) for r in rows.column("run")))]


def bits_for(spark) -> int:
    return int(np.ceil(np.log2(max(64, 2 * slots(spark)))))


def groups_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_keys)]]))


# -- slices: n-grams by the leading bits of their hashes, and by the 32 bits after them within a slice


def bits_of(spark, size: int) -> int:
    """Leading bits, so that a slice is of bounded size however large the input, and all cores have some."""
    return int(np.ceil(np.log2(max(16, slots(spark), -(-size // SLICE_BYTES)))))


def slice_edges(h: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(h)]


def rest_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def packed_rest(rest: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as gaps of three bytes, if none is larger."""
    gap = np.diff(rest, prepend=np.uint32(0)).astype("<u4")
    if len(gap) and int(gap.max()) < 1 << 24:
        return b"3" + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return b"4" + gap.tobytes()


def unpacked_rest(raw: bytes) -> np.ndarray:
    if raw[:1] == b"3":
        gap = np.zeros(((len(raw) - 1) // 3, 4), np.uint8)
        gap[:, :3] = np.frombuffer(raw, np.uint8, -1, 1).reshape(-1, 3)
        gap = gap.reshape(-1).view("<u4")
    else:
        gap = np.frombuffer(raw, "<u4", -1, 1)
    return np.cumsum(gap, dtype=np.uint32)


def batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def by_rows(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(schema, [list(c) for c in zip(*rows)] or [[] for _ in schema.split(", ")])])


# -- 1: peeling

SENT = "slice int, run long, kind int, raw binary"
TOLD = "run long, kind int, raw binary"
SETS = "id long, size long, sig_a long, sig_b long"


def signatures(g: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; size has no zero."""
    starts = np.cumsum(size) - size
    return tuple(np.add.reduceat(mix(g ^ np.uint64(seed)), starts).view(np.int64) if len(g) else np.zeros(0, np.int64) for seed in (0x5EED, 0xF00D))


def least_common(size: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * size - 1e-9).astype(np.int64)


def peeled(rows: DataFrame, n: int, t: float, bits: int) -> DataFrame:
    """(id, size, sig_a, sig_b) of the texts that have enough n-grams in common with any others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, count, number = [], 0, 0
        part_id = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids, size, g = (np.concatenate(x) for x in zip(*held))
            held.clear()
            run, number = np.int64(part_id << 24 | number), number + 1
            full = np.flatnonzero(size)
            ids, size = ids[full], size[full]
            a, b = signatures(g, size)
            doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
            by = np.argsort(g)
            g, doc = g[by], doc[by]
            first, length = groups_of(g)
            own = np.bincount(doc[np.repeat(length > 1, length)], minlength=len(size))
            h, nobody = g[first], len(size)
            kind = np.uint16 if nobody < 65536 else np.uint32
            owner, rest, edges = np.where(length > 1, nobody, doc[first]).astype(kind), rest_of(h, bits), slice_edges(h, bits)
            out = [(k, run, int(np.dtype(kind).itemsize), packed_rest(rest[x:y]) + owner[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            home = int(mix(np.array([run], np.uint64))[0] >> np.uint64(64 - bits))
            out.append((home, run, 0, dump(ids, size, a, b, own)))
            return batch(SENT, list(zip(*out)))

        for some in batches:
            for part in chunks(some):
                g, offsets = sets(part.column("text"), n)
                if len(g):
                    held.append((part.column("id").to_numpy(), np.diff(offsets), g))
                    count += len(g)
                if count > RUN:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def meet(part: pa.Table) -> pa.Table:
        out, rests, owners, runs = [], [], [], []
        for run, kind, raw in zip(part.column("run").to_pylist(), part.column("kind").to_pylist(), part.column("raw")):
            raw = raw.as_buffer()
            if not kind:
                out.append((run, 0, raw.to_pybytes()))
                continue
            width = 3 if raw[:1].to_pybytes() == b"3" else 4
            count = (len(raw) - 1) // (width + kind)
            rests.append(unpacked_rest(memoryview(raw)[: 1 + width * count].tobytes()))
            owners.append(np.frombuffer(raw, np.uint16 if kind == 2 else np.uint32, count, 1 + width * count))
            runs.append(run)
        if rests:
            every = np.sort(np.concatenate(rests))
            again = np.unique(every[1:][every[1:] == every[:-1]])
            for run, rest, owner in zip(runs, rests, owners):
                at = np.minimum(np.searchsorted(again, rest), max(0, len(again) - 1))
                hit = again[at] == rest if len(again) else np.zeros(len(rest), bool)
                out.append((run, 1, dump(owner[hit])))
        return by_rows(TOLD, out)

    def add(part: pa.Table) -> pa.Table:
        told = [(k, parse(r.as_py())) for k, r in zip(part.column("kind").to_pylist(), part.column("raw"))]
        (ids, size, a, b, own), *_ = [x for k, x in told if k == 0]
        total = own.copy()
        for k, x in told:
            if k:
                total += np.bincount(x[0], minlength=len(ids) + 1)[: len(ids)]
        keep = total >= least_common(size, t)
        return pa.table({"id": ids[keep], "size": size[keep], "sig_a": a[keep], "sig_b": b[keep]})

    return rows.transform(mapped, send, SENT).groupBy("slice").applyInArrow(meet, TOLD).groupBy("run").applyInArrow(add, SETS)


# -- 2: sets, in runs of many documents, and questions about all their n-grams

RUNS = "run long, docs binary, grams binary"


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """Runs of the sets of (id, text, sig_a, sig_b, weight), of those texts that have the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, count, number = [], 0, 0
        part_id = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal number
            *docs, g = (np.concatenate(x) for x in zip(*held))
            held.clear()
            number += 1
            return batch(RUNS, [[part_id << 24 | number], [dump(*docs)], [dump(g)]])

        for some in batches:
            for part in chunks(some):
                g, offsets = sets(part.column("text"), n)
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                a, b = signatures(g, size[full])
                ids, sig_a, sig_b, weight = (part.column(c).to_numpy()[full] for c in ("id", "sig_a", "sig_b", "weight"))
                same = (a == sig_a) & (b == sig_b)
                at = full[same]
                if len(at):
                    held.append((ids[same], size[at], weight[same], a[same], b[same], size[at], g[ragged(offsets[at], size[at])]))
                    count += len(held[-1][-1])
                if count > SET_RUN:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return rows.transform(mapped, run, RUNS)


def asked(runs: DataFrame, bits: int, question: Callable, answer: Callable, then: Callable, schema: str) -> DataFrame:
    """What `then` makes of each run and the answers to its question.

    question(docs, grams) gives sorted distinct n-grams and arrays beside them.
    Each slice has them of all runs, every n-gram once a run at most, and gives
    an array of answers, in order, by answer(order, first, length, arrays): the
    order that sorts them, and the groups of equal n-grams in it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for run, docs, grams in zip(*(some.column(k) for k in range(3))):
                h, *arrays = question(parse(docs.as_py()), parse(grams.as_py())[0])
                rest, edges = rest_of(h, bits), slice_edges(h, bits)
                out = [(k, run.as_py(), dump(rest[x:y], *(a[x:y] for a in arrays))) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                yield batch("slice int, run long, raw binary", list(zip(*out)) or [[], [], []])

    def meet(part: pa.Table) -> pa.Table:
        told = [parse(r.as_py()) for r in part.column("raw")]
        rest, *arrays = (np.concatenate(x) for x in zip(*told))
        order = np.argsort(rest, kind="stable")
        answers = answer(order, *groups_of(rest[order]), arrays)
        ends = np.cumsum([len(x[0]) for x in told])
        return by_rows("run long, slice int, raw binary", [(r, s, dump(answers[e - len(x[0]) : e])) for r, s, e, x in zip(part.column("run").to_pylist(), part.column("slice").to_pylist(), ends, told)])

    def put(run: pa.Table, answers: pa.Table) -> pa.Table:
        if not run.num_rows:
            return by_rows(schema, [])
        told = [parse(r.as_py())[0] for r in answers.sort_by("slice").column("raw")]
        return then(run.column("run")[0].as_py(), parse(run.column("docs")[0].as_py()), parse(run.column("grams")[0].as_py())[0], np.concatenate(told) if told else None)

    answers = runs.transform(mapped, send, "slice int, run long, raw binary").groupBy("slice").applyInArrow(meet, "run long, slice int, raw binary")
    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(put, schema)


def ordered(runs: DataFrame, t: float, bits: int) -> DataFrame:
    """Runs of the sets cut to n-grams of several classes, rare ones first, of the classes with enough of them."""

    def question(docs: list[np.ndarray], g: np.ndarray) -> tuple[np.ndarray, ...]:
        h, count = np.unique(g, return_counts=True)
        return h, np.minimum(count, 1 << 30).astype(np.uint32)

    def answer(order, first, length, arrays) -> np.ndarray:
        total = np.add.reduceat(arrays[0][order].astype(np.int64), first)
        rank = np.where(total > 1, np.minimum(255, 1 + np.floor(8 * np.log2(total))), 0).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(rank, length)
        return out

    def then(run, docs, g, told) -> pa.Table:
        ids, size, weight, a, b, held = docs
        rank = told[np.searchsorted(np.unique(g), g)]
        doc = np.repeat(np.arange(len(ids)), held)
        common = np.bincount(doc[rank > 0], minlength=len(ids))
        stay = common >= least_common(size, t)
        keep = np.flatnonzero((rank > 0) & stay[doc])
        keep = keep[np.lexsort((g[keep], rank[keep], doc[keep]))]
        return by_rows(RUNS, [(run, dump(*(x[stay] for x in (ids, size, weight, a, b, common))), dump(g[keep]))]) if len(keep) else by_rows(RUNS, [])

    return asked(runs, bits, question, answer, then, RUNS)


# -- 3: pivots


def first_grams(docs: list[np.ndarray], g: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams among the first of each document that may be shared, and their documents, sorted."""
    ids, size, *_, held = docs
    doc = np.repeat(np.arange(len(ids)), held)
    place = np.arange(len(g)) - np.repeat(np.cumsum(held) - held, held) + (size - held)[doc]
    keep = np.flatnonzero(place <= (size - least_common(size, t))[doc])
    keep = keep[np.lexsort((ids[doc[keep]], g[keep]))]
    return g[keep], doc[keep]


def memberships(runs: DataFrame, t: float, bits: int) -> DataFrame:
    """(id, region, size), distinct: the pivots of each document, with which it shares one of the first n-grams."""

    def question(docs, g) -> tuple[np.ndarray, ...]:
        h, doc = first_grams(docs, g, t)
        first, length = groups_of(h)
        return h[first], docs[0][doc[first]], np.minimum(length, 2).astype(np.uint8)

    def answer(order, first, length, arrays) -> np.ndarray:
        least = np.minimum.reduceat(arrays[0][order], first)
        many = np.add.reduceat(arrays[1][order].astype(np.int64), first) > 1
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(np.where(many, least, NONE), length)
        return out

    def then(run, docs, g, told) -> pa.Table:
        h, doc = first_grams(docs, g, t)
        if not len(h):
            return by_rows("id long, region long, size long", [])
        _, length = groups_of(h)
        pivot = np.repeat(told, length)
        keep = pivot != NONE
        doc, pivot = doc[keep], pivot[keep]
        by = np.lexsort((pivot, doc))
        doc, pivot = doc[by], pivot[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pivot[1:] != pivot[:-1])
        return pa.table({"id": docs[0][doc[new]], "region": pivot[new], "size": docs[5][doc[new]]})

    return asked(runs, bits, question, answer, then, "id long, region long, size long")


def merged(members: DataFrame) -> DataFrame:
    """The memberships with each region moved whole into the least one that its pivot, too, belongs to.

    What met in a region still meets, and documents have fewer regions.
    """
    to = members.groupBy(F.col("id").alias("region")).agg(F.min("region").alias("least"))
    moved = members.join(to, "region", "left").withColumn("region", F.least("region", "least"))
    return moved.groupBy("id", "region").agg(F.max("size").alias("size"))


def homes(members: DataFrame) -> DataFrame:
    """(member, homes): the blocks that each document's set is sent to.

    A region of more than REGION_BYTES is cut into g parts by id; each pair of
    parts is a block, so a document of it has g homes, one otherwise.  Regions
    of one document are none.
    """
    total = members.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") * 8 / REGION_BYTES)).cast("int").alias("grid"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = members.join(total, "region").withColumn("part", F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    home = F.struct("region", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "part")
    return rows.groupBy(F.col("id").alias("member")).agg(F.collect_list(home).alias("homes"), (F.count(F.lit(1)) * F.max("size") * 8).alias("bytes"))


# -- 4: exact joins of regions


class Region:
    """Sets of n-grams that are joined by distance.  Each pair of similar ones is given once, as arrays i, j and Jaccard."""

    def __init__(self, grams: list[np.ndarray], size: np.ndarray, t: float):
        self.size, self.t, self.radius = size.astype(np.int64), t, 1 - t + 1e-9
        self.splits = 0
        held = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams) if len(grams) else np.zeros(0, np.uint64)
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[at] > 1
        self.code = (np.cumsum(count > 1) - 1)[at[keep]]
        self.codes = int((count > 1).sum())
        held = np.bincount(np.repeat(np.arange(len(grams)), held)[keep], minlength=len(grams))
        self.first = np.concatenate([[0], np.cumsum(held)])

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.first[docs + 1] - self.first[docs]
        return self.code[ragged(self.first[docs], length)], np.repeat(np.arange(len(docs)), length)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections, all of a with all of b."""
        code, row = self.of(a)
        other, column = self.of(b)
        distinct = np.unique(code)
        total = np.zeros((len(a), len(b)), np.float32)
        if not len(distinct):
            return total
        at = np.minimum(np.searchsorted(distinct, other), len(distinct) - 1)
        hit = distinct[at] == other
        at, column = at[hit], column[hit]
        code = np.searchsorted(distinct, code)
        step = max(64, (4 << 20) // max(len(a), len(b)))
        for start in range(0, len(distinct), step):
            x, y = np.zeros((len(a), min(step, len(distinct) - start)), np.float32), np.zeros((len(b), min(step, len(distinct) - start)), np.float32)
            here = (code >= start) & (code < start + step)
            x[row[here], code[here] - start] = 1
            here = (at >= start) & (at < start + step)
            y[column[here], at[here] - start] = 1
            total += x @ y.T
        return total

    def distance(self, docs: np.ndarray, pivot: int) -> np.ndarray:
        code, row = self.of(docs)
        mark = np.zeros(self.codes, bool)
        mark[self.of(np.array([pivot]))[0]] = True
        inter = np.bincount(row[mark[code]], minlength=len(docs))
        return np.where(docs == pivot, 0.0, 1 - inter / (self.size[docs] + self.size[pivot] - inter))

    def compared(self, a: np.ndarray, b: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inter = self.shared(a, b).astype(np.float64)
        jaccard = inter / (self.size[a][:, None] + self.size[b][None, :] - inter)
        near = jaccard >= self.t - 1e-12
        i, j = np.nonzero(np.triu(near, 1) if within else near)
        return a[i], b[j], jaccard[i, j]

    def voronoi(self, docs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Pivots far from each other, all distances to them, and the nearest of each document."""
        self.splits += 1
        pivots = [int(docs[int(np.argmin(np.abs(self.size[docs] - np.median(self.size[docs]))))])]
        distance = [self.distance(docs, pivots[0])]
        least = distance[0].copy()
        while len(pivots) < max(2, min(PIVOTS, -(-len(docs) // LEAF))) and least.max() > 0:
            pivots.append(int(docs[int(np.argmax(least))]))
            distance.append(self.distance(docs, pivots[-1]))
            np.minimum(least, distance[-1], out=least)
        every = np.stack(distance)
        return pivots, every, np.argmin(every, 0)

    def pairs(self, a: np.ndarray, b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All similar pairs within a, or of one of a and one of b."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if b is None:
                if len(a) <= LEAF:
                    if len(a) > 1:
                        yield self.compared(a, a, True)
                    continue
                pivots, every, nearest = self.voronoi(a)
                for c in range(len(pivots)):
                    cell = nearest == c
                    window = (nearest > c) & (every[c] <= every[c][cell].max(initial=0) + self.radius)
                    todo += [(a[cell], None), (a[cell], a[window])]
                continue
            if not len(a) or not len(b):
                continue
            if len(a) < len(b):
                a, b = b, a
            if len(b) <= LEAF:
                for start in range(0, len(a), 1024):
                    yield self.compared(a[start : start + 1024], b, False)
                continue
            pivots, every, nearest = self.voronoi(a)
            for c, pivot in enumerate(pivots):
                cell = nearest == c
                todo.append((a[cell], b[self.distance(b, pivot) <= every[c][cell].max(initial=0) + self.radius]))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; label holds the least of each component, in place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


LINKS = "id long, links long, label long"
PAIRS = "doc_id_a long, doc_id_b long, jaccard double"


def block_pairs(ids: np.ndarray, region: Region, part: np.ndarray, earlier: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similar pairs of a block, but for those of one id and those that meet in an earlier region as well."""
    parts = np.unique(part)
    every = np.arange(len(ids))
    found = region.pairs(every) if len(parts) < 2 else region.pairs(every[part == parts[0]], every[part == parts[1]])
    also = np.array([len(x) > 0 for x in earlier])
    if also.any():
        regions, code = np.unique(np.concatenate([np.asarray(x, np.int64) for x in earlier]), return_inverse=True)
        row = np.repeat(every, [len(x) for x in earlier])
        by = np.argsort(row * np.int64(len(regions)) + code)
        keys = row[by] * np.int64(len(regions)) + code[by]
        first = np.searchsorted(row[by], every)
    for i, j, v in found:
        ok = ids[i] != ids[j]
        if also.any():
            both = np.flatnonzero(ok & also[i] & also[j])
            if len(both):
                count = np.array([len(earlier[k]) for k in i[both]])
                which = np.repeat(both, count)
                of_i = keys[ragged(first[i[both]], count)] % len(regions)
                want = j[which] * np.int64(len(regions)) + of_i
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                ok[which[keys[at] == want]] = False
        if ok.any():
            yield i[ok], j[ok], v[ok]


def joined_regions(runs: DataFrame, members: DataFrame, t: float, pairs: bool) -> DataFrame:
    """Of all regions, similar pairs; or for each document in each region its number of links and the least it is connected to."""
    spark = runs.sparkSession
    at = written(spark, homes(members), "jaccard-homes")
    size = at.agg(F.sum("bytes")).first()[0] or 0
    count = max(slots(spark), -(-int(size) // SLICE_BYTES))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for docs, grams in zip(some.column("docs"), some.column("grams")):
                ids, size, weight, a, b, held = parse(docs.as_py())
                g = parse(grams.as_py())[0]
                ends = np.cumsum(held)
                raw = [g[e - k : e].tobytes() for e, k in zip(ends, held)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, size, weight, a)] + [pa.array(raw, pa.binary())], names=["id", "size", "weight", "sig", "grams"])

    def compare(part: pa.Table) -> pa.Table:
        names = ("region", "i", "j", "part", "id", "sig", "size", "weight")
        region, i, j, side, ids, sig, size, weight = (part.column(c).to_numpy() for c in names)
        grams, earlier = part.column("grams"), part.column("earlier")
        order = np.lexsort((sig, ids, j, i, region))
        same = lambda *x: np.logical_and.reduce([v[order][1:] == v[order][:-1] for v in x])
        if len(order) > 1:
            order = order[np.concatenate([[True], ~same(region, i, j, ids, sig)])]
        starts = np.flatnonzero(np.concatenate([[True], ~same(region, i, j)]))
        out = []
        for start, stop in zip(starts, [*starts[1:], len(order)]):
            at = order[start:stop]
            if len(at) < 2:
                continue
            held = Region([np.frombuffer(grams[int(k)].as_py(), np.uint64) for k in at], size[at], t)
            found = block_pairs(ids[at], held, side[at], [earlier[int(k)].as_py() for k in at])
            if pairs:
                out += [(np.minimum(ids[at][x], ids[at][y]), np.maximum(ids[at][x], ids[at][y]), v) for x, y, v in found]
                continue
            links, label = np.zeros(len(at), np.int64), np.arange(len(at))
            for x, y, _ in found:
                np.add.at(links, x, weight[at][y])
                np.add.at(links, y, weight[at][x])
                unite(label, x, y)
            some = np.flatnonzero(links)
            out.append((ids[at][some], links[some], ids[at][label[some]]))
        trim()
        kinds = (np.int64, np.int64, np.float64 if pairs else np.int64)
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, k) for k in kinds]
        return pa.table(dict(zip((x.split()[0] for x in (PAIRS if pairs else LINKS).split(", ")), columns)))

    docs = runs.transform(mapped, unpack, "id long, size long, weight long, sig long, grams binary")
    sent = docs.join(at, docs["id"] == at["member"]).withColumn("home", F.explode("homes"))
    earlier = F.array_distinct(F.transform(F.filter("homes", lambda x: x["region"] < F.col("home")["region"]), lambda x: x["region"]))
    sent = sent.select(F.pmod(F.xxhash64("home.region", "home.i", "home.j"), F.lit(count)).cast("int").alias("slice"), "home.*", "id", "sig", "size", "weight", earlier.alias("earlier"), "grams")
    return sent.groupBy("slice").applyInArrow(compare, PAIRS if pairs else LINKS)


class Found:
    """The tables of a join: members (id, rep), classes (rep, copies), and the regions' results."""

    def __init__(self, docs: DataFrame, n: int, t: float, key: str, text: str, pairs: bool):
        spark = docs.sparkSession
        rows = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        left = written(spark, peeled(rows, n, t, bits_of(spark, size)), "jaccard-peeled")
        keys = ["sig_a", "sig_b", "size"]
        once = left.distinct()
        classes = written(spark, once.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "jaccard-classes")
        self.members = written(spark, once.join(classes, keys).select("id", "rep"), "jaccard-members")
        self.classes = classes.groupBy("rep").agg(F.sum(F.col("weight") - 1).alias("copies"))
        _, met = parted(rows, F.xxhash64("id"), classes.select(F.xxhash64("rep")))
        of_class = met.join(classes.select("rep", "sig_a", "sig_b", "weight"), F.col("id") == F.col("rep")).select("id", "text", "sig_a", "sig_b", "weight")
        runs = written(spark, gathered(of_class, n), "jaccard-sets")
        size = 8 * (classes.agg(F.sum("size")).first()[0] or 0)
        bits = bits_of(spark, size)
        cut = written(spark, ordered(runs, t, bits), "jaccard-ordered")
        forget(left, runs)
        first = written(spark, memberships(cut, t, bits).groupBy("id", "region").agg(F.max("size").alias("size")), "jaccard-pivots")
        second = written(spark, merged(first), "jaccard-regions")
        third = written(spark, merged(second), "jaccard-regions")
        self.result = written(spark, joined_regions(cut, third, t, pairs), "jaccard-found")
        forget(cut, first, second, third)


def similar_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard), a < b, of all pairs of classes with Jaccard t at least, by their least doc_ids, and of each copy with its class at 1."""
    found = Found(docs, n, t, key, text, True)
    copies = found.members.where("id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return found.result.unionByName(copies.distinct())


def similar_groups(docs: DataFrame, n: int = N, t: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links) of each document that has a match: the least doc_id that matches connect it to, and how many documents it matches."""
    found = Found(docs, n, t, key, text, False)
    label = components(found.result.where("id <> label").select(F.col("id").alias("doc_id_a"), F.col("label").alias("doc_id_b"))).toDF("rep", "label")
    links = found.result.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    told = found.classes.join(links, "rep", "left").join(label, "rep", "left")
    told = told.select("rep", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links")).where("links > 0")
    return found.members.distinct().join(told, "rep").groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def components(pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """(id, label) of all ids in pairs; the label is the least id that an id is connected to.

    Labels spread to neighbours and then jump to the label of their label, so
    rounds grow with the logarithm of a chain's length.  Each round is a table
    in the shared folder.
    """
    spark = pairs.sparkSession
    edges = written(spark, pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    table = labels = written(spark, edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("y", "other"), "y").groupBy("x").agg(F.min("other").alias("other"))
        step = labels.join(near, "x").select("x", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        jump = step.join(labels.toDF("of", "farther"), F.col("label") == F.col("of"), "left")
        new = written(spark, jump.select("x", F.least("label", F.coalesce("farther", "label")).alias("label"), "old"), "labels")
        forget(table)
        table, labels = new, new.select("x", "label")
        if new.where("label <> old").isEmpty():
            forget(edges)
            return labels.toDF("id", "label")


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those whom matches connect to a lesser doc_id, with their columns.

    Rows without a doc_id or a text, and those of empty or single texts, stay;
    rows that repeat a doc_id stay or go together; an empty table stays empty.
    """
    gone = similar_groups(docs, n, t, key, text).where("doc_id <> class_id").select(F.col("doc_id").cast(docs.schema[key].dataType))
    return without(docs, gone, key)
