"""Exact dedup through a sharded minimal perfect hash of the digests seen before.

The index is a table of one row per shard.  A shard's minimal perfect hash is
a cascade of bit maps: a digest alone at its place of a level gets that bit,
the others go on to the next; a digest's slot is the rank of its bit.  Slots
hold the full digest and the locator of the winner, the least doc_id.  A hash
of this kind sends strangers to some slot, so a lookup counts only where the
slot's 32 bytes equal the digest.  Digests that aren't members are grouped
among themselves, and their least doc_id wins.

Only digests and ids are shuffled, never texts.  Copies of one text are first
combined before the shuffle, so thousands of copies cost one row a partition.
Shards are sized by the number of rows, of the documents or of the index, so one
shard fits in a task at any scale; the index holds their number.

Without documents from before, the index is of the first half of the ids: the
rest is looked up there, and so are the copies within the half.

Defined results: a null text or null doc_id is never a repeat, and its row is
kept.  An empty text is a text.  Rows that repeat both doc_id and text are one
document: one row stays, of rows that differ in other columns the one whose JSON
has the least hash.  Rows of one doc_id with other texts are judged apart.
Ties go to the least doc_id, but a digest of the index keeps its old winner.
Texts of any length are read whole; doc_id must be a whole number.  An empty
table gives none, and other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import fresh, mix, parted, slots, written

SHARD_ROWS = 400_000
LEVELS = 48


def place(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(lo ^ (hi * np.uint64(2 * level + 1))) % np.uint64(size)).astype(np.int64)


def build_levels(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit maps of the cascade and the slot of each of these distinct digests (n x 4 words)."""
    left = np.arange(len(words))
    slot = np.empty(len(words), np.int64)
    levels, base = [], 0
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("digests aren't distinct")
        size = max(64, 2 * len(left))
        at = place(words[left, 0], words[left, 1], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slot


def find_slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot that each digest is sent to, -1 where no level has its bit."""
    slot = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = place(words[left, 0], words[left, 1], k, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        slot[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        left = left[~hit]
    return slot


def _words(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(x.as_py() for x in column) if not isinstance(column, np.ndarray) else column
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].cast("long").alias("id"), F.unhex(F.sha2(docs[text], 256)).alias("digest"))


def _shard(digest, shards: int):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int").alias("shard")


def shards_for(*tables: DataFrame) -> int:
    return max(slots(tables[0].sparkSession), *(-(-t.count() // SHARD_ROWS) for t in tables))


def first_half(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows in the lower half of the range of ids."""
    low, high = docs.agg(F.min(docs[key].cast("long")), F.max(docs[key].cast("long"))).first()
    return docs.where(docs[key].cast("long") <= F.lit(((low or 0) + (high or 0)) // 2))


def build_index(docs: DataFrame, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of these documents, in the shared folder: (shard, shards, sizes, bits, digests, locators), binary but the first two."""
    shards = shards or shards_for(docs)

    def build(rows: pa.Table) -> pa.Table:
        words = _words(rows.column("digest"))
        levels, slot = build_levels(words)
        digests, locators = np.empty_like(words), np.empty(len(words), np.int64)
        digests[slot], locators[slot] = words, rows.column("winner").to_numpy()
        sizes = np.array([len(b) for b in levels], np.int64)
        bits = np.packbits(np.concatenate(levels))
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "shards": pa.array([shards], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in (("sizes", sizes), ("bits", bits), ("digests", digests), ("locators", locators))}})

    found = _digests(docs, key, text).groupBy("digest").agg(F.min("id").alias("winner"))
    built = found.withColumn("shard", _shard("digest", shards)).groupBy("shard").applyInArrow(build, "shard int, shards int, sizes binary, bits binary, digests binary, locators binary")
    return written(docs.sparkSession, built, "exact-index")


def _probe(rows: pa.Table, index: pa.Table) -> pa.Table:
    n = rows.num_rows
    winner = rows.column("first").to_numpy().copy()
    member = np.zeros(n, bool)
    if n and index.num_rows:
        words = _words(rows.column("digest"))
        part = {c: index.column(c)[0].as_py() for c in ("sizes", "bits", "digests", "locators")}
        sizes = np.frombuffer(part["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(part["bits"], np.uint8))[: sizes.sum()].astype(bool)
        slot = find_slots(np.split(bits, np.cumsum(sizes)[:-1]), words)
        held = np.frombuffer(part["digests"], np.uint64).reshape(-1, 4)
        sent = np.flatnonzero(slot >= 0)
        same = (held[slot[sent]] == words[sent]).all(1)
        sent = sent[same]
        member[sent] = True
        winner[sent] = np.frombuffer(part["locators"], np.int64)[slot[sent]]
    return pa.table({"digest": rows.column("digest").combine_chunks(), "winner": winner, "member": member, "n": rows.column("n").combine_chunks(), "again": rows.column("again").combine_chunks()})


def winners(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, digest) of all documents, and (digest, winner, member, n, again) of the distinct digests."""
    rows = _digests(docs, key, text)
    shards = (index.select("shards").first() or [slots(docs.sparkSession)])[0]
    each = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    groups = each.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("rows").alias("again"))
    groups = groups.withColumn("shard", _shard("digest", shards))
    found = groups.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "digest binary, winner long, member boolean, n long, again long")
    return rows, found


def repeats(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, winner_id) of each document to remove."""
    rows, found = winners(docs, index, key, text)
    found = found.where("n > 1 or member").select("digest", "winner")
    pairs = rows.join(found, "digest").where("id <> winner").select("id", "winner").distinct()
    return pairs.toDF("doc_id", "winner_id")


def dedup(docs: DataFrame, history: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that repeat neither a document of history nor one another; the columns of docs."""
    spark = docs.sparkSession
    history = first_half(docs, key) if history is None else history
    rows, found = winners(docs, build_index(history, shards_for(docs, history), key, text), key, text)
    odd = found.where("n > 1 or member or again > 1").select("digest", "winner", "again")
    told = written(spark, rows.join(odd, "digest").distinct(), "exact-dedup")
    gone_id, gone_digest = fresh(docs, "gone_id", "gone_digest")
    gone = told.where("id <> winner").select("id", "digest").toDF(gone_id, gone_digest)
    stay, others = parted(docs, F.xxhash64(docs[key].cast("long")), gone.select(F.xxhash64(gone_id)))
    digest = F.unhex(F.sha2(others[text], 256))
    kept = stay.union(others.join(gone, (others[key].cast("long") == gone[gone_id]) & (digest == gone[gone_digest]), "left_anti"))
    again = told.where("id = winner and again > 1").select("id").distinct()
    if again.isEmpty():
        return kept
    (name,) = fresh(kept, "again_id")
    again = again.toDF(name)
    once = kept.join(again, kept[key].cast("long") == again[name], "left_anti")
    twice = kept.join(again, kept[key].cast("long") == again[name], "left_semi")
    place, columns = fresh(twice, "place")[0], twice.columns
    by = Window.partitionBy(key, text).orderBy(F.xxhash64(F.to_json(F.struct(*columns))))
    return once.union(twice.withColumn(place, F.row_number().over(by)).where(F.col(place) == 1).select(*columns))
