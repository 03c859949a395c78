"""Vectorised text kernels on Arrow batches, shared by the operators.

Every function works on whole Arrow string columns as a flat byte buffer with
offsets, so the cost per word is that of a few numpy passes.  Batches are cut
into chunks of bounded bytes at document boundaries; a document is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many bytes of text, or of one document, and of 60,000 rows."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), start + 60_000, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Beyond ASCII, code points are looked up: letters, marks and numbers make words, all else (quotes, dashes, hard blanks) parts them.
_PLANES = 0x20000
_LETTERS: list[np.ndarray] = []


def letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters, marks or numbers."""
    inside = WORD[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    if not len(lead):
        return inside
    if not _LETTERS:
        import unicodedata

        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(_PLANES)]))
    first = buf[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    padded = np.concatenate([buf, np.zeros(4, np.uint8)])
    code = first & np.where(size == 2, 31, np.where(size == 3, 15, 7))
    for k in range(1, 4):
        code = np.where(size > k, code << 6 | padded[lead + k] & 63, code)
    bad = ~_LETTERS[0][np.minimum(code, _PLANES - 1)] & (code < _PLANES)
    for k in range(4):
        at = lead[bad & (size > k)] + k
        inside[at[at < len(buf)]] = False
    return inside


class Words:
    """Tokens of a chunk: byte spans, 64-bit hashes and the document of each.

    kind "word": maximal runs of letters and digits of the lower-cased text.
    kind "both": the same, with runs of punctuation as tokens of their own.
    kind "raw": what lies between ASCII white space, unchanged.
    """

    def __init__(self, column: pa.Array, kind: str = "word", hashes: bool = True):
        if kind != "raw":
            try:
                column = pc.utf8_lower(column)
            except pa.ArrowInvalid:  # bytes that aren't UTF-8
                column = pc.utf8_lower(pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.large_string()))
        self.buf, self.offsets = flat(column)
        n, buf = len(self.buf), self.buf
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        if kind == "both":
            of = np.where(letters(buf), 1, np.where(SPACE[buf], 0, 2)).astype(np.uint8)
            edge = np.empty(n + 1, bool)
            edge[1:n] = of[1:] != of[:-1]
            edge[0] = edge[n] = True
            edge |= first
            cuts = np.flatnonzero(edge)
            live = of[cuts[:-1]] > 0 if n else np.zeros(0, bool)
            self.start, self.end = cuts[:-1][live], cuts[1:][live]
        else:
            inside = np.zeros(n + 2, bool)
            inside[1:-1] = ~SPACE[buf] if kind == "raw" else letters(buf)
            self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
            self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        self.counts = np.diff(np.searchsorted(self.start, self.offsets))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.buf] * up, out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams of tokens, and the token each begins at.  A document of fewer tokens has none."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return window_hash(self.hash, n)[at], at


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring hashes, in order."""
    m = len(h) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total *= _BASE
        total += h[k : k + m]
    return mix(total)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    if w <= 1:
        return v
    out, have = v, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        rest = w - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


BLOOM_BITS = 1 << 30
BLOOM_BLOCK = 1 << 20
BLOOM_PROBES = 6


def _probes(h: np.ndarray, count: int) -> Iterator[np.ndarray]:
    one = mix(h + np.uint64(1))
    two = mix(one) | np.uint64(1)
    for k in range(count):
        yield ((one + np.uint64(k) * two) >> np.uint64(44)).astype(np.int64)


def parted(docs: DataFrame, of_docs: Column, keys: DataFrame, bits_each: int = 12, most: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that keys surely doesn't hold, all others), by 64-bit hashes: of_docs, and the one column of keys.

    So a join with keys moves only the rows that may be in it, and the long
    texts of the others stay where they are.  keys should be a written table.
    Their Bloom filter is built in blocks, one task each, and broadcast; it
    never takes more than `most` bits.  With more keys than that suits it has
    fewer bits and probes for each, and lets more rows pass to the join.
    """
    n = keys.count()
    blocks = 1
    while blocks * BLOOM_BLOCK < min(n * bits_each, most):
        blocks *= 2
    count = int(np.clip(round(0.69 * blocks * BLOOM_BLOCK / max(1, n)), 1, BLOOM_PROBES))

    def build(rows: pa.Table) -> pa.Table:
        bits = np.zeros(BLOOM_BLOCK, bool)
        for place in _probes(rows.column("h").to_numpy().view(np.uint64), count):
            bits[place] = True
        return pa.table({"block": rows.column("block").slice(0, 1).combine_chunks(), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = keys.toDF("h").select("h", F.pmod("h", F.lit(blocks)).cast("int").alias("block"))
    bits = np.zeros((blocks, BLOOM_BLOCK // 8), np.uint8)
    for row in rows.groupBy("block").applyInArrow(build, "block int, bits binary").collect():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def may_hold(hashes: pa.Array) -> np.ndarray:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        block = (h & np.uint64(len(held.value) - 1)).astype(np.int64)
        out = np.ones(len(h), bool)
        for place in _probes(h, count):
            out &= (held.value[block, place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return out

    return filtered(docs, of_docs, lambda batch, h: ~may_hold(h)), filtered(docs, of_docs, lambda batch, h: may_hold(h))


BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) that leaves workers small: batches of bounded bytes, unless the session sets a bound, and freed memory given back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, "67108864b") == "67108864b":
        df.sparkSession.conf.set(name, BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(whole, schema)


def filtered(docs: DataFrame, extra: Column, test: Callable[[pa.RecordBatch, pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs that test holds of, given a batch and the values of one more column.

    Rows pass through the worker in batches, so no row waits in the JVM for its answer.
    """
    (name,) = fresh(docs, "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            rows = pa.RecordBatch.from_arrays(batch.columns[:at], names=batch.schema.names[:at])
            yield rows.filter(pa.array(test(rows, batch.column(at))))

    return docs.withColumn(name, extra).transform(mapped, run, docs.schema)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key isn't among the first column of ids; null keys stay."""
    (name,) = fresh(docs, "gone_id")
    gone = written(docs.sparkSession, ids.toDF(name).distinct(), "gone")
    stay, others = parted(docs, F.xxhash64(docs[key]), gone.select(F.xxhash64(name)))
    return stay.union(others.join(gone, others[key] == gone[name], "left_anti"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; set here only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `written` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives freed memory of this worker back to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
