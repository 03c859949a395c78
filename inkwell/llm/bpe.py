"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pretokens by the published byte-level pattern, vectorised
over code points.  The distinct pretokens of a chunk go into one matrix per
length bucket, a row each; in every round each row merges its leftmost pair of
minimum rank, found through an open-addressing table of pairs, and the matrix
is compacted by one column.  Rows without a mergeable pair leave the matrix.

Defined results: a null text gives null ids, an empty text an empty list.
Bytes that aren't UTF-8 are encoded as single code points of class "other".
Texts of any length are encoded whole.  Pretokens of over LONG bytes, for which
a matrix would be quadratic, are merged by the same rule through a heap.
Rows are independent: repeated rows give repeated results, and extra columns
are left out of the result.  Special tokens are never produced.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernel import BYTE_CODE, _BASE, chunks, flat, list_array, mapped, mix, powers, ragged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = 256
NONE = np.int32(2**31 - 1)
_CACHE: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """Pairs of token ids and the rank of what they merge to, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.values[at] == NONE)
            put, which = np.unique(at[free], return_index=True)
            placed = free[which]
            self.keys[put], self.values[put] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it merges to nothing."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.values[at] != NONE))
        at = at[todo]
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at] == keys[todo]
            out[todo[found]] = self.values[at[found]]
            more = ~found & (self.values[at] != NONE)
            todo, at = todo[more], at[more]
        return out


class Codec:
    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        kinds = {"L": 1, "N": 2}
        self.kind = np.array([kinds.get(unicodedata.category(chr(i))[0], 3) for i in range(0x110000)], np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0

    # -- pretokens

    def pretokens(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets at which pretokens begin, and the end, over all texts."""
        if not len(buf):
            return np.zeros(1, np.int64)
        text = buf.tobytes().decode("utf-8", "surrogateescape")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        size[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1
        at = np.concatenate([[0], np.cumsum(size)])
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offsets)] = True
        kind = np.append(self.kind[cp], 9)
        start = first.copy()
        start[0] = start[n] = True
        start[1:] |= kind[1:] != kind[:-1]
        # White space before a token of the same text gives up its last character.
        last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:])
        space = cp[last] == 32
        start[last] = True
        start[last[space] + 1] = False
        # Contractions: an apostrophe that begins a token, then s t m d or re ve ll.
        mark = np.flatnonzero((cp == 39) & start[:-1])
        cp2 = np.concatenate([cp, [0, 0, 0]])
        gap = np.concatenate([first, [True, True]])
        one, two = cp2[mark + 1], cp2[mark + 2]
        short = ~gap[mark + 1] & np.isin(one, [ord(c) for c in "stmd"])
        pair = one * 256 + two
        long = ~gap[mark + 1] & ~gap[mark + 2] & np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
        return at[np.flatnonzero(start)]

    # -- merging

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rows of ids, padded by -1.  Which row, its ids one after another, its length."""
        which, ids, lengths, index = [], [], [], np.arange(len(rows))
        pairs = self.pairs
        width = rows.shape[1]
        ranks = np.full((len(rows), width - 1), NONE)
        if width > 1:
            real = rows[:, 1:] >= 0
            ranks[real] = pairs.look(rows[:, :-1][real], rows[:, 1:][real])

        def leave(done: np.ndarray) -> None:
            out = rows[done]
            real = out >= 0
            which.append(index[done])
            ids.append(out[real])
            lengths.append(real.sum(1))

        while len(rows):
            if rows.shape[1] == 1:
                leave(np.ones(len(rows), bool))
                break
            col = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), col]
            done = best == NONE
            if done.any():
                leave(done)
                go = ~done
                rows, ranks, index, col, best = rows[go], ranks[go], index[go], col[go], best[go]
                if not len(rows):
                    break
            n, width = rows.shape
            r = np.arange(n)
            rows[r, col] = best
            keep = np.ones((n, width), bool)
            keep[r, col + 1] = False
            rows = rows[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[r, col] = False
            ranks = ranks[keep].reshape(n, width - 2)
            if width > 2:
                left = np.flatnonzero(col > 0)
                ranks[left, col[left] - 1] = pairs.look(rows[left, col[left] - 1], best[left])
                right = np.flatnonzero(col < width - 2)
                next_id = rows[right, col[right] + 1]
                rank = pairs.look(best[right], np.maximum(next_id, 0))
                rank[next_id < 0] = NONE
                ranks[right, col[right]] = rank
        return np.concatenate(which), np.concatenate(ids), np.concatenate(lengths)

    def merge_long(self, piece: np.ndarray) -> list[int]:
        """The same rule for one long pretoken: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[piece].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self.pairs.look(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks.append(int(NONE))
        look = self.pairs.look
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    m = after[k]
                    ranks[k] = int(look(np.array([ids[k]]), np.array([ids[m]]))[0]) if m >= 0 else int(NONE)
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pretokens one after another, and how many each has."""
        which, ids, counts = [], [], []
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, LONG):
            rows = np.flatnonzero((length > low) & (length <= high))
            low = high
            step = max(1, (1 << 20) // high)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                place = start[part][:, None] + np.arange(high)
                real = np.arange(high) < length[part][:, None]
                matrix = np.where(real, self.byte_id[buf[np.minimum(place, len(buf) - 1)]], np.int32(-1))
                w, i, c = self.merge_rows(matrix)
                which.append(part[w])
                ids.append(i)
                counts.append(c)
        for k in np.flatnonzero(length > LONG):
            out = self.merge_long(buf[start[k] : start[k] + length[k]])
            which.append(np.array([k]))
            ids.append(np.array(out, np.int32))
            counts.append(np.array([len(out)]))
        if not which:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        which, ids, counts = np.concatenate(which), np.concatenate(ids), np.concatenate(counts)
        at = np.concatenate([[0], np.cumsum(counts)])[:-1]
        order = np.argsort(which)
        return ids[ragged(at[order], counts[order])], counts[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text."""
        buf, offsets = flat(column)
        cuts = self.pretokens(buf, offsets)
        start, length = cuts[:-1], np.diff(cuts)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        up, down = powers(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_CODE[buf] * up, out=total[1:])
        key = mix((total[cuts[1:]] - total[start]) * down[start] + length.astype(np.uint64))
        code, _ = pd.factorize(key)
        n = int(code.max()) + 1
        model = np.empty(n, np.int64)
        model[code[::-1]] = np.arange(len(code))[::-1]
        # Equal hashes are trusted only after the bytes compare equal.
        other = model[code]
        same = length[other] == length
        if not same.all() or not np.array_equal(buf[ragged(start[other], length)], buf):
            code, model = np.arange(len(start)), np.arange(len(start))
        ids, counts = self.encode_pieces(buf, start[model], length[model])
        at = np.concatenate([[0], np.cumsum(counts)])
        size = counts[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[ragged(at[:-1][code], size)], ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after another, and the offsets of each text."""
        size = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.token_bytes[ragged(self.token_at[ids], size)], ends[offsets]


def codec(path: str) -> Codec:
    if path not in _CACHE:
        _CACHE[path] = Codec(path)
    return _CACHE[path]


def _nulls(array: pa.Array) -> pa.Array | None:
    return array.is_null() if array.null_count else None


def encode(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids, n_tokens, round_trip): ids of each text; round_trip says that they decode to its bytes.

    One pass over the rows, without a shuffle.  The vocabulary is read by each
    worker from path, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                column = part.column("text")
                ids, offsets = c.encode(column)
                back, ends = c.decode(ids, offsets)
                buf, at = flat(column)
                equal = np.array_equal(back, buf) and np.array_equal(ends, at)
                good = np.full(len(column), equal)
                if not equal:
                    for i in range(len(column)):
                        good[i] = np.array_equal(back[ends[i] : ends[i + 1]], buf[at[i] : at[i + 1]])
                mask = _nulls(column)
                lists = list_array(ids, offsets, pa.int32())
                count = pa.array(np.diff(offsets).astype(np.int32))
                whole = pa.array(good)
                if mask is not None:
                    lists, count, whole = (pa.compute.if_else(mask, pa.nulls(len(column), x.type), x) for x in (lists, count, whole))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, count, whole], names=["id", "token_ids", "n_tokens", "round_trip"])

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[key].dataType),
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )
    return docs.select(docs[key].alias("id"), docs[text].alias("text")).transform(mapped, run, schema).withColumnRenamed("id", key)


def decode(tokens: DataFrame, path: str = VOCABULARY, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, text): the text of each list of ids; null for null.  Ids outside the vocabulary raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column("ids")
            if column.null_count:
                column = pa.compute.if_else(column.is_null(), pa.scalar([], column.type), column)
            offsets = np.asarray(column.offsets, np.int64)
            values = np.asarray(column.values)[offsets[0] : offsets[-1]]
            raw, ends = c.decode(values, offsets - offsets[0])
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary()).cast(pa.string())
            mask = _nulls(batch.column("ids"))
            if mask is not None:
                text = pa.compute.if_else(mask, pa.nulls(len(text), text.type), text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), text], names=["id", "text"])

    schema = T.StructType([T.StructField("id", tokens.schema[key].dataType), T.StructField("text", T.StringType())])
    return tokens.select(tokens[key].alias("id"), tokens[ids].alias("ids")).transform(mapped, run, schema).withColumnRenamed("id", key)
