"""Benchmark decontamination: a BM25 index of test items, block-max WAND, verification.

The index is of the test items, the queries are the training passages, all of
them: windows of twice the longest item's words, half overlapping, so each item
that stands in a text lies whole in some passage.  Impacts are divided by the
item's score for itself, so one threshold holds for all items.  Items of like
length share a block.  Over a chunk of texts at once, passages are skipped when
the sum of their terms' greatest impacts stays under the threshold; of the
others, only blocks whose block maxima reach it are scored; every item over the
threshold is retrieved, without a limit on their number.  A retrieved item
counts when the passage holds enough of the n-grams of both its question and
its answer, the last sentence (or the last third of the words).

Test sets don't grow with the corpus, but their size is checked: an index of
more than segment_items items is cut into segments, broadcast apart, which
workers go through one after another, for a batch of texts each; what is counted
over items (frequencies, mean and greatest length) is that of all of them, so
segments change no score.  The corpus itself isn't shuffled.

Defined results: null or empty texts and items match nothing.  Rows with a null
doc_id are reported with a null, and cleaned like others.  Repeated items are matched apart and reported
once per item_id, repeated documents once per row.  Equal scores are all
reported.  Items and texts of any length are read whole.  Empty tables give no
leaks, and other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Words, chunks, filtered, mapped, ragged, window_hash

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
GRAM = 3
BLOCK = 16
SEGMENT_ITEMS = 100_000
DENSE = 16 << 20


def parts(text: str) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; or two and one thirds of the words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:]) or words[-1]


def gram_set(text: str) -> np.ndarray:
    """Distinct n-grams of a part of an item, of all its words where there are fewer; marked by n."""
    words = Words(pa.array([text]))
    n = min(GRAM, len(words.hash))
    return np.unique(window_hash(words.hash, n)) if n else np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; for large arrays of integers faster than np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sums_over(key: np.ndarray, weight: np.ndarray, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys below size whose weights add up to least or more, in order, and their sums."""
    if size <= DENSE:
        total = np.bincount(key, weight, minlength=size)
        keys = np.flatnonzero(total >= least)
        return keys, total[keys]
    keys, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, weight, minlength=len(keys))
    good = total >= least
    return keys[good], total[good]


def among(key: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Which of key, below size, are in keys, which are sorted."""
    if size <= DENSE:
        table = np.zeros(size, bool)
        table[keys] = True
        return table[key]
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


class Counts:
    """What is counted over all items: documents of each term, their number, mean and greatest length."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()))
        full = words.counts > 0
        self.n, self.longest = int(full.sum()), int(words.counts.max(initial=0))
        self.mean = float(words.counts[full].mean()) if self.n else 0.0
        self.terms, code = np.unique(words.hash, return_inverse=True)
        self.df = np.bincount(np.unique(code * max(1, len(texts)) + words.doc) // max(1, len(texts)), minlength=len(self.terms))


class Index:
    def __init__(self, ids: list, texts: list[str], counts: Counts):
        sizes = Words(pa.array(texts, pa.large_string())).counts
        order = [i for i in np.argsort(sizes, kind="stable") if sizes[i]]
        self.ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        self.n = n = len(texts)
        self.longest = counts.longest
        if not n:
            return
        words = Words(pa.array(texts))
        self.terms, code = np.unique(words.hash, return_inverse=True)
        key, tf = np.unique(code * n + words.doc, return_counts=True)
        term, item = key // n, key % n
        length = words.counts
        df = counts.df[np.searchsorted(counts.terms, self.terms)]
        idf = np.log(1 + (counts.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / counts.mean))
        impact /= np.bincount(item, impact, minlength=n)[item]
        self.item, self.impact = item, impact
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(impact, self.at[:-1])
        self.blocks = -(-n // BLOCK)
        cell = term * self.blocks + item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.block, self.block_max = (cell[first] % self.blocks), np.maximum.reduceat(impact, first)
        self.block_at = np.searchsorted(cell[first] // self.blocks, np.arange(len(self.terms) + 1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        cut = [parts(t) for t in texts]
        self.question, self.answer = [gram_set(q) for q, _ in cut], [gram_set(a) for _, a in cut]
        self.short = {min(GRAM, len(Words(pa.array([p])).start)) for q, a in cut for p in (q, a)} - {0}

    def term_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that are terms, and which."""
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        good = self.terms[term] == h[at]
        return at[good], term[good]

    def retrieve(self, words: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(first token of the passage, document, item, score) of all items over the threshold, and the stride."""
        stride = self.longest
        none = np.zeros(0, np.int64)
        at, term = self.term_of(words.hash)
        if not len(at):
            return none, none, none, np.zeros(0), stride
        # Segments of stride words; a passage is a segment and the one after it in the same text.
        count = np.maximum(1, -(-words.counts // stride))
        base = np.concatenate([[0], np.cumsum(count)])
        doc = words.doc[at]
        segment = base[doc] + (at - words.first[doc]) // stride
        width = len(self.terms)
        key = distinct(segment * width + term)
        segment, term = key // width, key % width
        sums = np.bincount(segment, self.bound[term], minlength=base[-1] + 1)
        of = np.repeat(np.arange(len(count)), count)
        joined = np.append(of[1:] == of[:-1], False)
        high = sums[:-1] + np.where(joined, sums[1:], 0)
        passage = np.flatnonzero(high >= threshold)
        if not len(passage):
            return none, none, none, np.zeros(0), stride
        # Distinct terms of the passages that are left.
        start = np.searchsorted(segment, np.arange(base[-1] + 2))
        end = np.where(joined[passage], passage + 2, passage + 1)
        length = start[end] - start[passage]
        key = distinct(np.repeat(np.arange(len(passage)), length) * width + term[ragged(start[passage], length)])
        query, term = key // width, key % width
        # Block maxima, then exact scores in the blocks that can reach the threshold.
        length = np.diff(self.block_at)[term]
        posting = ragged(self.block_at[:-1][term], length)
        size = len(passage) * self.blocks
        live, _ = sums_over(np.repeat(query, length) * self.blocks + self.block[posting], self.block_max[posting], size, threshold - 1e-9)
        if not len(live):
            return none, none, none, np.zeros(0), stride
        good = among(query, distinct(live // self.blocks), len(passage))
        query, term = query[good], term[good]
        length = np.diff(self.at)[term]
        posting = ragged(self.at[:-1][term], length)
        who, item = np.repeat(query, length), self.item[posting]
        good = among(who * self.blocks + item // BLOCK, live, size)
        pairs, score = sums_over(who[good] * self.n + item[good], self.impact[posting[good]], len(passage) * self.n, threshold - 1e-9)
        query, item = pairs // self.n, pairs % self.n
        segment = passage[query]
        return words.first[of[segment]] + (segment - base[of[segment]]) * stride, of[segment], item, score, stride

    def matches(self, column: pa.Array, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """The best (score, question overlap, answer overlap) of each (text, item) that is verified."""
        words = Words(column)
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        token, doc, item, score, stride = self.retrieve(words, threshold)
        grams: dict[int, np.ndarray] = {}
        for t, d, i, s in zip(token.tolist(), doc.tolist(), item.tolist(), score.tolist()):
            if t not in grams:
                h = words.hash[t : min(t + 2 * stride, words.first[d + 1])]
                grams[t] = np.concatenate([window_hash(h, n) for n in self.short if n <= len(h)] or [np.zeros(0, np.uint64)])
            held = grams[t]
            q, a = (float(np.isin(p, held).mean()) if len(p) else 1.0 for p in (self.question[i], self.answer[i]))
            if q >= overlap and a >= overlap:
                out[d, i] = max(out.get((d, i), (0.0, 0.0, 0.0)), (s, q, a))
        return out


def searcher(docs: DataFrame, items: DataFrame, threshold: float, overlap: float, item_key: str, item_text: str, segment_items: int) -> Callable[[pa.Array], Iterator[tuple[int, dict]]]:
    """A function that gives, for a column of texts, ranges of rows by their first, and {(row in the range, item): best match} of each."""
    rows = items.where(items[item_text].isNotNull()).select(items[item_key].alias("i"), items[item_text].alias("t")).collect()
    counts = Counts([r[1] for r in rows])
    cuts = [rows[k : k + segment_items] for k in range(0, max(1, len(rows)), segment_items)]
    held = [docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in cut], [r[1] for r in cut], counts)) for cut in cuts]

    def search(texts: pa.Array) -> Iterator[tuple[int, dict]]:
        pieces = [p.column(0) for p in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        found: list[dict] = [{} for _ in pieces]
        for segment in held:
            index = segment.value
            for piece, best in zip(pieces, found):
                for (d, i), match in index.matches(piece, threshold, overlap).items() if index.n else ():
                    at = (d, index.ids[i])
                    best[at] = max(best.get(at, match), match)
            if len(held) > 1:
                del segment._value  # the next segment takes its place in memory
        first = 0
        for piece, best in zip(pieces, found):
            yield first, best
            first += len(piece)

    return search


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each test item found in a document."""
    search = searcher(docs, items, threshold, overlap, item_key, item_text, segment_items)
    item_type = items.schema[item_key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in search(batch.column("text")):
                rows_ = pa.array([first + d for d, _ in found], pa.int64())
                columns = [pa.array([i for _, i in found]), *(pa.array([b[k] for b in found.values()], pa.float64()) for k in range(3))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows_), columns[0].cast(schema_types[1]), *columns[1:]], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["id", "item", "score", "question_overlap", "answer_overlap"]
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("item", item_type), *(T.StructField(n, T.DoubleType()) for n in names[2:])])
    schema_types = [to_arrow_type(f.dataType) for f in schema]
    rows = docs.where(docs[text].isNotNull()).select(docs[key].alias("id"), docs[text].alias("text"))
    return rows.transform(mapped, run, schema).withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text", item_key: str = "item_id", item_text: str = "text", segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """The rows of docs in which no test item is found, with their columns, in one pass and whatever their doc_id.

    Null and empty texts stay, repeated rows stay or go together.
    """
    search = searcher(docs, items, threshold, overlap, item_key, item_text, segment_items)
    at = docs.columns.index(docs.select(docs[text]).columns[0])

    def clean(batch: pa.RecordBatch, _) -> np.ndarray:
        out = np.ones(batch.num_rows, bool)
        for first, found in search(batch.column(at)):
            out[[first + d for d, _ in found]] = False
        return out

    return filtered(docs, F.lit(0), clean)
