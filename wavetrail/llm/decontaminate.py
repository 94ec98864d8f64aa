"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

An item is contained in a document if at least `CONTAINMENT` of its distinct word 5-grams occur
in the document. Items are partitioned by size: class c holds items of 2^(c-1) + 1 to 2^c
n-grams. For each class a document is cut into half-overlapping windows of twice that size, so
a passage that holds an item lies whole in one window, and containment becomes a lower bound on
the Jaccard similarity of item and window (see `least_jaccard`). Each window has `HASHES` MinHash
values; a window and an item are candidates if any value agrees. The number of values makes
the chance to miss an item below `MISS`. Candidates are verified on the full n-gram sets of item
and document.

The signatures of the items are broadcast if they hold at most `BROADCAST_VALUES` values; more
items are searched in slices of that size, one pass over the documents for each slice.

Null, empty or wordless items match nothing; texts of one to four words count as one n-gram.
Items or documents that repeat are judged each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.llm import words as W
from wavetrail.llm.ngram_join import minima

SIZE, CONTAINMENT, MISS = 5, 0.8, 1e-6
#: Item values (signatures and n-grams) held by one task at once; 8 bytes each.
BROADCAST_VALUES = 2_000_000
#: N-grams of documents that are searched at once (a power of two).
SLICE = 1 << 14


def least_jaccard(containment: float = CONTAINMENT) -> float:
    """The smallest Jaccard similarity of a window of 2s n-grams and an item of more than s/2 contained in it."""
    return containment * 0.5 / (2 + 0.5 * (1 - containment))


def hashes_needed(containment: float = CONTAINMENT, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-least_jaccard(containment)))


class Index:
    """Items by size class: signatures for the search, n-gram sets for the verification."""

    def __init__(self, ids: list[int], grams: list[np.ndarray], containment: float):
        self.ids, self.grams, self.containment = ids, grams, containment
        self.n, self.lowest = hashes_needed(containment), 0
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            by.setdefault((len(g) - 1).bit_length(), []).append(i)
        self.lowest = min(by, default=0)
        for c, items in by.items():
            starts = np.cumsum([0, *(len(grams[i]) for i in items[:-1])])
            keys = self.keyed(minima(np.concatenate([grams[i] for i in items]), starts, self.n)).ravel()
            owner = np.tile(np.array(items), self.n)
            order = np.argsort(keys, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.classes[c] = keys[order], owner[order], marks

    @staticmethod
    def keyed(values: np.ndarray) -> np.ndarray:
        """MinHash values (hashes, sets) as 64-bit keys that differ between hash functions."""
        return W.mix(values.astype(np.uint64) + (np.arange(1, len(values) + 1, dtype=np.uint64) << np.uint64(32))[:, None])

    def search(self, gram: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """Candidate (row, item) pairs for documents given by n-grams in text order and their rows.

        N-grams are searched in runs of whole rows of at most `SLICE`. A longer row is searched in
        slices that overlap by a block of the largest class whose windows fit into a slice; its
        larger classes start from the block minima of those slices.
        """
        found: set[tuple[int, int]] = set()
        if not len(gram) or not self.classes:
            return []
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        ends, k = np.r_[first[1:], len(gram)], 0
        fits = SLICE.bit_length() - 2
        while k < len(first):
            a = int(first[k])
            last = max(k + 1, int(np.searchsorted(ends, a + SLICE, "right")))
            b = int(ends[last - 1])
            if b - a <= SLICE:
                blocks = np.concatenate([np.arange(x, y, 1 << self.lowest) for x, y in zip(first[k:last], ends[k:last])]) - a
                self._levels(minima(gram[a:b], blocks, self.n), row[a:b][blocks], self.lowest, max(self.classes), found)
            else:
                tops = []
                for low in range(a, b, SLICE):
                    part = gram[low : min(b, low + SLICE + (1 << fits))]
                    if self.lowest <= fits:
                        blocks = np.arange(0, len(part), 1 << self.lowest)
                        self._levels(minima(part, blocks, self.n), np.full(len(blocks), row[a]), self.lowest, fits, found)
                    if max(self.classes) > fits:
                        tops.append(minima(part[:SLICE], np.arange(0, min(SLICE, b - low), 1 << fits), self.n))
                if tops:
                    top = np.concatenate(tops, axis=1)
                    self._levels(top, np.full(top.shape[1], row[a]), fits, max(self.classes), found, fits + 1)
            k = last
        return sorted(found)

    def _levels(self, low: np.ndarray, of: np.ndarray, level: int, last: int, found: set, asked: int = 0) -> None:
        """Windows of the classes from `level` to `last`, made of two neighbouring blocks of a row each.

        `low`: minima of blocks of 2^level n-grams; classes below `asked` are passed through only.
        """
        for c in range(level, last + 1):
            if c > level:  # merge pairs of blocks inside each row
                start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                nth = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
                keep = np.flatnonzero(nth % 2 == 0)
                low, of = np.minimum.reduceat(low, keep, axis=1), of[keep]
            if c not in self.classes or c < asked:
                continue
            same = np.flatnonzero(np.r_[of[1:] == of[:-1], False])
            keys, owner, marks = self.classes[c]
            for k in range(self.n):  # one hash function at a time
                window = low[k].copy()
                window[same] = np.minimum(window[same], low[k][same + 1])
                value = W.mix(window.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(32)))
                maybe = np.flatnonzero(marks[(value >> np.uint64(44)).astype(np.int64)])
                a, b = np.searchsorted(keys, value[maybe], "left"), np.searchsorted(keys, value[maybe], "right")
                for i in np.flatnonzero(b > a):
                    found.update((int(of[maybe[i]]), int(x)) for x in owner[a[i] : b[i]])

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, shared n-grams, n-grams of the item) of verified pairs."""
        for first, last, word, word_row in W.words(texts):
            gram, row = W.shingles(word, word_row, SIZE)
            cut = np.searchsorted(row, np.arange(last - first + 1))
            for r, i in self.search(gram, row):
                item = self.grams[i]
                shared = int(np.isin(item, gram[cut[r] : cut[r + 1]]).sum())
                if shared >= self.containment * len(item) - 1e-9:
                    yield first + r, i, shared, len(item)


def _slices(spark_items: DataFrame, limit: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items with their n-gram sets, in slices of at most `limit` values, streamed to the driver."""
    ids, grams, held = [], [], 0
    for row in spark_items.toLocalIterator():
        gram = W.sets([row["text"] or ""], SIZE)[0]
        if not len(gram):
            continue
        if held and held + len(gram) + hashes_needed() > limit:
            yield ids, grams
            ids, grams, held = [], [], 0
        ids.append(row["item_id"])
        grams.append(gram)
        held += len(gram) + hashes_needed()
    if ids:
        yield ids, grams


def _pairs(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    held = index.value
    for batch in batches:
        rows = [(batch.column(0)[r].as_py(), held.ids[i], s, n) for r, i, s, n in held.matches(batch.column(1))]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "n_shingles"])


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, limit: int = BROADCAST_VALUES) -> DataFrame:
    """`doc_id`, `item_id`, `shared`, `n_shingles`, `containment` of every item contained in a document."""
    spark = docs.sparkSession
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    schema = "doc_id long, item_id long, shared long, n_shingles long"
    out = spark.createDataFrame([], schema)
    for ids, grams in _slices(asked, limit):
        index = spark.sparkContext.broadcast(Index(ids, grams, containment))
        out = out.union(thin.mapInArrow(lambda it, index=index: _pairs(it, index), schema))
    return out.withColumn("containment", F.col("shared") / F.col("n_shingles"))


def _flagged(batches: Iterator[pa.RecordBatch], index, text_at: int) -> Iterator[pa.RecordBatch]:
    held = index.value
    for batch in batches:
        hit = np.zeros(batch.num_rows, bool)
        hit[[r for r, *_ in held.matches(batch.column(text_at).cast(pa.string()))]] = True
        yield batch.filter(pa.array(~hit))


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, limit: int = BROADCAST_VALUES) -> DataFrame:
    """`docs` without rows that contain an item; columns stay, nothing shuffles."""
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    text_at = docs.columns.index("text")
    for ids, grams in _slices(asked, limit):
        index = docs.sparkSession.sparkContext.broadcast(Index(ids, grams, containment))
        docs = docs.mapInArrow(lambda it, index=index: _flagged(it, index, text_at), docs.schema)
    return docs
