"""Repeated byte strings by column-wise construction of a collection's suffix order.

Every byte that a repeated string of `LENGTH` bytes covers is removed, if the string also starts
earlier (smaller doc_id, or same document and earlier start). Texts are UTF-8 bytes, null is
empty, matches stay inside documents, and strings are judged on the input.

1. Each window of `LENGTH` bytes is filed under its anchor, the smallest hash of the `ANCHOR`-byte
   strings in it. Equal windows have equal anchors. Neighbouring windows with one anchor form a
   piece; equal pieces are merged: all but the first are repeats as a whole.
2. An anchor with a single distinct piece, in which it comes once, holds no further repeat. The pieces of all other
   anchors are dealt out by anchor to collections of bounded size. An anchor with more than about
   `CROWD` pieces (told from a sample of documents) is left out of all this: its windows, one by
   one, are reduced to their first place by two-step aggregation, every other place is a repeat,
   and the one window that is left needs no collection. An anchor that the sample missed is dealt
   out window by window, by the hash of the window.
3. In each collection the order of all suffixes is built column-wise for all documents at once: each
   round inserts one symbol per document, from its end to its start, into the Burrows-Wheeler
   transform and updates the common prefixes; both are sequences that a round reads and writes
   from front to back. A symbol is a string of `SYMBOL` bytes, and a piece is a document once for
   each of its first `SYMBOL` offsets, so that every window starts with a symbol of one document.
   Neighbours with `LENGTH` common bytes are equal windows; every one but the first in the corpus
   is a repeat.

Rows that share a doc_id and a text count as one document given more than once; rows that share only
the doc_id, or have none, are documents of their own (see `remove_repeats`). A null doc_id is before all
others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.llm import words as W
from wavetrail.llm.common import Scratch, whole_texts

LENGTH, ANCHOR = 100, 32
#: Bytes of a symbol; it divides LENGTH.
SYMBOL = 20
#: Windows of one piece at most, pieces of one collection about, pieces of an anchor that stay together.
RUN, COLLECTION, CROWD = 128, 400, 10_000
_RUNS = "doc_id long, start int, n int, anchor long, piece long, loops boolean, again boolean"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i, by doubling."""
    n = len(x) - width + 1
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:n], x[rest : rest + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of concatenated texts: row, start in the text, windows, anchor, hash of its bytes, anchor comes twice."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    n = len(data) - LENGTH + 1
    if n <= 0:
        return empty
    prefix = W.prefix_hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    gram = W.range_hashes(prefix, at, at + ANCHOR)
    least = _sliding_min(gram, LENGTH - ANCHOR + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[LENGTH - 1 :]
    new = np.r_[True, (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | (inside[1:] != inside[:-1])]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, n])
    begin, size = begin[inside[begin]], size[inside[begin]]
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(begin, parts) + nth * RUN
    count = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
    piece = W.range_hashes(prefix, start, start + count + LENGTH - 1)
    anchor = least[start]
    seen = np.r_[0, np.cumsum(gram[:n] == least)]
    times = seen[start + count] - seen[start]
    for k in range(LENGTH - ANCHOR):
        times += gram[start + count + k] == anchor
    return row[start], start - offsets[row[start]], count, anchor, W.mix(piece + count.astype(np.uint64)), times > 1


def _crowded(anchor: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Whether each anchor is in sorted `crowded`."""
    return crowded[np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)] == anchor if len(crowded) else np.zeros(len(anchor), bool)


def _filed(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, without crowded anchors; `again` marks those that an earlier place in the batch has too."""
    for batch in batches:
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
        found = [[] for _ in range(6)]
        for first, last, data, offsets in W.text_chunks(batch.column(1), lower=False):
            row, *rest = runs(data, offsets)
            for store, values in zip(found, (ids[first + row], *rest)):
                store.append(values)
        doc, start, n, anchor, piece, loops = (np.concatenate(f) for f in found)
        thin = ~_crowded(anchor, crowded)
        doc, start, n, anchor, piece, loops = (x[thin] for x in (doc, start, n, anchor, piece, loops))
        order = np.lexsort((start, doc, piece, anchor))
        doc, start, n, anchor, piece, loops = doc[order], start[order], n[order], anchor[order], piece[order], loops[order]
        again = np.r_[False, (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1])]
        for low in range(0, len(doc), 100_000):
            s = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[s]), pa.array(start[s].astype(np.int32)), pa.array(n[s].astype(np.int32)),
                pa.array(anchor[s].view(np.int64)), pa.array(piece[s].view(np.int64)), pa.array(loops[s]), pa.array(again[s])],
                ["doc_id", "start", "n", "anchor", "piece", "loops", "again"])


def _ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the ranges that windows cover."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + LENGTH)][: len(doc)])
    return doc[first], at[first], at[np.r_[first[1:], len(at)][: len(first)] - 1] + LENGTH


def _crowd_windows(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of crowded anchors: the first place of each in the batch with its hash, all others as ranges without."""
    for batch in batches:
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
        found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for first, _, data, offsets in W.text_chunks(batch.column(1), lower=False):
            row, start, n, anchor, _, _ = runs(data, offsets)
            some = _crowded(anchor, crowded)
            row, start, n = row[some], start[some], n[some]
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            place = offsets[row] + at
            for store, values in zip(found, (W.range_hashes(W.prefix_hashes(data), place, place + LENGTH), ids[first + row], at)):
                store.append(values)
        window, doc, at = (np.concatenate(f) for f in found)
        order = np.lexsort((at, doc, window))
        window, doc, at = window[order], doc[order], at[order]
        later = np.r_[False, window[1:] == window[:-1]][: len(window)]
        own, s, e = _ranges(doc[later], at[later])
        window, doc, at = window[~later], doc[~later], at[~later]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[doc, own], pa.int64()), pa.array(np.r_[at, s].astype(np.int32)), pa.array(np.r_[at + LENGTH, e].astype(np.int32)),
            pa.concat_arrays([pa.array(window.view(np.int64)), pa.nulls(len(own), pa.int64())])], ["doc_id", "s", "e", "window"])


def column_wise(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, offset and common prefix with its predecessor of every suffix, in suffix order.

    `flat` holds the symbols (codes from 1) of all documents one after the other. Round j inserts
    the suffixes of length j: the new suffix of a document is the symbol before its last one, put
    in front of it; its rank follows from counting that symbol in the transform.
    """
    m = len(size)
    base = np.cumsum(size) - size
    owner, offset, common = np.arange(m, dtype=np.int32), size.astype(np.int32), np.zeros(m, np.int16)
    # symbol before each suffix, 0 at the start of a piece
    before = flat[base + size - 1]
    rank = np.arange(m)  # of the longest suffix of each piece so far
    active = np.arange(m)
    while len(active):
        at = rank[active]
        by_rank = np.argsort(at)
        active, at = active[by_rank], at[by_rank]
        order = np.argsort(before, kind="stable")
        place = np.empty(len(before), np.int64)
        place[order] = np.arange(len(before))
        spot = place[at]
        symbol = before[at]
        ended = int(np.searchsorted(before[order], 1))
        # common prefix with the neighbours that start with the same symbol
        prev = order[np.maximum(spot - 1, 0)]
        has_prev = (spot > 0) & (before[prev] == symbol)
        follow = order[np.minimum(spot + 1, len(order) - 1)]
        has_next = (spot + 1 < len(order)) & (before[follow] == symbol)
        to_prev = np.zeros(len(at), np.int16)
        if has_prev.any():
            to_prev[has_prev] = 1 + _range_min(common, prev[has_prev] + 1, at[has_prev] + 1)
        to_next = np.zeros(len(at), np.int16)
        if has_next.any():
            to_next[has_next] = 1 + _range_min(common, at[has_next] + 1, follow[has_next] + 1)
        target = m + spot - ended
        after = offset[at] - 1
        nth = np.argsort(target)
        new = np.zeros(len(before) + len(at), bool)
        new[target] = True
        grown = []
        lead = base[active] + after - 1
        symbol_before = np.where(after > 0, flat[np.maximum(lead, 0)], 0).astype(flat.dtype)
        for old, value in ((before, symbol_before), (owner, active), (offset, after), (common, to_prev)):
            out = np.empty(len(new), old.dtype)
            out[new] = value[nth]
            out[~new] = old
            grown.append(out)
        before, owner, offset, common = grown
        common[target[has_next] + 1] = to_next[has_next]
        rank[active] = target
        active = active[after > 0]
    return owner, offset, common


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of x[low : high] for each pair with low < high."""
    padded = np.r_[x, x[-1:]]
    return np.minimum.reduceat(padded, np.stack([low, high], 1).ravel())[::2]


def phased(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as documents of symbols: codes, symbols per document, piece and first offset of each document."""
    length = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.arange(max(len(data) - width + 1, 0))
    code = np.unique(W.range_hashes(W.prefix_hashes(data), at, at + width), return_inverse=True)[1] + 1
    piece, phase = np.repeat(np.arange(len(pieces)), width), np.tile(np.arange(width), len(pieces))
    size = np.maximum((length[piece] - phase) // width, 0)
    some = size > 0
    piece, phase, size = piece[some], phase[some], size[some]
    first = (np.cumsum(length) - length)[piece] + phase
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat = code[np.repeat(first, size) + nth * width]
    return flat.astype(np.uint16 if len(data) < 65_000 else np.uint32), size, piece, phase


def _repeats(group: pd.DataFrame) -> pd.DataFrame:
    """Ranges of repeated windows in one collection: every equal window but the first in the corpus."""
    group = group.drop_duplicates(["doc_id", "start"])
    doc, start = group["doc_id"].to_numpy(), group["start"].to_numpy()
    flat, size, piece, phase = phased(group["bytes"].tolist(), SYMBOL)
    owner, offset, common = column_wise(flat, size)
    whole = LENGTH // SYMBOL
    same = np.cumsum(common < whole)  # number of the class of equal windows
    window = size[owner] - offset >= whole
    owner, offset = owner[window], offset[window]
    own, at, cls = doc[piece[owner]], start[piece[owner]] + phase[owner] + offset * SYMBOL, same[window]
    order = np.lexsort((at, own, cls))
    own, at, cls = own[order], at[order], cls[order]
    later = np.r_[False, cls[1:] == cls[:-1]]
    # the same place may be in two pieces of a collection; it is no repeat of itself
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(cls)))) if len(cls) else np.zeros(0, int)
    later &= (own != own[head]) | (at != at[head])
    own, at = own[later], at[later]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    if not len(own):
        return pd.DataFrame({"doc_id": own, "s": at, "e": at})
    cut = np.r_[True, (own[1:] != own[:-1]) | (at[1:] > at[:-1] + LENGTH)]
    first = np.flatnonzero(cut)
    return pd.DataFrame({"doc_id": own[first], "s": at[first], "e": at[np.r_[first[1:], len(at)] - 1] + LENGTH})


def _fetched(batches: Iterator[pa.RecordBatch], tasks: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted pieces with the collection they belong to; windows one by one for crowded anchors."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(3))):
            data = text.encode()
            for w in wanted:
                s, n = w["start"], w["n"]
                if w["crowd"] <= CROWD:
                    out.append((doc, s, data[s : s + n + LENGTH - 1], w["anchor"] % tasks))
                else:
                    for k in range(s, s + n):
                        piece = data[k : k + LENGTH]
                        out.append((doc, k, piece, int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True) % tasks))
            if len(out) > 50_000:
                yield _piece_batch(out)
                out = []
        if out:
            yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "bytes", "task"])


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`doc_id`, `s`, `e`: byte ranges to remove; ranges of a document may overlap."""
    null_id = F.lit(int(np.iinfo(np.int64).min))
    texts = whole_texts(docs).withColumn("doc_id", F.coalesce("doc_id", null_id))
    # one document in `rate`: an anchor that is missed is only dealt out less evenly
    rate = max(1, min(64, CROWD // 128))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).mapInArrow(lambda it: _filed(it, np.zeros(0, np.uint64)), _RUNS)
    many = sample.where("not again").groupBy("anchor").count().where(F.col("count") > CROWD // (2 * rate)).select("anchor").collect()
    crowded = np.sort(np.array([r["anchor"] for r in many], np.int64).view(np.uint64))
    filed = texts.mapInArrow(lambda it: _filed(it, crowded), _RUNS)
    # places that repeat an earlier one of their batch need no company: they are dealt out evenly
    key = F.when(F.col("again"), F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    keyed = filed.withColumn("key", key)
    fresh = Window.partitionBy("key").orderBy("piece", "doc_id", "start")
    change = F.when(F.lag("piece").over(fresh).eqNullSafe(F.col("piece")), 0).otherwise(1)
    told = keyed.withColumn("new", change).withColumn("crowd", F.sum("new").over(Window.partitionBy("key")))
    kept = told.where("again or new = 0 or crowd > 1 or loops").select("doc_id", "start", "n", "anchor", (F.col("again") | (F.col("new") == 0)).alias("again"), "crowd")
    kept = scratch.put(kept, "pieces")
    whole = kept.where("again").select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("n") + LENGTH - 1).alias("e"))
    open_pieces = kept.where("not again")
    load = open_pieces.agg(F.sum(F.when(F.col("crowd") > CROWD, F.col("n")).otherwise(1))).first()[0] or 0
    tasks = max(1, -(-load // COLLECTION))
    wanted = open_pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor", "crowd")).alias("wanted"))
    fetched = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(lambda it: _fetched(it, tasks), "doc_id long, start int, bytes binary, task long")
    found = fetched.groupBy("task").applyInPandas(_repeats, "doc_id long, s int, e int")
    ranges = whole.union(found)
    if len(crowded):
        windows = scratch.put(texts.mapInArrow(lambda it: _crowd_windows(it, crowded), "doc_id long, s int, e int, window long"), "windows")
        firsts = windows.where("window is not null").groupBy("window").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1").drop("places")
        others = windows.join(firsts, "window").where(F.struct("doc_id", "s") != F.col("first"))
        ranges = ranges.union(windows.where("window is null").select("doc_id", "s", "e")).union(others.select("doc_id", "s", "e"))
    return ranges


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in range(3))):
            data = text.encode()
            spans: list[list[int]] = []
            for r in sorted((r["s"], r["e"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)]))
            rows.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"s": s, "e": e} for s, e in spans]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def _numbered(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """`texts` with `row_id`: the id, or a number in the order of (id, text) where ids are missing or shared.

    A null id comes first; rows with the same id and text have one number. Numbers are made from a
    range partitioning, whose tasks follow each other in this order.
    """
    unsound = texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not unsound:
        return texts.withColumn("row_id", F.col("doc_id"))
    keyed = texts.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    keys = keyed.select("doc_id", "key").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = scratch.put(keys.select(F.col("doc_id").alias("id"), F.col("key").alias("of"), F.monotonically_increasing_id().alias("row_id")), "rows")
    joined = keyed.join(keys, keyed["doc_id"].eqNullSafe(keys["id"]) & (keyed["key"] == keys["of"]))
    return scratch.put(joined.select("doc_id", "text", "row_id"), "numbered")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept` (bytes), `spans`.

    Rows that share an id but not the text are documents of their own, in the order of their
    SHA-256; rows without an id are too, before all others. Rows with the same id and text are one
    document given more than once: each gets the result of that document.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = _numbered(whole_texts(docs), scratch)
    own = texts.select(F.col("row_id").alias("doc_id"), "text")
    if "numbered" in scratch.paths:
        own = own.dropDuplicates(["doc_id"])
    ranges = repeated_ranges(own, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    ranges = ranges.withColumnRenamed("doc_id", "__id")
    joined = texts.join(ranges, texts["row_id"] == ranges["__id"], "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<s:long,e:long>>"
    return joined.mapInArrow(_cleaned, schema)


def removal_report(docs: DataFrame) -> DataFrame:
    """`remove_repeats` without the bytes."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
