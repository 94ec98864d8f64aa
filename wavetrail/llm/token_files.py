"""Token files: ids of whole texts in Simple-8b words, written in ascending doc_id order.

Format. A data set is a folder of Parquet files written by Spark's committer, one row per
block; a block holds whole documents (at least one) of one shard, about `BLOCK_IDS` ids.

    shard, block  int     place of the block; (shard, block) orders all documents by doc_id
    base          long    ids of the shard before this block
    doc_ids       long[]  documents of the block
    doc_ends      long[]  ids of the block up to the end of each document
    n_ids         long    ids of the block
    words         binary  64-bit little-endian Simple-8b words
    word_base     int[]   ids before every 1024th word, so that decoding can start there
    escapes       binary  pairs of unsigned 32-bit integers (place in the block, id)

A word's top four bits select how many ids of how many bits its low 60 bits hold, first id
lowest (`COUNTS`, `WIDTHS`). Ids are stored plus one; a stored zero is an escape, whose id is
in `escapes`: ids of more than 19 bits, so that no word holds fewer than three.

Null text counts as empty and has only the end id. Rows with the same doc_id are ordered by
their text; a null id comes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.llm.common import Scratch, whole_texts
from wavetrail.llm.tokens import closed, encoder

BLOCK_IDS = 1 << 16
EVERY = 1024
# Selector table of the coding: ids per word and bits per id.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE_FROM = (1 << 20) - 1
#: Widths of the table, from one bit on, that a number of so many bits does not fit.
_WIDER = np.array([int((WIDTHS[2:] < b).sum()) for b in range(65)])
SCHEMA = "shard int, block int, base long, doc_ids array<long>, doc_ends array<long>, n_ids long, words binary, word_base array<int>, escapes binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple-8b words of `ids`, ids before every 1024th word, escapes as (place, id) rows."""
    ids = ids.astype(np.uint64)
    escaped = np.flatnonzero(ids >= ESCAPE_FROM)
    escapes = np.stack([escaped, ids[escaped].astype(np.int64)], 1).astype("<u4")
    stored = ids + np.uint64(1)
    stored[escaped] = 0
    n = len(stored)
    bits = _WIDER[np.frexp(stored.astype(float))[1]]
    take, choice = np.zeros(n, np.int64), np.zeros(n, np.int64)
    over = np.zeros(n + 1 + COUNTS[0], np.int32)  # ids before each place that are too wide; none beyond the end
    for s in range(len(COUNTS) - 1, 1, -1):
        np.cumsum(bits > s - 2, out=over[1 : n + 1])
        over[n + 1 :] = over[n]
        fits = over[COUNTS[s] : COUNTS[s] + n] == over[:n]
        take[fits], choice[fits] = COUNTS[s], s
    start, i, steps = [], 0, take.tolist()
    while i < n:
        start.append(i)
        i += steps[i]
    start = np.array(start, np.int64)
    chosen = choice[start]
    padded = np.r_[stored, np.zeros(240, np.uint64)]
    out = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = chosen == s
        word = out[mine]
        for k in range(COUNTS[s]):
            word |= padded[start[mine] + k] << np.uint64(k * WIDTHS[s])
        out[mine] = word
    # ids beyond the end of the block are no ids: the last word may claim more than it has
    return out.astype("<u8"), start[::EVERY].astype(np.int32), escapes


def unpack(words: np.ndarray, n_ids: int, escapes: np.ndarray) -> np.ndarray:
    """The ids of a block."""
    select = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[select])
    start = ends - COUNTS[select]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(select):
        mine = np.flatnonzero(select == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[start[mine] + k] = (words[mine] >> np.uint64(k * WIDTHS[s])) & mask
    out = out[:n_ids] - np.uint64(1)
    out[escapes[:, 0]] = escapes[:, 1]
    return out.astype(np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Documents are gathered until they hold `BLOCK_IDS` ids; the one that reaches it closes the block."""
    shard, block, base = TaskContext.get().partitionId(), 0, 0
    ids, docs, sizes, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        whole, ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
        words, word_base, escapes = pack(whole)
        row = {"shard": [shard], "block": [block], "base": [base], "doc_ids": [pa.concat_arrays(docs)], "doc_ends": [ends], "n_ids": [len(whole)],
               "words": [words.tobytes()], "word_base": [word_base], "escapes": [escapes.tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=_ARROW)

    for batch in batches:
        for first, last, found, offsets in encoder(path).encode(batch.column(1)):
            found, offsets = closed(found, offsets, end_id)
            low, n = 0, last - first
            while low < n:
                high = min(n, int(np.searchsorted(offsets, offsets[low] + BLOCK_IDS - held)))
                ids.append(found[offsets[low] : offsets[high]])
                docs.append(batch.column(0).slice(first + low, high - low))
                sizes.append(np.diff(offsets[low : high + 1]))
                held, low = held + len(ids[-1]), high
                if held >= BLOCK_IDS:
                    yield flush()
                    block, base = block + 1, base + held
                    ids, docs, sizes, held = [], [], [], 0
    if ids:
        yield flush()


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
                    ("n_ids", pa.int64()), ("words", pa.binary()), ("word_base", pa.list_(pa.int32())), ("escapes", pa.binary())])


def token_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """The rows of the format: texts are range-partitioned by doc_id once, then encoded in order."""
    ordered = whole_texts(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lambda it: _blocks(it, path, end_id), SCHEMA)


def _decoded(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "shard", "at", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    for batch in batches:
        shard, _, base, docs, doc_ends, n_ids, words, _, escapes = batch.columns
        for r in range(batch.num_rows):
            ids = unpack(np.frombuffer(words[r].as_buffer(), "<u8"), n_ids[r].as_py(), np.frombuffer(escapes[r].as_buffer(), "<u4").reshape(-1, 2))
            cuts = np.r_[0, doc_ends[r].values.to_numpy()]
            held, at = memoryview(ids.astype("<u4")).cast("B"), (4 * cuts).tolist()
            crc = np.fromiter((zlib.crc32(held[a:b]) for a, b in zip(at, at[1:])), np.int64, len(cuts) - 1)
            n = len(cuts) - 1
            columns = [docs[r].values, pa.array(np.full(n, shard[r].as_py(), np.int32)), pa.array(base[r].as_py() + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc)]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)


def read_documents(blocks: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Per document of a token data set: `doc_id`, `start`, `n_tokens`, `ids_crc32` and, if wanted, `ids`.

    `start` counts the ids of all documents before it, from the totals of the shards (one row each).
    """
    more = ", ids array<long>" if keep_ids else ""
    each = blocks.mapInArrow(lambda it: _decoded(it, keep_ids), "doc_id long, shard int, at long, n_tokens long, ids_crc32 long" + more)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", before.alias("before"))
    kept = ["ids"] if keep_ids else []
    return each.join(bases, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *kept)


def write_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the token data set of `docs` and give what reading it back says."""
    return read_documents(Scratch(docs.sparkSession, "tokens").put(token_blocks(docs, path, end_id), "blocks"))
