"""BPE encoding and decoding through a table of distinct words.

1. `split_words`: every whole text is split before white space that follows another character, where
   byte-level BPE never merges. A run of about `CHUNK_BYTES` of text, the chunk, numbers its distinct
   words; a document becomes its word numbers in order of position.
2. `encoded_words`: the table of distinct words, partitioned by a hash of the word. A chunk sends its
   words to each part in one packed row, and each distinct word of the corpus is encoded once there.
3. `encode_decode`: the ids go back to the chunks that have the word, and from there to every position
   of their documents. Decoding joins each id with its piece (`id_to_piece`, one row per entry of the
   vocabulary, which bounds it) and puts the bytes together by position.

Words, codes and ids travel as packed and compressed rows: as plain rows, one per chunk and word, they
took three times the input on disk. The written table of step 1 fixes the chunks, so a lost executor
repeats no numbering. Every group is bounded: a chunk by its text, a part by the number of parts, which
grows with the text; a hot word is one entry per chunk.

Defined results: null counts as empty and has no ids; rows with the same id, or without one, are
each encoded on their own; an empty table gives an empty one; other columns are not read. Strings of
special tokens become the special id. A single text may be as long as a row of Spark can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.llm import words as W
from wavetrail.llm.chunks import Numbers, binary, expanded, flat, from_varints, pick, squeezed, to_varints
from wavetrail.llm.common import Scratch, whole_texts
from wavetrail.llm.tokens import encoder, gather, piece_starts

#: Bytes of text that share a dictionary; a chunk ends with the run of documents that reaches it.
CHUNK_BYTES = 32 << 20
#: Bytes of text whose chunks' words meet in one part of the table of distinct words.
PART_BYTES = 64 << 20
#: Word occurrences that are put back at once.
AT_ONCE = 1 << 19
_SPLIT = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("part", pa.int32()), ("data", pa.binary())])
SPLIT = "chunk long, doc_ids array<long>, part int, data binary"


def byte_pieces(path: str) -> dict[int, bytes]:
    """The bytes that each id of a byte-level vocabulary stands for, added tokens included.

    Byte-level vocabularies write a byte as a printable character: bytes 33-126, 161-172 and 174-255
    as themselves, the others in ascending order as the characters from 256 on. A token with any
    other character stands for its own UTF-8 bytes.
    """
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    of = {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    return {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in vocabulary.items()}


def id_to_piece(spark: SparkSession, path: str) -> DataFrame:
    """`id`, `piece` (bytes) of the entries of the vocabulary, whose number bounds the table."""
    return spark.createDataFrame(sorted(byte_pieces(path).items()), "id int, piece binary")


# --- words -----------------------------------------------------------------------------------


class _Words:
    """Distinct words of one chunk."""

    def __init__(self):
        self.numbers, self.bytes, self.ends, self.total = Numbers(), [], [np.zeros(1, np.int64)], 0

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start
        self.bytes.append(data[gather(start, size)])
        self.ends.append(self.total + np.cumsum(size))
        self.total += int(size.sum())

    def code(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        number, new = self.numbers.of(W.hash_ranges(data, start, end))
        self.add(data, start[new], end[new])
        if not np.array_equal(self.words(number)[0], data):  # two words with one hash
            listed = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
            first = {w: i for i, w in reversed(list(enumerate(listed)))}
            order = np.array(sorted(first.values()))
            own = dict(zip((listed[i] for i in order.tolist()), self.numbers.skip(len(order)).tolist()))
            self.add(data, start[order], end[order])
            number = np.array([own[w] for w in listed], np.int64)
        return number

    def words(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.bytes, self.ends = [np.concatenate([np.zeros(0, np.uint8), *self.bytes])], [np.concatenate(self.ends)]
        return pick(self.bytes[0], self.ends[0], number)


def _beginnings(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number in their order."""
    held, key = np.r_[data, np.zeros(8, np.uint8)], np.zeros(len(ends) - 1, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(ends[:-1] + k < ends[1:], held[ends[:-1] + k], 0).astype(np.uint64)
    return key


def _split(batches: Iterator[pa.RecordBatch], parts: int, limit: int) -> Iterator[pa.RecordBatch]:
    task, count, held, words, runs = TaskContext.get().partitionId(), 0, 0, _Words(), []

    def whole() -> Iterator[pa.RecordBatch]:
        """The chunk: its words by part, frequent ones first, and its documents.

        The word at place i of part k has the number i * parts + k, so that frequent words have short codes.
        Among words whose places have as many bits, those that begin alike are neighbours: they pack better.
        """
        n, chunk = words.numbers.n, task << 32 | count
        often = np.bincount(np.concatenate([np.zeros(0, np.int32), *(c for _, c, _ in runs)]), minlength=n)
        data, ends = words.words(np.arange(n))
        part = (W.hash_ranges(data, ends[:-1], ends[1:]) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((-often, part))
        first = np.searchsorted(part[order], np.arange(parts + 1))
        bits = np.empty(n, np.int64)
        bits[order] = np.frexp(np.arange(n) - first[part[order]])[1]
        order = np.lexsort((_beginnings(data, ends), bits, part))
        code = np.empty(n, np.int64)
        code[order] = (np.arange(n) - first[part[order]]) * parts + part[order]
        for docs, number, cuts in runs:
            held, size = to_varints(code[number])
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "doc_ids": docs, "part": None, "data": squeezed(held, np.r_[0, np.cumsum(size)][cuts])}], schema=_SPLIT)
        for k in np.flatnonzero(np.diff(first)):
            mine, mine_ends = pick(data, ends, order[first[k] : first[k + 1]])
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "doc_ids": None, "part": int(k), "data": squeezed(mine, to_varints(np.diff(mine_ends))[0])}], schema=_SPLIT)

    for batch in batches:
        for first, last, data, offsets in W.text_chunks(batch.column(1), lower=False):
            start = piece_starts(data, offsets)
            number = words.code(data, start, np.r_[start[1:], len(data)].astype(np.int64)) if len(start) else np.zeros(0, np.int64)
            runs.append((batch.column(0).slice(first, last - first).to_pylist(), number.astype(np.int32), np.searchsorted(start, offsets)))
            held += len(data)
            if held >= limit:
                yield from whole()
                count, held, words, runs = count + 1, 0, _Words(), []
    if runs:
        yield from whole()


def split_words(docs: DataFrame, parts: int, limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (`chunk`, `doc_ids`, codes as `data`) and of words (`chunk`, `part`, words as `data`)."""
    return whole_texts(docs).mapInArrow(lambda it: _split(it, parts, limit), SPLIT)


# --- the table of distinct words ---------------------------------------------------------------


def _unpacked(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the words of all rows, and the number of words up to each row."""
    pools, sizes, counts = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [0]
    for row in rows:
        pool, lengths = expanded(row.as_buffer())
        pools.append(pool)
        sizes.append(from_varints(lengths)[0])
        counts.append(len(sizes[-1]))
    return np.concatenate(pools), np.r_[0, np.cumsum(np.concatenate(sizes))], np.cumsum(counts)


def _encoded(table: pa.Table, path: str) -> pa.Table:
    """One part: each distinct word is encoded once; every chunk gets the ids of its words, in its order."""
    data, offsets, ends = _unpacked(table["data"])
    distinct = _Words()
    number = distinct.code(data, offsets[:-1], offsets[1:])
    pool, cuts = distinct.words(np.arange(distinct.numbers.n))
    ids, count = encoder(path).pieces(pool, cuts[:-1], cuts[1:])
    id_ends = np.r_[0, np.cumsum(count)]
    out = []
    for low, high in zip(ends, ends[1:]):
        own, own_ends = pick(ids, id_ends, number[low:high])
        out.append(squeezed(own.astype("<u4").view(np.uint8).reshape(-1, 4).T, to_varints(np.diff(own_ends))[0]))
    return pa.table({"chunk": table["chunk"], "part": table["part"], "ids": pa.array(out, pa.binary())})


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """`chunk`, `part`, `ids` (packed) for the packed words `chunk`, `part`, `data` of all chunks."""
    return words.groupBy("part").applyInArrow(lambda table: _encoded(table, path), "chunk long, part int, ids binary")


# --- ids and their pieces ----------------------------------------------------------------------


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, pos, id, piece) in their order -> (key, ids, bytes); rows of a key follow each other."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
        pos = table["pos"].to_numpy()
        first = np.flatnonzero(pos == 0)
        last_is_whole = len(pos) and pos[-1] + 1 == max(table["n"][-1].as_py(), 1)
        stop = len(pos) if last_is_whole else int(first[-1]) if len(first) else 0
        kept = None if last_is_whole else table.slice(stop).combine_chunks().to_batches()[0]
        first, whole = first[first < stop], table.slice(0, stop)
        if not len(first):
            continue
        count = np.diff(np.r_[first, stop])
        if first[0] != 0 or not np.array_equal(np.maximum(whole["n"].to_numpy()[first], 1), count):
            raise RuntimeError("rows of a key were parted")
        data, offsets = flat(whole["piece"].combine_chunks().fill_null(b""))
        used = ~whole["id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids = whole["id"].combine_chunks().fill_null(0).to_numpy().astype("<u4")[used]
        ends = np.r_[0, np.cumsum(used)][np.r_[first, stop]]
        yield pa.RecordBatch.from_arrays(
            [whole["key"].combine_chunks().take(pa.array(first)), binary(ids, 4 * ends), binary(data, offsets[np.r_[first, stop]])], ["key", "ids", "bytes"])
    if kept is not None:
        raise RuntimeError("rows of a key were parted")


def with_bytes(rows: DataFrame, key: str, path: str) -> DataFrame:
    """`key` (binary), `ids` (unsigned 32-bit, little-endian) and `bytes` of each row of `rows(key, ids array<int>)`.

    Ids are exploded and joined with their pieces. A broadcast join keeps the order of its rows, so
    those of a row of `rows` stay together and need no shuffle; that is checked, not assumed. Ids
    that are not in the vocabulary have no bytes.
    """
    listed = rows.select(F.col(key).cast("binary").alias("key"), F.size("ids").alias("n"), F.posexplode_outer("ids").alias("pos", "id"))
    listed = listed.withColumn("pos", F.coalesce("pos", F.lit(0)))
    pieces = F.broadcast(id_to_piece(rows.sparkSession, path))
    joined = listed.join(pieces, "id", "left").select("key", "n", "pos", "id", "piece")
    return joined.mapInArrow(_regrouped, "key binary, ids binary, bytes binary")


def decode(rows: DataFrame, key: str, path: str) -> DataFrame:
    """`key` (as string) and `text` of any table of ids, as the library's decode(ids, skip_special_tokens=False).

    Bytes that are no UTF-8 become U+FFFD. Null or empty `ids` give an empty text.
    """
    lossy = lambda it: (pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([x.decode("utf-8", "replace") for x in b.column(2).to_pylist()], pa.string())], ["key", "text"]) for b in it)
    listed = rows.withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<int>)"))).withColumn(key, F.col(key).cast("string"))
    return with_bytes(listed, key, path).mapInArrow(lossy, "key string, text string").withColumnRenamed("key", key)


# --- back to positions -----------------------------------------------------------------------------


def _dictionary(rows: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a chunk's words, their offsets, and where the words of each part begin."""
    by = dict(zip(rows["part"].to_pylist(), rows["ids"]))
    ids, sizes, begin = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], np.zeros(parts, np.int64)
    known = 0
    for k in sorted(by):
        planes, lengths = expanded(by[k].as_buffer())
        ids.append(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel())
        sizes.append(from_varints(lengths)[0])
        begin[k] = known
        known += len(sizes[-1])
    return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))], begin


def _placed(docs: pa.Table, words: pa.Table, parts: int, pieces, keep: bool) -> pa.Table:
    """Ids and text of each document of one chunk, from its codes and the chunk's dictionary."""
    ids, id_ends, begin = _dictionary(words, parts)
    piece, piece_ends = pieces.value
    listed, n, ids_hash, text_hash, all_ids, texts = [], [], [], [], [], []
    for row, doc_ids in zip(docs["data"], docs["doc_ids"]):
        codes, cuts = expanded(row.as_buffer())
        value, ends = from_varints(codes)
        at = np.searchsorted(ends, cuts.view("<i8"), "right")  # words before each document
        listed += doc_ids.as_py()
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + AT_ONCE, "right")) - 1)
            number = value[at[low] : at[high]]
            own, own_ends = pick(ids, id_ends, begin[number % parts] + number // parts)
            held, held_ends = pick(piece, piece_ends, own.astype(np.int64))  # the join of ids and pieces
            a = own_ends[at[low : high + 1] - at[low]]
            b = held_ends[a].tolist()
            a = a.tolist()
            for k in range(high - low):
                mine, text = own[a[k] : a[k + 1]], held[b[k] : b[k + 1]].tobytes().decode("utf-8", "replace")
                n.append(len(mine))
                ids_hash.append(hashlib.sha256(mine.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                if keep:
                    all_ids.append(mine.astype(np.int64))
                    texts.append(text)
            low = high
    columns = {"doc_id": pa.array(listed, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
    if keep:
        columns |= {"ids": pa.array(all_ids, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
    return pa.table(columns)


def encode_decode(docs: DataFrame, path: str, keep: bool = False, limit: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: `doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`; with `keep` also `ids` and `decoded`."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
    parts = -(-total // part_bytes) + 1
    split = Scratch(spark, "bpe").put(split_words(docs, parts, limit), "words")
    told = encoded_words(split.where("part is not null").select("chunk", "part", "data"), path)
    coded = split.where("part is null").select(F.col("chunk").alias("own"), "doc_ids", "data")
    of = byte_pieces(path)
    listed = [of.get(i, b"") for i in range(max(of) + 1)]
    pieces = spark.sparkContext.broadcast((np.frombuffer(b"".join(listed), np.uint8), np.cumsum([0, *map(len, listed)])))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep else "")
    return coded.groupBy("own").cogroup(told.groupBy("chunk")).applyInArrow(lambda left, right: _placed(left, right, parts, pieces, keep), schema)
