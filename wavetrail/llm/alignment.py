"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A whole text is encoded by a byte-level BPE (A, given a space and the text) and by a sentencepiece
model (B, which adds the space). Byte offsets where tokens of both end are shared cuts. An interval of
tokens is divided at a shared cut near its middle: a bisect finds the token end of A next to the middle
byte, a bisect in the ends of B tells whether it is shared, and the search goes outwards in steps that
double. Both halves are divided in turn, all intervals of a level at once; an interval without a shared
cut is a leaf, that is a group. All pairs of an A and a B token of one group are links.

How many documents hold a pair of ids is counted in Spark: a task numbers the pairs of a run of
documents (the chunk), a document keeps its numbers with how often it has each, and a chunk has one row
per pair with its number of documents. These rows are summed by pair, compared with the best pair of
their A id (one row per entry of A's vocabulary), and go back to the documents of their chunk.

Pairs inside a group are never listed one by one: links are counted from the sizes of both sides, and
pairs from the distinct ids of both sides, whatever the length of the group.

Defined results: a text that is null, empty, or not given back by the bytes of its tokens, has zeros
and an empty `groups_sha256`. Rows with the same id, or without one, are documents of their own; an
empty table gives an empty one; other columns are not read. A long text is encoded in slices, cut
where both tokenizers cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.llm import words as W
from wavetrail.llm.bpe import byte_pieces
from wavetrail.llm.chunks import Numbers, binary, flat, from_varints, pick, to_varints
from wavetrail.llm.common import Scratch, whole_texts
from wavetrail.llm.tokens import encoder, gather, piece_encoder

#: Bytes of text whose documents share a dictionary of pairs.
CHUNK_BYTES = 32 << 20
#: Pairs of occurrences that a group may list before its distinct ids are counted instead.
LISTED = 64
_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                     ("codes", pa.binary()), ("number", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, number int, a int, b int, docs long"


def shared_cuts(end_a: np.ndarray, end_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A token and first B token of every group, in order.

    `end_a`, `end_b`: byte ends of all tokens, ascending over all texts; `cut_a`, `cut_b`: where the
    tokens of each text begin, and their number. A text has tokens of both or of neither.
    """
    some = np.flatnonzero(np.diff(cut_a))
    a0, a1, b0, b1 = cut_a[some], cut_a[some + 1], cut_b[some], cut_b[some + 1]
    low = np.r_[0, end_a]  # low[i]: where token i of A begins
    leaf_a, leaf_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a0):
        near = np.clip(np.searchsorted(end_a, (low[a0] + low[a1]) // 2), a0, np.maximum(a1 - 2, a0))
        at, match = np.full(len(a0), -1), np.zeros(len(a0), np.int64)
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        step = 0
        while len(open_):
            # ends at a distance of step to 2 * step - 1 tokens from the middle, on both sides
            n, far = near[open_], max(2 * step - 1, 0)
            left, right = np.maximum(n - far, a0[open_]), np.minimum(n + far, a1[open_] - 2)
            size_l = np.maximum(n - step - left + 1, 0)
            size_r = np.maximum(right - (n + step) + 1, 0) if step else np.zeros(len(open_), np.int64)
            place = np.r_[gather(left, size_l), gather(n + step, size_r)]
            owner = np.r_[np.repeat(open_, size_l), np.repeat(open_, size_r)]
            other = np.searchsorted(end_b, end_a[place])
            hit = np.flatnonzero(end_b[np.minimum(other, len(end_b) - 1)] == end_a[place])
            hit = hit[np.lexsort((np.abs(place[hit] - near[owner[hit]]), owner[hit]))]
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]] if len(hit) else hit
            at[owner[hit]], match[owner[hit]] = place[hit], other[hit]
            n = near[open_]
            open_ = open_[(at[open_] < 0) & ((n - far > a0[open_]) | (n + far < a1[open_] - 2))]
            step = max(1, 2 * step)
        leaf = at < 0
        leaf_a.append(a0[leaf])
        leaf_b.append(b0[leaf])
        a0, a1, b0, b1, at, match = (x[~leaf] for x in (a0, a1, b0, b1, at, match))
        # both halves side by side: the next level asks in ascending order
        a0, a1, b0, b1 = (np.stack(x, 1).ravel() for x in ((a0, at + 1), (at + 1, a1), (b0, match + 1), (match + 1, b1)))
    return np.sort(np.concatenate(leaf_a)), np.sort(np.concatenate(leaf_b))


@cache
def _vocabulary(path_a: str, path_b: str) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Bytes of A's and B's entries, and the decimal writing of all ids, each with offsets."""
    of = byte_pieces(path_a)
    listed = ([of.get(i, b"") for i in range(max(of) + 1)], piece_encoder(path_b).bytes)
    listed += ([str(i).encode() for i in range(max(map(len, listed)))],)
    return tuple((np.frombuffer(b"".join(x), np.uint8), np.cumsum([0, *map(len, x)])) for x in listed)


class Unit:
    """Alignment of some texts, given by bytes that begin with the added space (or have no byte at all).

    `n_a`, `n_b`, `n_groups`, `n_links` per text; `key` (text << 32 | A id * size of B + B id) and
    `weight` (links) of the distinct pairs of each text, ascending; `written` and `cuts`: its groups.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
        (bytes_a, ends_a), (bytes_b, ends_b), (digits, digit_ends) = _vocabulary(path_a, path_b)
        a, cut_a = encoder(path_a, plain=True).encode_bytes(data, offsets)
        b, cut_b = piece_encoder(path_b).encode_bytes(data, offsets)
        a, b, n = a.astype(np.int64), b.astype(np.int64), len(offsets) - 1
        self.whole = np.ones(n, bool)
        for ids, cut, pool, ends in ((a, cut_a, bytes_a, ends_a), (b, cut_b, bytes_b, ends_b)):
            joined, at = pick(pool, ends, ids)
            if not np.array_equal(joined, data):
                begin = at[cut]
                for i in range(n):
                    self.whole[i] &= np.array_equal(joined[begin[i] : begin[i + 1]], data[offsets[i] : offsets[i + 1]])
        if not self.whole.all():
            a, cut_a = pick(a, cut_a, np.flatnonzero(self.whole))[0], np.r_[0, np.cumsum(np.where(self.whole, np.diff(cut_a), 0))]
            b, cut_b = pick(b, cut_b, np.flatnonzero(self.whole))[0], np.r_[0, np.cumsum(np.where(self.whole, np.diff(cut_b), 0))]
        group_a, group_b = shared_cuts(np.cumsum(np.diff(ends_a)[a]), np.cumsum(np.diff(ends_b)[b]), cut_a, cut_b)
        p, q = np.diff(np.r_[group_a, len(a)]), np.diff(np.r_[group_b, len(b)])
        begin = np.searchsorted(group_a, cut_a)
        self.n_a, self.n_b, self.n_groups = np.diff(cut_a), np.diff(cut_b), np.diff(begin)
        self.n_links = np.diff(np.r_[0, np.cumsum(p * q)][begin])
        self.key, self.weight = _pairs(a, b, group_a, group_b, p, q, np.repeat(np.arange(n), self.n_groups), len(piece_encoder(path_b).bytes))
        self.written, self.cuts = _written(a, b, p, q, cut_a, cut_b, digits, digit_ends)


def _pairs(a, b, group_a, group_b, p, q, text, size_b) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, A id, B id) keys in ascending order and their numbers of links."""
    few = np.flatnonzero(p * q <= LISTED)
    nth = gather(np.zeros(len(few), np.int64), (p * q)[few])
    of = np.repeat(few, (p * q)[few])
    keys = [text[of] << 32 | a[group_a[of] + nth // q[of]] * size_b + b[group_b[of] + nth % q[of]]]
    weights = [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(p * q > LISTED).tolist():
        ids_a, n_a = np.unique(a[group_a[g] : group_a[g] + p[g]], return_counts=True)
        ids_b, n_b = np.unique(b[group_b[g] : group_b[g] + q[g]], return_counts=True)
        keys.append((text[g] << 32 | ids_a[:, None] * size_b + ids_b).ravel())
        weights.append((n_a[:, None] * n_b).ravel())
    return _summed(np.concatenate(keys), np.concatenate(weights))


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(weight[order], first)


def _written(a, b, p, q, cut_a, cut_b, digits, digit_ends) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of each text, one after another, and where each begins."""
    n_groups, total = len(p), len(a) + len(b)
    group_of_a, group_of_b = np.repeat(np.arange(n_groups), p), np.repeat(np.arange(n_groups), q)
    at_a = np.arange(len(a)) + (np.cumsum(q) - q)[group_of_a]
    at_b = np.arange(len(b)) + np.cumsum(p)[group_of_b]
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[np.cumsum(p) - 1]] = ord("|")
    mark[at_b[np.cumsum(q) - 1]] = ord(";")
    token_cuts = cut_a + cut_b
    size = np.diff(digit_ends)[ids]
    last = token_cuts[1:][np.diff(token_cuts) > 0] - 1
    step = size + 1
    step[last] -= 1  # nothing follows the last group of a text
    begin = np.cumsum(step) - step
    out = np.empty(int(step.sum()), np.uint8)
    out[gather(begin, size)] = pick(digits, digit_ends, ids)[0]
    inner = np.delete(np.arange(total), last)
    out[begin[inner] + size[inner]] = mark[inner]
    return out, np.r_[begin, len(out)][token_cuts]


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text (with its space) in slices that begin at a single space after a visible ASCII character."""
    low = 0
    safe = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    while low < len(data):
        k = int(np.searchsorted(safe, low + W.CHUNK))
        high = int(safe[k]) if k < len(safe) else len(data)
        yield data[low:high]
        low = high


def _long(data: np.ndarray, path_a: str, path_b: str) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """Counts, hash and pairs of one long text, slice by slice."""
    counts, text, key, weight = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k, part in enumerate(_slices(data)):
        unit = Unit(part, np.array([0, len(part)]), path_a, path_b)
        if not unit.whole[0]:
            return [0, 0, 0, 0], "", key[:0], weight[:0]
        counts += [unit.n_a[0], unit.n_b[0], unit.n_groups[0], unit.n_links[0]]
        text.update(b";" * (k > 0) + unit.written.tobytes())
        key, weight = _summed(np.r_[key, unit.key], np.r_[weight, unit.weight])
    return counts.tolist(), text.hexdigest(), key, weight


def _split(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, limit: int) -> Iterator[pa.RecordBatch]:
    task, count, held = TaskContext.get().partitionId(), 0, 0
    numbers, docs, pairs = Numbers(), np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    size_b = len(piece_encoder(path_b).bytes)

    def listed() -> Iterator[pa.RecordBatch]:
        pair = np.concatenate(pairs)
        for low in range(0, len(pair), 1 << 16):
            part = slice(low, low + (1 << 16))
            n = len(pair[part])
            rows = {"chunk": np.full(n, task << 32 | count), "number": np.arange(low, low + n).astype(np.int32), "a": (pair[part] // size_b).astype(np.int32), "b": (pair[part] % size_b).astype(np.int32), "docs": docs[part]}
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)

    for batch in batches:
        for first, last, data, offsets in W.text_chunks(batch.column(1), lower=False):
            n, size = last - first, np.diff(offsets)
            some = size > 0
            spaced = np.full(len(data) + int(some.sum()), 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.cumsum(some), size)] = data
            cuts = np.r_[0, np.cumsum(size + some)]
            if len(data) > W.CHUNK:  # a long text is alone
                (n_a, n_b, n_groups, n_links), text, key, weight = _long(spaced, path_a, path_b)
                columns, texts = [np.array([x]) for x in (n_a, n_b, n_groups, n_links)], [text]
            else:
                unit = Unit(spaced, cuts, path_a, path_b)
                columns, key, weight = [unit.n_a, unit.n_b, unit.n_groups, unit.n_links], unit.key, unit.weight
                written, at = memoryview(unit.written), unit.cuts.tolist()
                texts = [hashlib.sha256(written[a:b]).hexdigest() if b > a else "" for a, b in zip(at, at[1:])]
            code, new = numbers.of((key & 0xFFFFFFFF).astype(np.uint64))
            pairs.append(key[new] & 0xFFFFFFFF)
            docs = np.r_[docs, np.zeros(len(new), np.int64)] + np.bincount(code, minlength=len(docs) + len(new))
            both = np.empty(2 * len(code), np.int64)
            both[::2], both[1::2] = code, weight
            held_codes, width = to_varints(both)
            ends = np.r_[0, np.cumsum(width)][2 * np.searchsorted(key, np.arange(n + 1) << 32)]
            rows = [np.full(n, task << 32 | count), batch.column(0).slice(first, n), *columns, texts, binary(held_codes, ends)]
            yield pa.RecordBatch.from_arrays([r if isinstance(r, pa.Array) else pa.array(r, f.type) for r, f in zip(rows, _SCHEMA)] + [pa.nulls(n, f.type) for f in list(_SCHEMA)[8:]], schema=_SCHEMA)
            held += len(data)
            if held >= limit:
                yield from listed()
                count, held, numbers, docs, pairs = count + 1, 0, Numbers(), np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    yield from listed()


def alignments(docs: DataFrame, path_a: str, path_b: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (counts, hash, `codes`: pair numbers and links in turn) and of the pairs of each chunk."""
    return whole_texts(docs).mapInArrow(lambda it: _split(it, path_a, path_b, limit), SCHEMA)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """`a`, `b`, `count` (documents with the pair) from rows (`a`, `b`, `docs`)."""
    return pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))


def _told(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """`n_best` and `count_sum` of the documents of one chunk."""
    order = np.argsort(pairs["number"].to_numpy())
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    if len(order) and pairs["number"].to_numpy()[order[-1]] != len(order) - 1:
        raise RuntimeError("the dictionary of a chunk is not whole")
    data, cuts = flat(docs["codes"])
    value, ends = from_varints(data)
    code, weight = value[::2], value[1::2]
    at = np.searchsorted(ends, cuts, "right") // 2
    sums = [np.r_[0, np.cumsum(x)] for x in (weight * best[code], weight * count[code])] if len(code) else [np.zeros(1, np.int64)] * 2
    n_best, count_sum = (s[at[1:]] - s[at[:-1]] for s in sums)
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(columns | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": docs["groups_sha256"]})


def aligned(docs: DataFrame, path_a: str, path_b: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Per document: `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`."""
    scratch = Scratch(docs.sparkSession, "alignment")
    split = scratch.put(alignments(docs, path_a, path_b, limit), "tokens")
    pairs = split.where("number is not null").select("chunk", "number", "a", "b", "docs")
    counts = scratch.put(pair_counts(pairs), "pairs")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # at most one row per entry of A's vocabulary
    rated = counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    told = pairs.join(rated, ["a", "b"]).select("chunk", "number", "count", "best")
    whole = split.where("number is null").select(F.col("chunk").alias("own"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return whole.groupBy("own").cogroup(told.groupBy("chunk")).applyInArrow(_told, schema)
