"""Words and word shingles of whole texts as hashes, computed on Arrow buffers.

A word is a maximal run of letters or digits: ASCII letters (after lower-casing), ASCII digits
and every byte of a non-ASCII character. A shingle is `size` consecutive words. Both are 64-bit
hashes. A text of 1 to `size` - 1 words has one shingle, made of all its words; a text without
a word has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MUL ** i and _INV ** i modulo 2 ** 64 for i < n; only tables of a chunk's size are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_MUL, _INV):
        table = np.full(max(n, CHUNK + 1), base, np.uint64)
        table[0] = 1
        made.append(np.cumprod(table, out=table))
    if n <= CHUNK + 1:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [first, last) with their UTF-8 bytes and the `last - first + 1` offsets into them."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower:
        texts = pc.utf8_lower(texts)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        yield first, last, whole[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """C with hash of bytes [i, j) = (C[j] - C[i]) * _INV ** i."""
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def word_ranges(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that `kind` marks; runs never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ascending ranges data[start, end), from slices of about a chunk at a time."""
    out, low = np.empty(len(start), np.uint64), 0
    while low < len(start):
        base = int(start[low])
        high = max(low + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        prefix = prefix_hashes(data[base : int(end[high - 1])])
        out[low:high] = range_hashes(prefix, start[low:high] - base, end[low:high] - base)
        low = high
    return out


def words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [first, last): hash of every word and its row, counted from `first`."""
    for first, last, data, offsets in text_chunks(texts):
        start, end, row = word_ranges(data, offsets)
        yield first, last, hash_ranges(data, start, end), row


def shingles(word: np.ndarray, row: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle in text order, repeats included."""
    if not len(word):
        return word, row
    n = max(0, len(word) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total + word[k : k + n])
    full = row[:n] == row[size - 1 : size - 1 + n]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[first, len(row)])
    short = [(mix(sequence(word[a : a + n], np.zeros(1, int), int(n)))[0], row[a]) for a, n in zip(first, length) if n < size]
    out, rows = total[full], row[:n][full]
    if short:
        out = np.r_[out, np.array([s for s, _ in short], np.uint64)]
        rows = np.r_[rows, np.array([r for _, r in short], rows.dtype)]
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def sequence(word: np.ndarray, first: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each run of words that starts at `first`: equal for equal word sequences."""
    if not len(first):
        return np.zeros(0, np.uint64)
    length = np.diff(np.r_[first, len(word)])
    at = np.arange(len(word), dtype=np.uint64) - np.repeat(first, length).astype(np.uint64)
    return np.add.reduceat(mix(word + mix(at + np.uint64(1 + salt))), first) + length.astype(np.uint64)


def sets(texts: list[str] | pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    out: list[np.ndarray] = []
    for first, last, word, row in words(texts):
        gram, rows = shingles(word, row, size)
        cut = np.searchsorted(rows, np.arange(last - first + 1))
        out += [np.unique(gram[cut[i] : cut[i + 1]]) for i in range(last - first)]
    return out
