"""Chunks of documents with a dictionary of their own, so that a big table is joined once per distinct value.

A task numbers the distinct values (words, id pairs) of a run of documents, the chunk. Documents keep
numbers only; the dictionary rows of all chunks meet the corpus-wide table in a join, and come back to
the documents of their chunk. A hot value has one row per chunk, not one per occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wavetrail.llm.tokens import gather


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # beyond 2 GiB
        parts = [flat(c) for c in column.chunks]
        base = np.cumsum([0, *(len(d) for d, _ in parts)])
        return np.concatenate([d for d, _ in parts]), np.r_[np.int64(0), np.concatenate([o[1:] + b for (_, o), b in zip(parts, base)])]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    large = pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of rows data[offsets[i], offsets[i + 1]) of at most 2 GiB in all."""
    cuts = np.ascontiguousarray(offsets, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def pick(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the given rows, one row after another, and their offsets."""
    size = (offsets[1:] - offsets[:-1])[rows]
    return data[gather(offsets[:-1][rows], size)], np.r_[0, np.cumsum(size)]


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, lowest first, and the number of bytes of each value (below 2^35)."""
    size = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = (values[more] >> (7 * k) & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, size


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values and the place after the last byte of each."""
    end = np.flatnonzero(data < 128) + 1
    start = np.r_[0, end[:-1]].astype(np.int64)
    out = np.zeros(len(end), np.int64)
    for k in range(5):
        more = np.flatnonzero(end - start > k)
        out[more] |= (data[start[more] + k] & 127).astype(np.int64) << (7 * k)
    return out, end


_ZSTD = pa.Codec("zstd", compression_level=6)


def squeezed(*parts: np.ndarray) -> bytes:
    """Arrays as one compressed value; `expanded` gives their bytes back."""
    sizes = np.array([len(parts), *(p.nbytes for p in parts)], "<u8")
    whole = sizes.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return len(whole).to_bytes(8, "little") + _ZSTD.compress(whole, asbytes=True)


def expanded(held: memoryview | bytes) -> list[np.ndarray]:
    whole = np.frombuffer(_ZSTD.decompress(memoryview(held)[8:], decompressed_size=int.from_bytes(held[:8], "little")), np.uint8)
    n = int(whole[:8].view("<u8")[0])
    ends = 8 * (n + 1) + np.r_[0, np.cumsum(whole[8 : 8 * (n + 1)].view("<u8").astype(np.int64))]
    return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


class Numbers:
    """Numbers of 64-bit keys in the order in which they come first."""

    def __init__(self):
        self.keys, self.place, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, and where in `keys` the new ones come first, in the order of their numbers."""
        asked, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, asked)
        hit = np.zeros(len(asked), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == asked[inside]
        number = np.empty(len(asked), np.int64)
        number[hit] = self.place[at[hit]]
        fresh = np.flatnonzero(~hit)
        order = fresh[np.argsort(first[fresh])]
        number[order] = self.n + np.arange(len(order))
        self.keys, self.place = np.insert(self.keys, at[fresh], asked[fresh]), np.insert(self.place, at[fresh], number[fresh])
        self.n += len(order)
        return number[which], first[order]

    def skip(self, n: int) -> np.ndarray:
        """n numbers for values that are kept apart from the keys."""
        self.n += n
        return np.arange(self.n - n, self.n)
