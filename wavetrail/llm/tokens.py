"""Token ids of whole texts by a public tokenizer, with a memo of pieces that come again.

Both tokenizers split a text before any white space that follows another character, and encode
what lies between independently. Texts are therefore cut there, on Arrow buffers; each distinct
piece is encoded once by the library, many joined into one call, and the ids of a batch are
gathered by index. A piece that the join could change is encoded alone. Null counts as empty.
The memo finds a piece by its 64-bit hash, in sorted arrays of a bounded size.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from wavetrail.llm import words as W

#: Ids that one Python worker remembers; the memo starts anew beyond that.
MEMO_IDS = 6_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_JOINABLE = np.zeros(256, bool)
_JOINABLE[[9, 10, 13, *range(32, 127), 0xC3]] = True
#: Pieces in one joined call.
_PART = 512
_encoders: dict[tuple[str, bool], Encoder] = {}


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, and at ASCII white space after a character that is none.

    A byte above 127 may end a wide space (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000);
    no cut is made after one that might.
    """
    before = np.r_[np.zeros(3, np.uint8), data]
    cut = _SPACE[data] & ~_SPACE[before[2:-1]]
    at = np.flatnonzero(cut)
    p1, p2, p3 = before[at + 2], before[at + 1], before[at]
    wide = (p1 >= 128) & (((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & np.isin(p2, (0x80, 0x81, 0x9A))))
    mark = np.zeros(len(data) + 1, bool)
    mark[at[~wide]] = True
    mark[offsets] = True
    return np.flatnonzero(mark[:-1])


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the ranges [start, start + size), one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of whole texts as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    `plain`: strings of special tokens inside a text are ordinary text; by default they become
    the special id, as the library does it.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.drops_space = any(n.endswith("</w>") for n in names)
        self.width = np.array([len(n) - 4 * (self.drops_space and n.endswith("</w>")) for n in names])
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added):
            raise ValueError("added tokens that look at white space around them are not supported")
        self._forget()

    def _forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.order, self.slot = np.zeros(0, np.int64), np.zeros(1 << 20, np.int32)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text straight from the library."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces data[start, end), one after another, and how many each has."""
        ids, count = [], np.zeros(len(start), np.int64)
        odd = np.r_[0, np.cumsum(~(_JOINABLE[data] | (data >= 0x80) & (data < 0xC0) & (np.r_[np.uint8(0), data[:-1]] == 0xC3)))]
        solid = np.r_[0, np.cumsum(~_SPACE[data])] if self.drops_space else np.arange(len(data) + 1)
        join = (odd[end] == odd[start]) & _SPACE[data[start]] & ~_SPACE[data[end - 1]]
        joined, alone = np.flatnonzero(join), np.flatnonzero(~join)
        parts = [joined[k : k + _PART] for k in range(0, len(joined), _PART)]
        texts = [data[gather(start[p], end[p] - start[p])].tobytes().decode() for p in parts]
        order = []
        for part, found in zip(parts, self.raw(texts)):
            want, reached = np.cumsum(solid[end[part]] - solid[start[part]]), np.cumsum(self.width[found])
            ends = np.searchsorted(reached, want) + 1
            if len(found) == 0 or ends[-1] != len(found) or not np.array_equal(reached[ends - 1], want):
                alone = np.r_[alone, part]  # a normaliser changed a length
            else:
                ids.append(found)
                order.append(part)
                count[part] = np.diff(np.r_[0, ends])
        single = self.raw([data[a:b].tobytes().decode() for a, b in zip(start[alone].tolist(), end[alone].tolist())])
        ids += single
        order.append(alone)
        count[alone] = [len(i) for i in single]
        place, ids = np.concatenate(order), np.concatenate([np.zeros(0, np.uint32), *ids])
        at = np.zeros(len(start), np.int64)
        at[place] = np.cumsum(count[place]) - count[place]
        return ids[gather(at, count)], count

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, count = self.pieces(data, start, end)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), np.uint32)]
        self.pool[self.used : self.used + len(ids)] = ids
        self.start = np.r_[self.start, self.used + np.cumsum(count) - count]
        self.length, self.key = np.r_[self.length, count], np.r_[self.key, keys]
        self.order = np.argsort(self.key, kind="stable")
        self.slot[(keys >> np.uint64(44)).astype(np.int64)] = np.arange(len(self.key) - len(keys), len(self.key))
        self.used += len(ids)

    def _places(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the memo has each piece; unknown ones are encoded first."""
        if self.used > MEMO_IDS:
            self._forget()
        out = self.slot[(keys >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero(self.key[out] != keys) if len(self.key) else np.arange(len(keys))
        if len(missed):
            asked, first, which = np.unique(keys[missed], return_index=True, return_inverse=True)
            for known in (False, True):
                at = np.minimum(np.searchsorted(self.key, asked, sorter=self.order), max(len(self.key) - 1, 0))
                hit = self.key[self.order[at]] == asked if len(self.key) else np.zeros(len(asked), bool)
                if known or hit.all():
                    break
                new = missed[first[~hit]]
                self._learn(asked[~hit], data, start[new], end[new])
            out[missed] = self.order[at][which]
        return out

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start that are encoded independently."""
        return piece_starts(data, offsets)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given by their UTF-8 bytes and the offsets of each, and the offsets of their ids."""
        start = self.starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.r_[start[1:], len(data)]
        place = self._places(W.hash_ranges(data, start, end), data, start, end)
        size = self.length[place]
        return self.pool[gather(self.start[place], size)], np.r_[0, np.cumsum(size)][np.searchsorted(start, offsets)]

    def encode(self, texts: pa.Array):
        """Runs of rows: (first, last, ids of all its texts, offsets of each text in them)."""
        for first, last, data, offsets in W.text_chunks(texts, lower=False):
            yield first, last, *self.encode_bytes(data, offsets)


class PieceEncoder(Encoder):
    """Ids of texts by a sentencepiece model that adds a space; the texts are given with that space.

    No piece of the vocabulary has a space after another character, so texts are cut there and every
    piece begins with a space: the one that the model adds by itself.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.drops_space = SentencePieceProcessor(model_file=path), False
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^\u2581]\u2581", n) for n in names) or self.model.encode("a  b ", out_type=str)[-1] != "\u2581":
            raise ValueError("a model is needed whose pieces have spaces in front only and that keeps spaces")
        self.space = self.model.piece_to_id("\u2581")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
        self._forget()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        before = np.r_[np.uint8(0), data[:-1]]
        mark = np.r_[(data == 32) & (before != 32), False]
        mark[offsets] = True
        return np.flatnonzero(mark[:-1])

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode() for a, b in zip((start + 1).tolist(), end.tolist())]
        found = [ids or [self.space] for ids in self.model.encode(texts, num_threads=1)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum())), count


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a sentencepiece model, made once in each Python worker."""
    if (path, True) not in _encoders:
        _encoders[path, True] = PieceEncoder(path)
    return _encoders[path, True]


def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of a file, made once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


def closed(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """`ids` with an end id after each text, and the new offsets."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)


def public_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
