"""BPE encoding and decoding through the table of distinct words."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.test_tokens import BYTE, ODD
from wavetrail.llm import bpe, chunks
from wavetrail.llm import words as W


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute(text):
    library = Tokenizer.from_file(BYTE)
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode()), ids, decoded


@pytest.mark.parametrize("limit", [1, 400, 1 << 24])
def test_encoding_and_decoding_equal_the_library(docs, limit):
    rows = [(3 * i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "a  b\n\n c"), (3, "other"), (7, "the the the " * 2_000)]
    got = bpe.encode_decode(docs(rows).repartition(3), BYTE, keep=True, limit=limit, part_bytes=limit * 50).collect()
    want = sorted([(i, *brute(t)) for i, t in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_an_empty_table_and_the_columns(docs):
    out = bpe.encode_decode(docs([]), BYTE)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.isEmpty()


def test_each_distinct_word_is_encoded_once(monkeypatch):
    listed = [[b"a", b" b", b" c"], [b" c", b"a", b"x"], [b"a"]]
    rows = []
    for words in listed:
        data = np.frombuffer(b"".join(words), np.uint8)
        rows.append(chunks.squeezed(data, chunks.to_varints(np.array([len(w) for w in words]))[0]))
    asked, plain = [], bpe.encoder(BYTE).pieces
    monkeypatch.setattr(bpe.encoder(BYTE), "pieces", lambda data, start, end: asked.extend(data[a:b].tobytes() for a, b in zip(start, end)) or plain(data, start, end))
    out = bpe._encoded(pa.table({"chunk": [5, 6, 7], "part": pa.array([2] * 3, pa.int32()), "data": rows}), BYTE)
    assert sorted(asked) == [b" b", b" c", b"a", b"x"]
    for words, row in zip(listed, out["ids"]):
        ids, ends, begin = bpe._dictionary(pa.table({"part": [2], "ids": [row.as_py()]}), 3)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [brute(w.decode())[3] for w in words] and begin[2] == 0


def test_decoding_any_ids(spark, docs):
    docs([])
    library = Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 50_257, n).tolist()) for i, n in enumerate((1, 2, 50, 3_000))]
    rows += [(10, []), (11, None), (12, [50_256, 64, 50_256]), (13, [99_999, 64]), (14, library.encode("日本語 é").ids[:2]), (15, [64]), (15, [65])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3), "doc_id", BYTE).collect()
    assert sorted((int(r.doc_id), r.text) for r in got) == sorted((i, library.decode(ids or [], skip_special_tokens=False)) for i, ids in rows)


def test_words_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(W, "hash_ranges", lambda data, start, end: (end - start).astype(np.uint64))
    held = bpe._Words()
    for text in (b"ab cd", b"xy ab", b"ab ef cd ab"):
        data = np.frombuffer(text, np.uint8)
        start = bpe.piece_starts(data, np.array([0, len(data)]))
        number = held.code(data, start, np.r_[start[1:], len(data)])
        assert held.words(number)[0].tobytes() == text


def test_varints_and_binary_columns_round_trip():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 21, 1 << 28, (1 << 35) - 1], np.int64)
    data, size = chunks.to_varints(values)
    assert np.array_equal(chunks.from_varints(data)[0], values) and len(data) == size.sum()
    column = pa.chunked_array([pa.array([b"ab", b"", b"cde"]).slice(1), pa.array([b"x"])])
    held, cuts = chunks.flat(column)
    assert chunks.binary(held, cuts).to_pylist() == column.to_pylist()
