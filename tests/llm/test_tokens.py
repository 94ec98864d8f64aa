"""Tokenizing, token files and packing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wavetrail.llm import packing, token_files, tokens

WORD, BYTE = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")
ODD = ["", "  ", "a  b\n\n c", "it's don't  we'll", "x y 　 z", "é é", "!\x1c? \x1d a", "<|endoftext|> hi", "hi  <|endoftext|>there<|startoftext|> <|end", "ΑΣ ΑΣ\nİx",
       "\ttab\r\nnew ", "12 345,6 ... ??? $$$", "日本語 テキスト", "a\u0085b c", "​ x", "a   b Ünï  ÉÇ", None, "end ", " Ünï", "a 　 b", "word " * 3_000]


def library(texts, path, plain=False):
    """Ids as the library gives them for each whole text, by a tokenizer of its own."""
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = plain
    return [np.array(own.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_the_whole_text(path, plain):
    encoder = tokens.Encoder(path, plain)
    got = []
    for first, last, ids, offsets in encoder.encode(pa.array(ODD)):
        got += [ids[offsets[i] : offsets[i + 1]] for i in range(last - first)]
    want = library(ODD, path, plain)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and len(got) == len(want)
    assert any(49406 <= i for ids in want for i in ids) != plain or path == BYTE


def test_a_small_memo_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_IDS", 20)
    encoder = tokens.Encoder(BYTE)
    for text, want in zip(ODD * 2, library(ODD, BYTE) * 2):
        assert all(np.array_equal(ids, want) for _, _, ids, _ in encoder.encode(pa.array([text], pa.string())))


def test_words_of_the_format_round_trip():
    rng = np.random.default_rng(0)
    for high in (1, 2, 9, 40_000, 1 << 19, 1 << 32):
        for n in (0, 1, 7, 240, 5_000):
            ids = rng.integers(0, high, n).astype(np.uint32)
            words, base, escapes = token_files.pack(ids)
            assert np.array_equal(token_files.unpack(words, n, escapes), ids)
            assert len(base) == -(-len(words) // token_files.EVERY)
    words, _, _ = token_files.pack(np.zeros(6_000, np.uint32))
    assert len(words) == 100  # zeros are stored as ones: sixty bits of one


def expected(texts, path, end):
    return [np.r_[ids, np.uint32(end)].astype("<u4") for ids in library(texts, path)]


def test_token_files_are_read_back_in_order(docs, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    rows = list(reversed([(3 * i, t) for i, t in enumerate(ODD)]))
    got = sorted(token_files.write_and_read(docs(rows), WORD, 2).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, ids in zip(got, expected(ODD, WORD, 2)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write_and_read(docs([]), WORD, 2).isEmpty()


@pytest.mark.parametrize("targets", [None, {"a": 0.7, "b": 0.2}])
def test_every_token_is_packed_once(docs, targets):
    texts = ODD * 4
    sources = {i: ("a", "b", None, "c")[i // len(ODD)] for i in range(len(texts))}
    table = docs(texts, sources)
    want = expected(texts, BYTE, 1)
    pieces = packing.pack(table, BYTE, 1, targets, width=64, keep_ids=True)
    got = pieces.collect()
    place = {}
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        for k in range(r.length):
            assert place.setdefault((r.doc_id, r.start + k), (r.sequence_id, r.offset + k)) == (r.sequence_id, r.offset + k)
    assert len(place) == sum(map(len, want)) == len(set(place.values()))
    lengths = {}
    for s, o in place.values():
        lengths[s] = max(lengths.get(s, 0), o + 1)
    assert sorted(lengths) == list(range(len(lengths)))
    assert sum(lengths.values()) == len(place)  # gapless
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())
    if targets is None:  # each full window holds each source in its share
        total = {s: sum(len(w) for i, w in enumerate(want) if sources[i] == s) for s in set(sources.values())}
        for window in range(sum(map(len, want)) // 64):
            held = dict.fromkeys(total, 0)
            for (d, _), (s, _) in place.items():
                if s == window:
                    held[sources[d]] += 1
            assert all(abs(held[s] - 64 * total[s] / len(place)) <= 2 for s in total)
    else:
        first = [sources[d] for (d, _), (s, _) in place.items() if s < 3]
        assert first.count("a") > 0.6 * len(first)
    whole = {r.sequence_id: r for r in packing.assemble(pieces).collect()}
    assert all(len(r.ids) == 4 * r.length for r in whole.values()) and len(whole) == len(lengths)


def test_sources_too_small_for_a_queue_are_packed_too(docs):
    texts = ["word " * 900, *ODD]
    got = packing.pack(docs(texts, {i: f"s{i}" for i in range(len(texts))}), BYTE, 1, width=16, keep_ids=True).collect()
    want = expected(texts, BYTE, 1)
    places = [(r.sequence_id, r.offset + k) for r in got for k in range(r.length)]
    assert len(places) == len(set(places)) == sum(map(len, want))
    for r in got:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own.tobytes() and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(want[r.doc_id])


@pytest.mark.parametrize("targets", [None, {"s3": 0.02, "big": 0.5}])
def test_two_thousand_small_sources_keep_their_share(spark, targets):
    """A source of half the tokens and 2,000 of a few hundred each: every stretch has both, and the small ones mixed."""
    reach = [(i, "word " * (300 + i % 7), f"s{i % 2_000}") for i in range(4_000)] + [(10_000 + i, "other " * 3_000, "big") for i in range(400)]
    table = spark.createDataFrame(reach, "doc_id long, text string, source string").repartition(8)
    pieces = packing.pack(table, BYTE, 1, targets)
    got = pieces.join(table.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").sum("length").collect()
    total = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r[2]
    assert sum(total.values()) == table.count() + sum(t.count(" ") for _, t, _ in reach) + sum(t.endswith(" ") for _, t, _ in reach)
    windows = sum(total.values()) // 2048
    tenth = {}
    for r in got:
        if r.source != "big":
            tenth.setdefault(r.source, [0] * 10)[min(9, 10 * r.sequence_id // windows)] += r[2]
    if targets is None:  # each small source has its share of each tenth, to within a quantum and a window
        assert all(abs(x - total[s] / 10) <= 2 * packing.QUANTUM for s, held in tenth.items() for x in held)
    else:  # the small source with a target comes first, with 4 % of the windows
        assert tenth["s3"][0] == total["s3"]


def test_nothing_to_pack(docs):
    assert packing.pack(docs([]), BYTE, 1).isEmpty()
    one = packing.pack(docs([None]), BYTE, 1).collect()
    assert [(r.length, r.sequence_id, r.offset) for r in one] == [(1, 0, 0)]
