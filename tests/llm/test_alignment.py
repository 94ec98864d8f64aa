"""Alignment of two tokenizers at shared cuts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.test_tokens import BYTE, ODD
from wavetrail.llm import alignment, tokens
from wavetrail.llm import words as W
from wavetrail.llm.bpe import byte_pieces

PIECE = tokens.public_path("piece_bpe_32k.model")
MORE = ["<s> </s> <unk> <0x41>", "▁ under", "a ▁b", "end  ", "   ", " ", "\n", "x" * 700 + " y", "0123456789" * 30, "😀👍🏽 ≠ ƒ ﬁ", "a" * 5_000,
        "日本" * 400, "    def f(x):\n        return x", "the cat the cat the cat", "é" * 50 + "́", "\t\t a \x00 b"]
TEXTS = ODD + MORE


def brute(texts):
    """The contract read literally: ends as sets, groups by a walk, links one by one."""
    library, model = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    library.encode_special_tokens = True
    of = byte_pieces(BYTE)
    docs = []
    for text in texts:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        own = [of[i] for i in a]
        names = [model.id_to_piece(i) for i in b]
        other = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        if not text or b"".join(own) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in own]).tolist(), np.cumsum([len(x) for x in other]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in both]
        for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
            for i, e in zip(ids, ends):
                groups[next(k for k, c in enumerate(both) if e <= c)][side].append(i)
        docs.append((a, b, groups, Counter((x, y) for p, q in groups for x in p for y in q)))
    held = Counter(pair for d in docs if d for pair in d[3])
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == top[p[0]]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1, 1 << 24])
def test_alignment_equals_the_plain_walk(docs, limit):
    rows = [(5 * i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (None, None), (5, "the cat"), (5, "another text")]
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))]
    got = alignment.aligned(docs(rows).repartition(3), BYTE, PIECE, limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 20 and any(w[1] == 0 and t for w, (_, t) in zip(want, rows))


def test_an_empty_table_and_texts_without_tokens(docs):
    assert alignment.aligned(docs([]), BYTE, PIECE).isEmpty()
    assert [tuple(r) for r in alignment.aligned(docs([None, ""]), BYTE, PIECE).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_divide_and_conquer_finds_every_shared_cut():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 10, 300, 5_000):
        for density in (0.001, 0.3, 1.0):
            end_a, end_b, cut_a, cut_b, total, want = [], [], [0], [0], 0, []
            for _ in range(4):
                n = int(rng.integers(1, size + 1))
                a = np.unique(np.r_[rng.choice(n, max(1, int(n * 0.4)), replace=False) + 1, n])
                b = np.unique(np.r_[a[rng.random(len(a)) < density], rng.choice(n, max(1, int(n * 0.3)), replace=False) + 1, n])
                start_a, start_b = len(end_a), len(end_b)
                shared = np.intersect1d(a, b)
                want += [(start_a + int(np.searchsorted(a, c)) , start_b + int(np.searchsorted(b, c))) for c in np.r_[a[0] * 0, shared[:-1] + 1]]
                end_a += (total + a).tolist()
                end_b += (total + b).tolist()
                total += n
                cut_a.append(len(end_a))
                cut_b.append(len(end_b))
            got = alignment.shared_cuts(*(np.array(x, np.int64) for x in (end_a, end_b, cut_a, cut_b)))
            assert list(zip(*(g.tolist() for g in got))) == want


def test_a_long_text_in_slices_gives_the_same(monkeypatch):
    text = " ".join(t for t in TEXTS if t and "▁" not in t) + " tail " * 50
    data = np.frombuffer((" " + text).encode(), np.uint8)
    counts, digest, key, weight = alignment._long(data, BYTE, PIECE)
    monkeypatch.setattr(W, "CHUNK", 64)
    again = alignment._long(data, BYTE, PIECE)
    assert (counts, digest) == again[:2] and (key == again[2]).all() and (weight == again[3]).all()
    n_a, n_b, n_groups, n_links, *_, sha = brute([text])[0]
    assert (counts, digest) == ([n_a, n_b, n_groups, n_links], sha)
    assert alignment._long(np.frombuffer(b" a \xe2\x96\x81 b", np.uint8), BYTE, PIECE)[:2] == ([0, 0, 0, 0], "")


def test_a_long_group_is_counted_by_its_distinct_ids():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 400)
    zero = np.zeros(1, np.int64)
    key, weight = alignment._pairs(a, b, zero, zero, np.array([300]), np.array([400]), zero, 32_000)
    want = Counter((int(x), int(y)) for x in a for y in b)
    assert {(k // 32_000, k % 32_000): n for k, n in zip(key.tolist(), weight.tolist())} == want
