"""Exact copies, near copies, repeated strings and benchmark passages."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from wavetrail.llm import decontaminate, exact_dedup, ngram_join, suffix_dedup
from wavetrail.llm import words as W
from wavetrail.llm.common import Scratch


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("broadcast_words", [0, 1 << 20])
def test_exact_copies(docs, broadcast_words):
    texts = ["a", "b", "a", None, "", "A", "a ", (9, "a"), (9, "a"), (None, "b"), "x" * 200_000]
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    table = docs(texts)
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in pairs:
        ids = [x for x in groups[t or ""] if x is not None]
        want.append((i, max(ids) if ids else None, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    got = exact_dedup.copy_report(table, broadcast_words).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_copies(table, broadcast_words)
    assert left.columns == table.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert {r.doc_id for r in left.collect() if r.text == "a"} == {9}


def test_near_copies_equal_all_pairs(docs):
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [None, "", "   ", "one two", "One, two!", "one two three"]
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), base[0] + " tail", "word " * 5_000]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_classes(docs(texts)).collect()}
    want = dict(enumerate(brute.near_classes(texts)))
    assert got == want
    blocks = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_classes(docs(texts), block=3).collect()}
    assert blocks == want
    kept = ngram_join.drop_near_copies(docs(texts))
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()}
    assert kept.columns == docs([]).columns


def test_repeated_rows_are_copies_of_each_other(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = ngram_join.near_classes(docs(rows)).collect()
    assert [(r.class_id, r.n_links, r.n_copies) for r in got] == [(1, 3, 4)] * 4


def test_near_copies_with_shared_and_missing_ids(docs):
    rng = random.Random(9)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (5, a + " tail"), (5, b), (None, a), (None, c), (None, c + " end"), (7, b), (7, b), (8, ""), (8, ""), (None, None), (2, "one two"), (2, "one two")]
    table = docs(rows).withColumnsRenamed({"digest": "row", "score": "key", "kept": "stays"})
    left = ngram_join.drop_near_copies(table)
    assert left.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    want = [(1, a), (5, b), (8, ""), (8, ""), (None, None), (2, "one two")]
    loose = [g for g in got if g not in want]
    assert [g for g in got if g in want] == sorted(want, key=str) and len(loose) == 1 and loose[0] in [(None, c), (None, c + " end")]
    assert all(tuple(r)[2:] == ("en", "s", 0, 1, "x", 0.5, True) for r in left.collect())


def test_exact_copies_leave_the_callers_columns_alone(docs):
    table = docs([(1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "c"), (None, "c")]).withColumnsRenamed({"score": "row", "source": "word", "lang": "mask"})
    got = sorted((tuple(r) for r in exact_dedup.drop_copies(table).collect()), key=str)
    assert got == sorted([(i, t, "en", "s", 0, 1, "x", 0.5, True) for i, t in ((2, "a"), (3, "b"), (None, "c"))], key=str)


def test_repeats_with_shared_and_missing_ids(docs):
    rng = random.Random(11)
    s, t, u = (prose(rng, 40) for _ in range(3))
    rows = [(None, s + " a"), (None, "b " + s + " c"), (None, prose(rng, 40)), (7, t), (7, u + " y " + t), (3, u), (3, u), (9, t), (7, None)]
    order = sorted({(i is not None, i or 0, hashlib.sha256((x or "").encode()).hexdigest(), x or "") for i, x in rows})
    result = brute.removal({k: key[3] for k, key in enumerate(order)})
    of = {key[:3]: result[k] for k, key in enumerate(order)}
    want = sorted((str(i), *of[(i is not None, i or 0, hashlib.sha256((x or "").encode()).hexdigest())]) for i, x in rows)
    got = suffix_dedup.removal_report(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 300


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_column_wise_order_equals_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"\1\2\3") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 7))]
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16)
        owner, offset, common = suffix_dedup.column_wise(flat, np.array([len(p) for p in pieces]))
        suffixes = [pieces[o][f:] for o, f in zip(owner, offset)]
        assert suffixes == sorted(suffixes)
        for a, b, c in zip(suffixes, suffixes[1:], common[1:]):
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert c == shared


@pytest.mark.parametrize("crowd", [400, 2])
def test_repeated_strings(docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(5)
    shared, other = prose(rng, 60), "é" * 80 + prose(rng, 30)
    texts = [None, "", "short", "ab" * 300, "z" * 99, "z" * 100, "z" * 101, shared, prose(rng, 20) + shared, other + shared[:150],
             shared + other + shared, other, prose(rng, 3_000), "ü" + shared[3:], (99, shared), (98, "the end " * 40)]
    pairs = dict(t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(docs(texts)).collect()}
    assert got == brute.removal(pairs)


def test_windows_of_a_crowded_anchor_do_not_meet_in_one_collection(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 20)
    rng, met = random.Random(8), []
    passage = prose(rng, 60)
    texts = [prose(rng, 30) + passage + prose(rng, 30) for _ in range(60)]
    put = Scratch.put

    def watched(self, df, part):
        out = put(self, df, part)
        if part == "pieces":
            met.extend(r.crowd for r in out.where("not again").collect())
        return out

    monkeypatch.setattr(Scratch, "put", watched)
    table = docs(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(table).collect()}
    assert got == brute.removal(dict(enumerate(texts)))
    assert max(met, default=0) <= 20


def test_benchmark_items_inside_long_documents(docs, spark, monkeypatch):
    rng = random.Random(7)
    items = {i: prose(rng, n) for i, n in enumerate((3, 5, 6, 9, 20, 33, 70, 300))} | {90: None, 91: "", 92: "??"}
    items[93] = items[4]
    texts = [None, "", "...", prose(rng, 50)]
    for i in range(8):
        texts.append(prose(rng, 400) + " " + items[i].upper() + ". " + prose(rng, 900))
        w = items[i].split()
        texts.append(prose(rng, 40) + " " + " ".join(w[: len(w) // 2]) + " " + prose(rng, 40))
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute.contained(dict(enumerate(texts)), items)
    for limit in (2_000_000, 300):  # one slice of items, then several
        got = decontaminate.contained_items(docs(texts), table, limit=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.shared) for r in got) == sorted(want)
    left = decontaminate.drop_contaminated(docs(texts), table)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert left.columns == docs([]).columns
    kept = [i for i, t in items.items() if brute.shingles(t)]
    index = decontaminate.Index(kept, W.sets([items[i] for i in kept]), 0.8)
    for size in (16, 64, 256):  # long texts in slices; the large items above a slice
        monkeypatch.setattr(decontaminate, "SLICE", size)
        got = [(r, kept[i], shared) for r, i, shared, _ in index.matches(pa.array(texts, pa.string()))]
        assert sorted(got) == sorted(want)


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(3)
    text = " ".join(prose(rng, 300) + "日本" * rng.randrange(50) for _ in range(5))
    want = W.sets([text])[0]
    monkeypatch.setattr(W, "CHUNK", 64)
    assert (W.sets([text])[0] == want).all()


def test_empty_tables(docs, spark):
    none, items = docs([]), spark.createDataFrame([], "item_id long, text string")
    for out in (exact_dedup.copy_report(none), exact_dedup.drop_copies(none), ngram_join.near_classes(none), ngram_join.drop_near_copies(none),
                suffix_dedup.removal_report(none), decontaminate.contained_items(none, items), decontaminate.drop_contaminated(none, items)):
        assert out.isEmpty()
    assert decontaminate.drop_contaminated(docs(["a"]), items).count() == 1
