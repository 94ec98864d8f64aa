"""Katz back-off language model: counted, discounted and evaluated on partitioned tables.

Tokens are the words of a text (lower-cased A-Z, separated by ASCII white space) and one end.
The model has bigrams over all training words and the end; words that training never had share
one further class, seen zero times, so that probabilities sum to one:

    Katz(w | h) = d(r) * r / n(h)          if the pair was seen r > 0 times in training
                = alpha(h) * P(w)          otherwise, P(w) being the smoothed unigram

with Good-Turing discounts d(r) for r up to `DISCOUNTED` and alpha(h) such that the words sum
to one exactly. A history that training never had gives P(w). With `vocabulary_size` the words
below the cut share that class too, inside which each has its smoothed share.

Tables. Words are counted by bucket of their hash. Pairs are sent once, as cells: the distinct
pairs that a part of a batch has in one bucket, with the documents that have them, so a frequent
pair moves once per part. A pair goes to the bucket of its history; a history with more than
`HOT` tokens is dealt out by the following word, and its sums are added up over the buckets.
Each bucket asks the word table for the counts of its words, learns from the cells of the
training documents and answers all cells. No table of words or pairs is broadcast.

Null or empty texts have one token, the end. Held-out rows (and rows without id) are scored but
not learned from. Rows that share a doc_id and a text are each scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.llm import words as W
from wavetrail.llm.common import Scratch, hold_out

DISCOUNTED = 5
REST, END, START = 0, 1, 2  # in the place of word hashes
PAIR, BY_WORD, WORD = 0, 1, 2  # kinds of entries: a pair by history, one of a hot history, a word inside REST
#: Tokens of the corpus for each bucket of a table, about; training tokens of a history that is dealt out by word.
BUCKET_TOKENS, HOT = 3_000_000, 500_000

_KIND = np.ones(256, bool)
_KIND[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a batch, in order."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for first, _, data, offsets in W.text_chunks(texts, lower=False):
        data = _LOWER[data]
        start, end, row = W.word_ranges(data, offsets, _KIND)
        hashes.append(W.range_hashes(W.prefix_hashes(data), start, end))
        rows.append((row + first).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(rows)


#: Bytes of text and rows that are counted or asked for at once.
PART_BYTES, PART_ROWS = 12 << 20, 1 << 14


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of bounded size (a longer text stays whole); column 1 is the text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            limit = (ends[first - 1] if first else 0) + PART_BYTES
            last = max(first + 1, min(int(np.searchsorted(ends, limit, "right")), first + PART_ROWS))
            yield batch.slice(first, last - first)
            first = last


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit hash: its high bits, scaled."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of each run of equal buckets."""
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    for a, b in zip(edge, np.r_[edge[1:], len(bucket)]):
        yield int(bucket[a]), slice(int(a), int(b))


# --- counting ------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        train = ~np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        word, row = tokens(batch.column(1))
        keys, counts = np.unique(word[train[row]], return_counts=True)
        yield _count_rows(_bucket(keys, buckets), keys, counts, "<u8")


def _count_rows(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray, kind: str) -> pa.RecordBatch:
    rows = [(b, keys[s].astype(kind).tobytes(), counts[s].astype("<u4").tobytes()) for b, s in _cuts(bucket)]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "keys", "counts"])


_COUNTS = "bucket int, keys binary, counts binary"


def _merged(group: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Counts of one bucket over all batches: distinct keys in order."""
    keys = np.concatenate([np.frombuffer(k, kind) for k in group["keys"]])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in group["counts"]]).astype(np.int64)
    distinct, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, counts, len(distinct)).astype("<i8")
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "keys": [distinct.tobytes()], "counts": [total.tobytes()]})


@dataclass
class Totals:
    """Counts of the corpus, the hot histories, and the words with a class of their own (None: all)."""

    train_docs: int
    total: int  # N: training tokens, ends included
    types: int  # V: distinct training tokens, the end included
    hot: np.ndarray  # sorted
    own: np.ndarray | None  # sorted
    rest_total: int
    rest_types: int
    classes: int  # with the end and REST

    def class_of(self, word: np.ndarray) -> np.ndarray:
        return word if self.own is None else np.where(_place(self.own, word)[1], word, np.uint64(REST))

    def counts(self, word: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Training count of each word, end or class; `known` has the words that were asked for."""
        at, good = _place(known[0], word)
        out = np.zeros(len(word), np.int64)
        out[good] = known[1][at[good]]
        out[word == END] = self.train_docs
        out[word == REST] = self.rest_total
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(class), smoothed by 0.1 per class."""
        return (count + 0.1) / (self.total + 0.1 * self.classes)

    def log_in_rest(self, count: np.ndarray) -> np.ndarray:
        """log10 P(word | REST), one share being kept for words never seen."""
        return np.log10((count + 0.1) / (self.rest_total + 0.1 * (self.rest_types + 1)))


def _place(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key in sorted `have`, and whether it is there."""
    if not len(have):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def discounts(n: list[int], k: int = DISCOUNTED) -> list[float]:
    """Good-Turing discount ratios d(1..k) from n[r], the number of pairs seen r times (r up to k + 1).

    Katz's formula where it gives a ratio in (0, 1); 1 - 1/(2r) where counts are too few for it.
    """
    out = []
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


# --- cells ---------------------------------------------------------------------------------


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    kinds, held, size = {"doc_id": pa.int64(), "text": pa.string(), "held": pa.bool_()}, [], 0
    for row in rows:
        if held and (len(held) == PART_ROWS or size + len(row[1]) > PART_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], [*kinds])
            held, size = [], 0
        held.append(tuple(row))
        size += len(row[1])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], [*kinds])


def _entries(word: np.ndarray, row: np.ndarray, rows: np.ndarray, totals: Totals) -> tuple[np.ndarray, ...]:
    """Distinct (lead, kind, tail, row) of the tokens of `rows`, by lead: hashes, kind, row and times."""
    cls = totals.class_of(word)
    of = np.concatenate([row, rows.astype(row.dtype)])
    order = np.argsort(of, kind="stable")
    after, of = np.concatenate([cls, np.full(len(rows), END, np.uint64)])[order], of[order]
    inside = cls == REST
    names, local = np.unique(np.concatenate([after, word[inside], np.array([REST, START], np.uint64)]), return_inverse=True)
    del order, cls
    local = local.astype(np.uint32)
    after, other = local[: len(of)], local[len(of) : -2]
    before = np.r_[local[-1:], after[:-1]]
    before[np.r_[True, of[1:] != of[:-1]]] = local[-1]
    hot = _place(totals.hot, names)[1][before]
    lead = np.concatenate([np.where(hot, after, before), other])
    tail = np.concatenate([np.where(hot, before, after), np.full(len(other), local[-2])])
    kind = np.concatenate([np.where(hot, BY_WORD, PAIR), np.full(len(other), WORD)]).astype(np.uint8)
    of = np.concatenate([of, row[inside]])
    # one number to sort: ids of names twice, two bits of kind, the row; a long text is alone in its part
    wide, low = np.uint64(max(1, len(names).bit_length())), np.uint64(int(rows.max(initial=0)).bit_length())
    code = lead.astype(np.uint64)
    for shift, more in ((np.uint64(2), kind), (wide, tail), (low, of)):
        code <<= shift
        code |= more.astype(np.uint64)
    del local, after, before, hot, lead, tail, kind, of
    code.sort()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    times = np.diff(np.r_[first, len(code)])
    code = code[first]
    of, code = code & ((np.uint64(1) << low) - np.uint64(1)), code >> low
    tail, code = code & ((np.uint64(1) << wide) - np.uint64(1)), code >> wide
    return names[code >> np.uint64(2)], (code & np.uint64(3)).astype(np.uint8), names[tail], of.astype(np.uint32), times


def _cells(split: int, docs: Iterator[tuple], totals, buckets: int) -> Iterator[tuple[int, tuple]]:
    """(bucket, cell): distinct entries of a part with the rows that have them; one more cell names the part's documents.

    A cell is the part, whether it is of held-out documents (None: of names), and its arrays.
    """
    number = split << 32
    for batch in _batches(docs):
        number += 1
        held = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        word, row = tokens(batch.column(1))
        n_tokens = np.bincount(row, minlength=batch.num_rows) + 1
        doc = batch.column(0)
        yield number % buckets, (number, None, doc.fill_null(0).to_numpy().astype("<i8").tobytes(), np.asarray(doc.is_null()).astype("u1").tobytes(), held.astype("u1").tobytes(), n_tokens.astype("<u4").tobytes())
        for side in (False, True):
            rows = np.flatnonzero(held == side)
            if not len(rows):
                continue
            mine = held[row] == side
            lead, kind, tail, of, times = _entries(word[mine], row[mine], rows, totals.value)
            for b, s in _cuts(_bucket(lead, buckets)):
                new = np.r_[True, (lead[s][1:] != lead[s][:-1]) | (kind[s][1:] != kind[s][:-1])]
                head = np.flatnonzero(np.r_[True, new[1:] | (tail[s][1:] != tail[s][:-1])])
                leads = np.flatnonzero(new[head])
                yield b, (number, side, lead[s][head[leads]].tobytes(), kind[s][head[leads]].tobytes(), np.diff(np.r_[leads, len(head)]).astype("<u4").tobytes(),
                          tail[s][head].tobytes(), np.diff(np.r_[head, s.stop - s.start]).astype("<u4").tobytes(), of[s].astype("<u2").tobytes(), times[s].astype("<u4").tobytes())


def _opened(cell: tuple) -> tuple[np.ndarray, ...]:
    """History, word (or class), whether it is a word inside REST, runs, rows and times of a cell's entries."""
    leads, kinds, spans, tails, runs, docs, times = (np.frombuffer(x, t) for x, t in zip(cell[2:], ("<u8", "u1", "<u4", "<u8", "<u4", "<u2", "<u4")))
    lead, kind, runs = np.repeat(leads, spans), np.repeat(kinds, spans), runs.astype(np.int64)
    swap = kind == BY_WORD
    return np.where(swap, tails, lead), np.where(swap | (kind == WORD), lead, tails), kind == WORD, runs, docs, times


def _pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(history + W.mix(word + np.uint64(1)))


def _learned(cells: list[tuple]) -> tuple[np.ndarray, ...]:
    """Distinct training pairs of a bucket by key: key, history, word, count."""
    found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for cell in cells:
        if cell[1] is False:
            h, w, inside, runs, _, times = _opened(cell)
            n = np.add.reduceat(times.astype(np.int64), np.cumsum(runs) - runs)
            for store, x in zip(found, (h[~inside], w[~inside], n[~inside])):
                store.append(x)
    h, w, n = (np.concatenate(f) for f in found)
    key = _pair_key(h, w)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    n = np.add.reduceat(n[order], first) if len(first) else n
    return key[first], h[order[first]], w[order[first]], n


def _by_bucket(rows: Iterator[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    groups: dict[int, list[tuple]] = {}
    for bucket, row in rows:
        groups.setdefault(bucket, []).append(row)
    while groups:
        yield groups.popitem()


# --- counts of words for the buckets of pairs ----------------------------------------------


def _wanted(rows: Iterator[tuple], buckets: int) -> Iterator[tuple]:
    """(bucket of words, (bucket that asks, words)), and (bucket, (None, pairs seen 1, 2, ... times))."""
    for bucket, cells in _by_bucket(rows):
        n = _learned(cells)[3]
        yield bucket, (None, np.bincount(n[n <= DISCOUNTED + 1], minlength=DISCOUNTED + 2).tolist())
        some = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(_opened(c)[1]) for c in cells if c[1] is not None)]))
        some = some[some > START]
        for b, s in _cuts(_bucket(some, buckets)):
            yield b, (bucket, some[s].tobytes())


def _told(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(bucket that asks, (None, words, counts))."""
    for _, group in _by_bucket(rows):
        have = next(((np.frombuffer(r[1], "<u8"), np.frombuffer(r[2], "<i8")) for r in group if r[0] == "words"), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        for r in group:
            if r[0] not in ("words", None):
                at, good = _place(have[0], np.frombuffer(r[1], "<u8"))
                count = np.zeros(len(at), "<i8")
                count[good] = have[1][at[good]]
                yield r[0], ("told", r[1], count.tobytes())


def _split(group: list[tuple]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
    """Cells of a bucket, and the words it asked for with their counts."""
    told = [r for r in group if r[0] == "told"]
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[1], "<u8") for r in told)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[2], "<i8") for r in told)])
    order = np.argsort(keys)
    return [r for r in group if r[0] != "told"], (keys[order], counts[order])


# --- evaluation ----------------------------------------------------------------------------


def _scales(n: np.ndarray, ratio: list[float]) -> np.ndarray:
    return np.r_[0.0, np.array(ratio), 1.0][np.minimum(n, len(ratio) + 1)]


def _hot_sums(rows: Iterator[tuple], totals, ratio: list[float]) -> Iterator[tuple]:
    """(hot history, [tokens, discounted tokens, unigram of the words seen after it]) of each bucket."""
    t = totals.value
    for _, group in _by_bucket(rows):
        cells, known = _split(group)
        _, h, w, n = _learned(cells)
        at, good = _place(t.hot, h)
        at, w, n = at[good], w[good], n[good]
        sums = [np.bincount(at, x, len(t.hot)) for x in (n, _scales(n, ratio) * n, t.unigram(t.counts(w, known)))]
        yield from ((int(t.hot[i]), np.array([s[i] for s in sums])) for i in np.flatnonzero(sums[0]))


def katz_part(h: np.ndarray, n: np.ndarray, base: np.ndarray, ratio: list[float], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each seen pair; sorted histories and log10 of their back-off weights.

    `base` is the unigram of each pair's word; `hot` has the histories whose sums span buckets.
    """
    history, which = np.unique(np.concatenate([h, hot[0]]), return_inverse=True)
    which = which[: len(h)]
    total, scaled, below = (np.bincount(which, x, len(history)) for x in (n, _scales(n, ratio) * n, base))
    at, good = _place(hot[0], history)
    for k, x in enumerate((total, scaled, below)):
        x[good] = hot[1][at[good], k]
    p, seen, left = _scales(n, ratio) * n / total[which], scaled / total, 1 - below
    closed = left < 1e-9  # every word was seen: nothing to back off to
    p = p / np.where(closed, seen, 1.0)[which]
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.log10(np.where(closed, 1e-300, (1 - np.where(closed, 0.0, seen)) / np.where(closed, 1.0, left)))
    # without any discounted pair a history has nothing left: its pairs are scaled to make room
    full = ~closed & (1 - seen < 1e-12)
    if full.any():
        room = 1 / (total + 1)
        p = np.where(full[which], p * (1 - room[which]), p)
        alpha[full] = np.log10(room[full] / left[full])
    return np.log10(p), history, alpha


_TOLD = "part long, held boolean, docs binary, sums binary, tokens binary"


def _answers(rows: Iterator[tuple], totals, ratio: list[float], hot) -> Iterator[tuple]:
    """Sums of score, base and known words per row of each part that asks; rows that name documents pass."""
    t = totals.value
    for _, group in _by_bucket(rows):
        cells, known = _split(group)
        key, h, w, n = _learned(cells)
        p, history, alpha = katz_part(h, n, t.unigram(t.counts(w, known)), ratio, hot.value)
        for cell in cells:
            if cell[1] is None:
                yield cell[0], None, bytes(cell[2]), bytes(cell[3]) + bytes(cell[4]), bytes(cell[5])
                continue
            h, w, inside, runs, docs, times = _opened(cell)
            count = t.counts(w, known)
            at, seen = _place(key, _pair_key(h, w))
            back, some = _place(history, h)
            score = np.log10(t.unigram(count))
            score[some] += alpha[back[some]] if len(alpha) else 0
            score[seen] = p[at[seen]]
            score[inside] = t.log_in_rest(count[inside])
            base = np.where(w == REST, 0.0, np.log10(count + 0.1))
            local, which = np.unique(docs, return_inverse=True)
            values = (score, base, ((count > 0) & (w != REST)).astype(float))[: 2 + cell[1]]
            sums = np.stack([np.bincount(which, times * np.repeat(v, runs), len(local)) for v in values])
            yield cell[0], cell[1], local.astype("<u2").tobytes(), sums.astype("<f8").tobytes(), None


_SUMS = "doc_id long, held_out boolean, base double, score double, n_known long, n_tokens long"


def _gathered(group: pd.DataFrame) -> pd.DataFrame:
    """Sums per document over all buckets that a part of a batch asked: at most `PART_ROWS` documents."""
    named = group["held"].isna().to_numpy()
    row = group[named].iloc[0]
    ids, n_tokens = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["tokens"], "<u4").astype(np.int64)
    missing, held = np.frombuffer(row["sums"], "u1").reshape(2, -1).astype(bool)
    score, base, known = np.zeros((3, len(ids)))
    for side, docs, sums in zip(*(group.loc[~named, c] for c in ("held", "docs", "sums"))):
        at = np.frombuffer(docs, "<u2")
        for total, x in zip((score, base, known), np.frombuffer(sums, "<f8").reshape(2 + bool(side), -1)):
            total[at] += x
    doc = pd.Series(ids, dtype="Int64").mask(pd.Series(missing))
    # every token of a training document is known
    return pd.DataFrame({"doc_id": doc, "held_out": held, "base": base, "score": score, "n_known": np.where(held, known.round().astype(np.int64), n_tokens), "n_tokens": n_tokens})


def _spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words with each count."""
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            values, n = np.unique(np.frombuffer(blob, "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["count", "n"])


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            key, count = np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(key[count >= least]), pa.array(count[count >= least])], ["key", "count"])


def score(docs: DataFrame, modulus: int = 10, vocabulary_size: int | None = None, hot_tokens: int = HOT) -> DataFrame:
    """Per document: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("held", hold_out(modulus))
    size = texts.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held")).cast("long"))).first()
    buckets = min(max(8, math.ceil((size[0] or 0) / 6 / BUCKET_TOKENS)), 1 << 18)
    train_docs = size[1] or 0

    counted = texts.mapInArrow(lambda it: _word_counts(it, buckets), _COUNTS).groupBy("bucket").applyInPandas(lambda g: _merged(g, "<u8"), _COUNTS)
    words = scratch.put(counted, "words")
    spectrum = words.mapInArrow(_spectrum, "count long, n long").groupBy("count").agg(F.sum("n").alias("n"))
    sums = spectrum.agg(F.sum("n"), F.sum(F.col("count") * F.col("n"))).first()
    types, tokens_in = sums[0] or 0, sums[1] or 0
    frequent = lambda least: words.mapInArrow(lambda it: _frequent(it, least), "key long, count long").collect()
    hashes = lambda rows: np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    hot = np.r_[np.array([REST, START] if train_docs >= hot_tokens or vocabulary_size else [], np.uint64), hashes(frequent(hot_tokens))]
    own, kept, kept_tokens = None, types, tokens_in
    if vocabulary_size is not None:
        least, kept = 1 << 62, 0
        for r in spectrum.orderBy(F.desc("count")).limit(vocabulary_size).collect():  # the smallest count of which all words fit the vocabulary
            if kept + r["n"] > vocabulary_size:
                break
            kept, least = kept + r["n"], r["count"]
        rows = frequent(least)
        own, kept_tokens = hashes(rows), sum(r["count"] for r in rows)
    voc = Totals(train_docs, tokens_in + train_docs, types + (train_docs > 0), hot, own, tokens_in - kept_tokens, types - kept, kept + 2)
    totals = spark.sparkContext.broadcast(voc)

    # tables that meet by bucket are dealt out by the same rule, so that each is sent once for all steps
    dealt = lambda rows: rows.partitionBy(buckets, int)
    cells = dealt(texts.rdd.mapPartitionsWithIndex(lambda k, it: _cells(k, it, totals, buckets)))
    wanted = dealt(cells.mapPartitions(lambda it: _wanted(it, buckets)))
    shape = np.sum([[0] * (DISCOUNTED + 2), *wanted.filter(lambda r: r[1][0] is None).map(lambda r: r[1][1]).collect()], axis=0).tolist()
    ratio = discounts(shape)
    told = dealt(dealt(words.rdd.map(lambda r: (r[0], ("words", r[1], r[2])))).union(wanted).mapPartitions(_told))
    met = told.union(cells)
    sums = sorted(met.mapPartitions(lambda it: _hot_sums(it, totals, ratio)).reduceByKey(lambda a, b: a + b).collect()) if len(hot) else []
    hot_sums = spark.sparkContext.broadcast((np.array([k for k, _ in sums], np.uint64), np.array([x for _, x in sums]).reshape(-1, 3)))
    answers = spark.createDataFrame(met.mapPartitions(lambda it: _answers(it, totals, ratio, hot_sums)), _TOLD, verifySchema=False)
    out = answers.groupBy("part").applyInPandas(_gathered, _SUMS)
    norm = math.log10(voc.total + 0.1 * (voc.types + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(voc.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
