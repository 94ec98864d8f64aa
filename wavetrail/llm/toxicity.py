"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Tokens are words (see `words`), their features the word and its prefixes of 3 to 7 bytes. Two
states, clean and toxic; the field has a weight per feature, a bias and a 2 x 2 transition
matrix. Labels exist per document, so tokens are labelled first: in documents marked toxic, a
token is toxic if one of its features is far more frequent in toxic than in clean documents.
The field is fitted to those labels by its likelihood; forward-backward marginals of a text give
toxic spans (marginal of 1/2 or more), and sums over marginals give the document's score
through a logistic function fitted to the document labels.

Fitted on a bounded sample: about `SAMPLE` labelled training documents per class (small hash of
their id, twice as many at most), copies of a text counted once, `LEXICON` features, `WINDOWS` windows around tokens
with such a feature. Scoring reads every whole text, in one pass without a shuffle.

Null or empty texts get the score of a text without a toxic token. Labels that are null are not
used, of repeated labels the larger one counts. Without labels of both classes, scores are the
smoothed share of toxic documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetrail.llm import words as W
from wavetrail.llm.common import bounded_sample, hold_out

SAMPLE, LEXICON, WINDOWS, REACH = 3_000, 20_000, 4_000, 8
PREFIXES = (3, 4, 5, 6, 7)
SEGMENT = 256
#: Bound of (m00 + m11 - m01 - m10) / 2: a state is then forgotten within about 110 tokens (`burn_in`).
PULL = 2.0


@dataclass
class Field:
    """keys: sorted feature hashes; weights; bias; move[i, j]: score of state i before state j; head: calibration."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float = -4.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: np.ndarray = field(default_factory=lambda: np.zeros(4))
    marks: np.ndarray = field(default_factory=lambda: np.zeros(1 << 22, bool))

    def mark(self) -> Field:
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        return self

    def places(self, feature: np.ndarray) -> np.ndarray:
        """Index of each feature in `keys`, -1 where it is none."""
        out = np.full(len(feature), -1, np.int64)
        maybe = np.flatnonzero(self.marks[(feature >> np.uint64(42)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, feature[maybe]), len(self.keys) - 1)
            good = self.keys[at] == feature[maybe]
            out[maybe[good]] = at[good]
        return out


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, end and row of each token, and its features (0: token shorter than the prefix)."""
    start, end, row = W.word_ranges(data, offsets)
    prefix = W.prefix_hashes(data)
    out = [W.range_hashes(prefix, start, end)]
    for k in PREFIXES:
        long = end - start >= k
        part = np.zeros(len(start), np.uint64)
        part[long] = W.mix(W.range_hashes(prefix, start[long], start[long] + k) + np.uint64(k))
        out.append(part)
    return start, end, row, out


# --- the chain -----------------------------------------------------------------------------


def _step(ratio: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log-odds of the next state from log-odds of this one."""
    return np.logaddexp(ratio + m[1, 1], m[0, 1]) - np.logaddexp(ratio + m[1, 0], m[0, 0])


def messages(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (own emission included) and backward log-odds along axis 0; every column is a chain."""
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    ahead[0] = emit[0]
    for t in range(1, len(emit)):
        ahead[t] = emit[t] + _step(ahead[t - 1], move)
    back[-1] = 0
    for t in range(len(emit) - 2, -1, -1):
        back[t] = _step(back[t + 1] + emit[t + 1], move.T)
    return ahead, back


def burn_in(move: np.ndarray) -> int:
    """Tokens after which a chain has forgotten its start to within 1e-12 (Birkhoff's contraction)."""
    a, b = math.exp((move[0, 0] + move[1, 1]) / 2), math.exp((move[0, 1] + move[1, 0]) / 2)
    c = abs(a - b) / (a + b)
    return 1 if c < 1e-12 else min(4096, math.ceil(math.log(1e-13) / math.log(c)) + 1)


def marginals(emit: np.ndarray, row: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of many concatenated chains.

    Chains are cut into segments that overlap by the burn-in on both sides, so that all
    segments advance together; the cut changes a marginal by less than 1e-12.
    """
    n = len(emit)
    if not n:
        return np.zeros(0)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[first, n])
    pieces = -(-length // SEGMENT)
    seg_doc = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(seg_doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    core = first[seg_doc] + nth * SEGMENT
    lo, hi = first[seg_doc], (first + length)[seg_doc]
    reach = burn_in(move)
    grid = core[None, :] - reach + np.arange(SEGMENT + 2 * reach)[:, None]
    inside = (grid >= lo) & (grid < hi)
    e = np.where(inside, emit[np.clip(grid, 0, n - 1)], 0.0)
    ahead, back = np.empty_like(e), np.empty_like(e)
    now = e[0]
    ahead[0] = now
    for t in range(1, len(e)):  # outside a chain nothing moves; its first token has no state before it
        now = e[t] + np.where(inside[t - 1], _step(now, move), 0.0)
        ahead[t] = now
    now = np.zeros(e.shape[1])
    back[-1] = now
    for t in range(len(e) - 2, -1, -1):
        now = np.where(inside[t + 1], _step(now + e[t + 1], move.T), 0.0)
        back[t] = now
    keep = slice(reach, reach + SEGMENT)
    own = inside[keep]
    p = np.zeros(n)
    p[grid[keep][own]] = 1 / (1 + np.exp(-(ahead[keep] + back[keep])[own]))
    return p


def fit_chain(feature: list[np.ndarray], label: np.ndarray, size: int, rounds: int = 120) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and moves by gradient ascent (Adam) on the penalised log-likelihood of the windows.

    feature: arrays (time, windows) of places in the lexicon, -1 for none; label: the same shape.
    Each round sees a random half of the kinds of feature, so that a stem alone can tell.
    """
    rng = np.random.default_rng(0)
    weights, bias, move = np.zeros(size), -2.0, np.zeros((2, 2))
    state = [np.zeros(size + 5), np.zeros(size + 5)]
    n = label.size
    pair = np.array([[np.sum((label[:-1] == i) & (label[1:] == j)) for j in (0, 1)] for i in (0, 1)], float)
    for step in range(1, rounds + 1):
        emit = np.full(label.shape, bias)
        seen = [f for f, keep in zip(feature, rng.random(len(feature)) < 0.5) if keep] or feature
        for f in seen:
            emit += np.where(f >= 0, weights[f], 0.0)
        ahead, back = messages(emit, move)
        p = 1 / (1 + np.exp(-(ahead + back)))
        joint = np.stack([np.stack([(i * ahead[:-1]) + move[i, j] + j * (emit[1:] + back[1:]) for j in (0, 1)]) for i in (0, 1)])
        joint = np.exp(joint - joint.max((0, 1)))
        joint /= joint.sum((0, 1))
        slope = label - p
        grad = np.zeros(size + 5)
        for f in seen:
            grad[:size] += np.bincount(f[f >= 0], slope[f >= 0], size)
        grad[size] = slope.sum()
        grad[size + 1 :] = (pair - joint.sum((2, 3))).ravel()
        grad = grad / n * 1000 - 0.02 * np.r_[weights, 0.0, move.ravel()]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        change = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
        weights, bias = weights + change[:size], bias + change[size]
        move = np.clip(move + change[size + 1 :].reshape(2, 2), -4, 4)
        pull = abs(move[0, 0] + move[1, 1] - move[0, 1] - move[1, 0]) / 2
        move = move * min(1.0, PULL / max(pull, 1e-9))
    return weights, float(bias), move


def fit_head(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small penalty, by Newton's method; x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.1 * w)
    return w


# --- fitting on the sample -----------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, modulus: int, size: int) -> DataFrame:
    """`text`, `toxic` of about `size` training documents per class (twice as many at most), each text once."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~hold_out(modulus))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [bounded_sample(known.where(F.col("toxic") == y), ("doc_id",), size, totals.get(y, 0)) for y in (0, 1)]
    picked = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("__id"), "toxic")
    texts = docs.select(docs["doc_id"].cast("long").alias("__doc"), docs["text"].cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).where("text is not null")  # at most 4 x size rows
    return joined.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: feature, toxic and clean documents that have it."""
    for batch in batches:
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        for first, last, data, offsets in W.text_chunks(batch.column(0)):
            _, _, row, feats = token_features(data, offsets)
            one = np.concatenate(feats)
            own = np.tile(row, len(feats))
            pairs = np.unique(np.stack([one[one > 0], own[one > 0].astype(np.uint64)], 1), axis=0)
            y = toxic[first + pairs[:, 1].astype(np.int64)]
            keys, which = np.unique(pairs[:, 0], return_inverse=True)
            a = np.bincount(which, y, len(keys)).astype(np.int64)
            b = np.bincount(which, 1 - y, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), pa.array(b)], ["feature", "a", "b"])


def _hits(batches: Iterator[pa.RecordBatch], model: Field) -> Iterator[pa.RecordBatch]:
    """Per document: label, number of tokens, places of tokens with a known feature and those features."""
    for batch in batches:
        toxic = batch.column(1).to_pylist()
        for first, last, data, offsets in W.text_chunks(batch.column(0)):
            start, _, row, feats = token_features(data, offsets)
            found = np.stack([model.places(f) for f in feats], 1) if len(start) else np.zeros((0, 6), np.int64)
            hit = np.flatnonzero((found >= 0).any(1))
            begin = np.searchsorted(row, np.arange(last - first + 1))
            rows = []
            for i in range(last - first):
                mine = hit[np.searchsorted(hit, begin[i]) : np.searchsorted(hit, begin[i + 1])]
                rows.append((toxic[first + i], int(begin[i + 1] - begin[i]), (mine - begin[i]).tolist(), found[mine].ravel().tolist()))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["toxic", "n", "at", "feats"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> Field:
    """The field, its lexicon and its calibration from labelled training documents."""
    rows = labelled_sample(docs, labels, modulus, sample).persist()
    try:
        n = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        prior = math.log((n[1] + 0.5) / (n[0] + 0.5))
        if not n[0] or not n[1]:
            return Field(np.zeros(0, np.uint64), np.zeros(0), head=np.array([min(prior, -1e-6) if not n[1] else prior, 0.0, 0.0, 0.0])).mark()
        counted = rows.select("text", "toxic").mapInArrow(_counted, "feature long, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        odds = F.log(((F.col("a") + 0.5) / (n[1] + 1)) / ((F.col("b") + 0.5) / (n[0] + 1)))
        best = counted.where("a >= 3").withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.col("odds") * F.log(F.col("a") + 1)), "feature").limit(LEXICON).collect()
        keys = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
        order = np.argsort(keys)
        strong = np.array([r["odds"] >= 2.5 and r["a"] >= 0.01 * n[1] for r in best], bool)[order]
        model = Field(keys[order], np.zeros(len(keys))).mark()
        bare = Field(model.keys, model.weights, marks=model.marks)
        found = rows.select("text", "toxic").mapInArrow(lambda it: _hits(it, bare), "toxic int, n long, at array<long>, feats array<long>").collect()
    finally:
        rows.unpersist()
    width = 2 * REACH + 1
    feature, label = [], []
    docs_hit = []
    for r in sorted(found, key=lambda r: (r["n"], r["at"])):
        at, feats = np.array(r["at"], np.int64), np.array(r["feats"], np.int64).reshape(-1, 1 + len(PREFIXES))
        hot = ((feats >= 0) & strong[feats]).any(1) & (r["toxic"] == 1)
        docs_hit.append((r["toxic"], r["n"], at, feats))
        last = -width
        for c in at.tolist():
            if c - last >= width:
                near = (at >= c - REACH) & (at <= c + REACH)
                f, y = np.full((width, 1 + len(PREFIXES)), -1, np.int64), np.zeros(width, np.int64)
                f[at[near] - c + REACH], y[at[near] - c + REACH] = feats[near], hot[near]
                feature.append(f)
                label.append(y)
                last = c
    if not feature:
        return Field(np.zeros(0, np.uint64), np.zeros(0), head=np.array([prior, 0.0, 0.0, 0.0])).mark()
    take = np.unique(np.linspace(0, len(feature) - 1, WINDOWS).astype(int))
    cube, y = np.stack([feature[i] for i in take], 1), np.stack([label[i] for i in take], 1)
    weights, bias, move = fit_chain([cube[:, :, k] for k in range(cube.shape[2])], y, len(model.keys))
    model.weights, model.bias, model.move = weights, bias, move
    x, label = [], []
    for toxic, length, at, feats in docs_hit:
        x.append(_summary(_hit_marginals(at, np.where(feats >= 0, weights[feats], 0).sum(1), length, bias, move), length))
        label.append(toxic)
    model.head = fit_head(np.array(x), np.array(label, float))
    return model


def _hit_marginals(at: np.ndarray, gain: np.ndarray, length: int, bias: float, move: np.ndarray) -> np.ndarray:
    """Marginals of the tokens `at` of a text whose other tokens have no known feature.

    Only stretches of `burn_in` tokens on both sides of each hit are computed, wherever in the text they are.
    """
    if not len(at):
        return np.zeros(0)
    reach = burn_in(move)
    place = np.unique(np.clip(at[:, None] + np.arange(-reach, reach + 1), 0, length - 1))
    emit, own = np.full(len(place), bias), np.searchsorted(place, at)
    emit[own] += gain
    return marginals(emit, np.cumsum(np.r_[0, np.diff(place) > 1]), move)[own]


def _summary(p: np.ndarray, tokens: int) -> list[float]:
    """Largest marginal, log of the toxic tokens, and log of their density in the text."""
    if not len(p):
        return _CLEAN
    total = float(p[p >= 0.5].sum())
    return [1.0, float(p.max()), math.log1p(total), math.log1p(100 * total / (tokens + 20))]


_CLEAN = [1.0, 0.0, 0.0, 0.0]


# --- scoring -------------------------------------------------------------------------------


def score_texts(texts: pa.Array, model: Field) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score of each text and its toxic spans: code points of the lower-cased text, end exclusive."""
    scores, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for first, last, data, offsets in W.text_chunks(texts):
        start, end, row, feats = token_features(data, offsets)
        emit, hit = np.full(len(start), model.bias), np.zeros(len(start), bool)
        for f in feats:
            at = model.places(f)
            good = at >= 0
            emit[good] += model.weights[at[good]]
            hit |= good
        # texts without any hit share one score: their chains need no pass
        busy = np.zeros(last - first, bool)
        busy[row[hit]] = True
        use = busy[row]
        p = np.zeros(len(start))
        p[use] = marginals(emit[use], row[use], model.move)
        begin = np.searchsorted(row, np.arange(last - first + 1))
        chars = np.cumsum((data & 0xC0) != 0x80)
        for i in range(last - first):
            x = _CLEAN
            if busy[i]:
                mine = np.arange(begin[i], begin[i + 1])
                x = _summary(p[mine[hit[mine]]], len(mine))
                bad = mine[p[mine] >= 0.5]
                zero = chars[offsets[i]] - 1
                spans[first + i] = [(int(chars[start[k]] - 1 - zero), int(chars[end[k] - 1] - zero)) for k in bad]
            scores[first + i] = 1 / (1 + math.exp(-float(np.clip(np.dot(model.head, x), -30, 30))))
    return scores, spans


def _scored(batches: Iterator[pa.RecordBatch], model: Field, text_at: int) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        scores, spans = score_texts(batch.column(text_at).cast(pa.string()), model)
        told = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), told], names=[str(i) for i in range(batch.num_columns + 2)])


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> DataFrame:
    """`docs` with `__score` (0 to 1) and `__spans` (toxic tokens by code point), rows as they are."""
    model = fit(docs, labels, modulus, sample)
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = T.StructType([*docs.schema.fields]).add("__score", T.DoubleType()).add("__spans", T.ArrayType(span))
    text_at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _scored(it, model, text_at), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` (1 from a score of 1/2) and `spans`."""
    out = score_documents(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), labels, modulus)
    return out.select("doc_id", hold_out(modulus).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without rows whose score reaches `threshold`; columns stay."""
    return score_documents(docs, labels).where(F.col("__score") < threshold).drop("__score", "__spans")
