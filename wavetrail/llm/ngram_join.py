"""N-gram Jaccard join: MinHash banding, then exact comparison of full n-gram sets.

Every text becomes the set of its word 5-grams. Texts with the same word sequence are merged
first, so a group of copies is one member with a count. Each member gets `bands` band hashes of
`rows` MinHash values; members that share a band hash hang on the smallest member of that band
(a star, never all pairs). The connected parts of these stars hold every candidate pair. Inside
a part all full sets are compared in memory, in blocks of bounded size; what leaves a block is a
count of links per member and a spanning forest of the verified links.

Defined results: null or empty text, or text without a word, has no links and is its own class;
texts of one to four words count as one n-gram. Repeated rows (same id and text) are copies of
each other. A null id is an id of its own: a class has it only if none of its rows has another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail.llm import words as W
from wavetrail.llm.common import Scratch, components

SIMILARITY, SIZE, RECALL, MAX_HASHES = 0.8, 5, 0.999, 256
#: Members that one task compares at once; larger parts are cut into blocks and pairs of blocks.
BLOCK = 512


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands find a pair at `similarity` with `recall`."""
    best = (max_hashes, 1)
    for rows in range(1, min(max_hashes, 64) + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    each = W.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (each[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (each[n:] >> np.uint64(32)).astype(np.uint32)


def minima(gram: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values for each run of n-grams that starts at `first`: shape (n, runs)."""
    short = (gram >> np.uint64(32)).astype(np.uint32)
    mul, add = _coefficients(n)
    out = np.empty((n, len(first)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(short * mul[k] + add[k], first)
    return out


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Shape (runs, bands): a hash of the rows of each band and of the band's number."""
    out = np.empty((values.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(values.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = W.mix(h + values[b * rows + r])
        out[:, b] = h
    return out


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, word, row in W.words(batch.column(1)):
            starts = np.searchsorted(row, np.arange(last - first))
            count = np.diff(np.r_[starts, len(row)])
            has = np.flatnonzero(count)
            one, two = np.zeros(last - first, np.uint64), np.zeros(last - first, np.uint64)
            one[has], two[has] = W.sequence(word, starts[has], 1), W.sequence(word, starts[has], 2)
            gram, of = W.shingles(word, row, size)
            lists = np.zeros((0, bands), np.uint64)
            if len(has):
                lists = band_hashes(minima(gram, np.searchsorted(of, has), bands * rows), bands, rows)
            ends = np.zeros(last - first + 1, np.int32)
            ends[has + 1] = bands
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(lists.reshape(-1).view(np.int64))),
            ], ["doc_id", "key", "h1", "h2", "bands"])


def signatures(docs: DataFrame, bands: int, rows: int, size: int = SIZE) -> DataFrame:
    """`doc_id`, `key` of the text, 128 bits of the word sequence, band hashes (none for a text without words)."""
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _key(docs["text"]).alias("key"))
    return thin.mapInArrow(lambda it: _sign(it, bands, rows, size), "doc_id long, key long, h1 long, h2 long, bands array<long>")


def _key(text: Column) -> Column:
    """With its id, what tells a row from others: 64 bits of the text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs with exact Jaccard similarity of at least `similarity`."""
    gram = np.concatenate([*left, *right])
    own = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, code, df = np.unique(gram, return_inverse=True, return_counts=True)
    shared = np.zeros((len(left), len(right)), np.int32)
    use = df[code] > 1
    code, own = code[use], own[use]
    order = np.lexsort((own, code))
    code, own = code[order], own[order]
    values, column = np.unique(code, return_inverse=True)
    for low in range(0, len(values), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        dense = np.zeros((len(left) + len(right), min(4096, len(values) - low)), np.float32)
        dense[own[a:b], column[a:b] - low] = 1
        shared += (dense[: len(left)] @ dense[len(left) :].T).astype(np.int32)
    size = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return shared >= similarity * (size - shared) - 1e-9


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of an undirected graph given as a symmetric boolean matrix."""
    left, edges = np.ones(len(link), bool), []
    for root in range(len(link)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(link[u] & left)
            left[new] = False
            edges += [(u, int(v)) for v in new]
            queue += new.tolist()
    return edges


def _compare(group: pd.DataFrame, similarity: float, size: int) -> pd.DataFrame:
    """Links per member and a spanning forest of the links, for the parts or the pair of blocks of one task."""
    grams, seen = [], []
    texts = pa.array(group["text"], pa.string())
    for first, last, word, row in W.words(texts):
        starts = np.searchsorted(row, np.arange(last - first + 1))
        gram, of = W.shingles(word, row, size)
        cut = np.searchsorted(of, np.arange(last - first + 1))
        for i in range(last - first):
            own = word[starts[i] : starts[i + 1]]
            seen.append(int(W.sequence(own, np.zeros(1, int), 1).view(np.int64)[0]) if len(own) else 0)
            grams.append(np.unique(gram[cut[i] : cut[i + 1]]))
    group = group.assign(at=range(len(group)))[np.array(seen) == group["node"].to_numpy()].drop_duplicates("node")
    out = []
    for _, part in group.sort_values("node").groupby("root", sort=True):
        node, copies, side = part["node"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
        own = [grams[k] for k in part["at"]]
        if (side == 0).all():
            link = _linked(own, own, similarity)
            np.fill_diagonal(link, False)
        else:
            a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            link = np.zeros((len(own), len(own)), bool)
            if len(a) and len(b):
                link[np.ix_(a, b)] = _linked([own[k] for k in a], [own[k] for k in b], similarity)
                link |= link.T
        n = link @ copies
        out += [(int(node[k]), None, int(n[k])) for k in np.flatnonzero(n)]
        out += [(int(node[u]), int(node[v]), None) for u, v in _forest(link)]
    return pd.DataFrame({"a": pd.array([x[0] for x in out], "Int64"), "b": pd.array([x[1] for x in out], "Int64"), "n": pd.array([x[2] for x in out], "Int64")})


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members with the task or tasks that compare them: `task`, `side` (0 whole parts, 1 and 2 the two blocks)."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    tasks = max(1, math.ceil(members.count() / block))
    blocks = F.ceil(F.col("size") / block)
    sized = members.join(sizes, "root").withColumns({"blocks": blocks, "blk": F.pmod(F.xxhash64("node"), blocks)})
    small = sized.where("blocks = 1").select("*", F.concat(F.lit("p"), F.pmod(F.xxhash64("root"), F.lit(tasks))).alias("task"), F.lit(0).alias("side"))
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    name = F.concat_ws(":", "root", F.least("blk", "other"), F.greatest("blk", "other"))
    side = F.when(F.col("blk") == F.col("other"), 0).when(F.col("blk") < F.col("other"), 1).otherwise(2)
    large = sized.where("blocks > 1").select("*", pairs).select(*sized.columns, name.alias("task"), side.alias("side"))
    return small.union(large).select("node", "root", "doc_id", "copies", "task", "side")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: `doc_id`, `class_id` (smallest id of its class), `n_links`, `n_copies`.

    A class is a connected part of the graph of links; `n_links` counts the other documents
    with similarity of at least `similarity`, copies included.
    """
    found = _classes(docs, similarity, size, recall, block)
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, similarity: float, size: int = SIZE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """`near_classes` with `key` and `root`, the node of the class (null for a text without words)."""
    bands, rows = choose_bands(similarity, recall)
    scratch = Scratch(docs.sparkSession, "ngram")
    signed = scratch.put(signatures(docs, bands, rows, size), "signatures")
    worded = signed.where("size(bands) > 0")
    reps = scratch.put(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "reps")
    keyed = reps.select(F.col("h1").alias("node"), F.explode("bands").alias("band"))
    leads = keyed.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "lead")
    stars = keyed.join(leads, "band").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    parts = scratch.put(components(stars, scratch), "parts")
    members = scratch.put(parts.join(reps.select(F.col("h1").alias("node"), "doc_id", "copies"), "node"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), docs["text"].cast("string").alias("text"))
    # a null id is a member as any other
    wanted = _dealt(members, block)
    told = wanted.join(texts, wanted["doc_id"].eqNullSafe(texts["__id"])).select("task", "node", "root", "copies", "side", "text")
    found = scratch.put(told.groupBy("task").applyInPandas(lambda g: _compare(g, similarity, size), "a long, b long, n long"), "links")
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    classes = scratch.put(components(found.where("b is not null").select("a", "b"), scratch), "classes")
    nodes = reps.select(F.col("h1").alias("node"), "h2", "doc_id", "copies").join(links, "node", "left").join(classes, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    lowest = nodes.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    info = nodes.join(lowest, "root").select(F.col("node").alias("h1"), "h2", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    whole = worded.select("doc_id", "key", "h1", "h2").join(info, ["h1", "h2"]).select(
        "doc_id", "key", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    alone = signed.where("size(bands) = 0").select("doc_id", "key", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return whole.union(alone)


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without near copies: of each class one row stays, all its columns kept.

    That is the row with the smallest id (a row without id only if no other has one; among equal
    ids the text decides); of rows with the same id and text any one. Texts without words all stay.
    """
    rows = _classes(docs, similarity).where("root is not null").select("doc_id", "key", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    each = rows.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    keep = each.groupBy("root").agg(F.min(rank).alias("keep"))
    judged = each.join(keep, "root").select(F.col("doc_id").alias("id"), F.col("key").alias("text_key"), "n", rank.eqNullSafe(F.col("keep")).alias("stays"))
    judged = Scratch(docs.sparkSession, "ngram").put(judged.where("n > 1 or not stays"), "judged")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), _key(docs["text"]).alias("key"))
    same = held["doc_id"].eqNullSafe(judged["id"]) & (held["key"] == judged["text_key"])
    once = held.join(judged, same, "left_anti")
    again = held.join(judged.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "key"])
    return once.union(again).select("row.*")
