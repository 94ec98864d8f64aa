"""Mixture-controlled packing: every window is filled to target token proportions.

Sources are queues of documents in doc_id order, tokenised and closed by an end id. Deficit
round-robin gives queue k in each window of `width` tokens its share plus the deficit it
carries; over w windows that is C(k, w) = floor(width*w*F(k)/F) - floor(width*w*F(k-1)/F) tokens,
F(k) being the summed weights of the first k queues. So every window is full, no queue is
ever more than one token away from its target, and the deficit at any window follows from its
number: partitions need no other state than where their documents stand in their queues.

Sources too small for a token in every window share the last queue. Inside it they take turns by
deficit too, a quantum at a time: quantum j of a source of weight w comes at the time (j + 1/2) / w, so
that each has its share of any stretch of the queue to within a quantum, however many sources there are.
Their order is a sort of the quanta in Spark, their places a running sum over its ranges.

When a queue can't fill its share of a window any more, what it has left goes to the tail and
the others go on with the remaining weights. The tail is packed last: full windows, then windows
whose lengths are powers of two, so nothing is padded.

Null text counts as empty: it has only the end id. A null source is a queue of its own. Rows
with the same doc_id follow in the order of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.llm.common import Scratch
from wavetrail.llm.tokens import closed, encoder
from wavetrail.operators.ordered import CHUNK, sorted_chunks
from wavetrail.session import small_side

WIDTH = 2048
#: Sources of at least 1/QUEUES of all tokens have a queue of their own; the others share the last queue.
#: Every queue must have a token per window at least, so narrow windows have fewer queues (width / 4).
QUEUES = 512
#: Tokens that a source of the shared queue gives at a time.
QUANTUM = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Plan:
    """Places of tokens: phases of full windows with fixed weights, then the tail."""

    def __init__(self, totals: list[int], weights: list[int], width: int = WIDTH):
        self.width, self.phases = width, []
        left, active, window = list(totals), [k for k, w in enumerate(weights) if w > 0 and totals[k] > 0], 0
        while active:
            cum = [0]
            for k in range(len(totals)):
                cum.append(cum[-1] + (weights[k] if k in active else 0))
            given = lambda k, w: width * w * cum[k + 1] // cum[-1] - width * w * cum[k] // cum[-1]  # noqa: B023, E731
            n = min(left[k] * cum[-1] // (width * weights[k]) + 1 for k in active)
            while n and any(given(k, n) > left[k] for k in active):
                n -= 1
            if n:
                done = [t - x for t, x in zip(totals, left)]
                self.phases.append((window, n, cum, done))
                left = [x - given(k, n) for k, x in enumerate(left)]
                window += n
            active = [k for k in active if 0 < left[k] >= given(k, n + 1) - given(k, n)]
        self.windows, self.tail_from = window, [t - x for t, x in zip(totals, left)]
        self.tail_base = np.cumsum([0, *left]).tolist()
        rest, ends = self.tail_base[-1], []
        size = width
        while rest:
            while size > rest:
                size //= 2
            ends.append((ends[-1] if ends else 0) + size)
            rest -= size
        self.tail_ends = ends

    def cuts(self, k: int, x: int, n: int) -> list[tuple[int, int, int, int]]:
        """Pieces of tokens [x, x + n) of queue k: (first token, length, sequence, offset)."""
        out, end = [], x + n
        for window, count, cum, done in self.phases:
            total, width = cum[-1], self.width
            a, b = cum[k], cum[k + 1]
            if a == b or x >= end:
                continue
            given = lambda w: width * w * b // total - width * w * a // total  # noqa: B023, E731
            last = done[k] + given(count)
            if x >= last:
                continue
            w = max(0, (x - done[k]) * total // (width * (b - a)) - 2)
            while given(w + 1) <= x - done[k]:
                w += 1
            while x < min(end, last):
                low, high = done[k] + given(w), done[k] + given(w + 1)
                stop = min(high, end)
                if stop > x:
                    inside = width * (w + 1) * a // total - width * w * a // total
                    out.append((x, stop - x, window + w, inside + x - low))
                    x = stop
                w += 1
        while x < end:
            place = self.tail_base[k] + x - self.tail_from[k]
            i = int(np.searchsorted(self.tail_ends, place, "right"))
            before = self.tail_ends[i - 1] if i else 0
            stop = min(end, x + self.tail_ends[i] - place)
            out.append((x, stop - x, self.windows + i, place - before))
            x = stop
        return out


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Ids of each document and how many its source has before it in this partition.

    Rows come in the order of their source, so a partition knows its sources one after another.
    """
    part, source, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        for first, last, ids, offsets in encoder(path).encode(batch.column(2)):
            ids, offsets = closed(ids, offsets, end_id)
            n = last - first
            sources = batch.column(1).slice(first, n)
            runs = pc.run_end_encode(sources)
            at, low = np.empty(n, np.int64), 0
            for name, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != source:
                    source, before = name, 0
                at[low:high] = before + offsets[low:high] - offsets[low]
                before, low = int(before + offsets[high] - offsets[low]), high
            held = ids.astype("<u4" if wide else "<u2")
            cuts = pa.array((offsets * held.itemsize).astype(np.int32)).buffers()[1]
            binary = pa.Array.from_buffers(pa.binary(), n, [None, cuts, pa.py_buffer(held)])
            columns = [batch.column(0).slice(first, n), sources, pa.array(np.full(n, part, np.int32)), pa.array(at), pa.array(np.diff(offsets)), binary]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "part", "at", "n", "ids"])


def _pieces(batches: Iterator[pa.RecordBatch], plan: Plan, wide: bool, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Windows of rows (doc_id, queue, x, ids, start in the document, tokens of the document)."""
    kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    for batch in batches:
        ids_of = batch.column(3)
        rows = []
        for i, (doc, queue, x, start, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)))):
            ids = np.frombuffer(ids_of[i].as_buffer(), "<u4" if wide else "<u2").astype("<u4").tobytes()
            for at, length, sequence, offset in plan.cuts(queue, x, len(ids) // 4):
                own = ids[4 * (at - x) : 4 * (at - x + length)]
                rows.append((doc, start + at - x, length, zlib.crc32(own), tokens, sequence, offset) + ((own,) if keep_ids else ()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _turns(sources: DataFrame, quantum: int) -> DataFrame:
    """`source`, `j`, `place`: where in the shared queue quantum j of each of `sources(source, n, weight)` begins."""
    count = F.ceil(F.col("n") / quantum).cast("long")
    quanta = sources.where("n > 0").select("source", "n", "weight", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("j"))
    quanta = quanta.select("source", "j", ((F.col("j") + 0.5) / F.col("weight")).alias("time"), F.least(F.lit(quantum), F.col("n") - F.col("j") * quantum).cast("long").alias("size"))
    order = ["time", "source", "j"]
    chunked = sorted_chunks(quanta, [], order, sources.sparkSession.sparkContext.defaultParallelism)
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = chunked.groupBy(CHUNK).agg(F.sum("size").alias("all")).select(CHUNK, F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(starts), CHUNK)
    return placed.select("source", "j", (F.col("start") + F.col("own")).alias("place"))


def _shared(rows: DataFrame, turns: DataFrame, quantum: int, width: int) -> DataFrame:
    """Documents of the shared queue cut at quanta: `doc_id`, `x`, `ids`, `start`, `tokens`.

    `rows`: `doc_id`, `source`, `y` (tokens of the source before it), `n`, `ids` of `width` bytes each.
    """
    q = F.lit(quantum).cast("long")
    first, last = F.floor(F.col("y") / q), F.floor((F.col("y") + F.col("n") - 1) / q)
    cut = rows.select("*", F.explode(F.sequence(first, last)).alias("j"))
    low = F.greatest(F.col("y"), F.col("j") * q)
    high = F.least(F.col("y") + F.col("n"), (F.col("j") + 1) * q)
    cut = cut.select("doc_id", "source", "j", "n", low.alias("low"), (low - F.col("y")).alias("start"), (high - low).alias("size"), "ids")
    bytes_ = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("size") * width).cast("int"))
    cut = cut.select("doc_id", "source", "j", "low", "start", F.col("n").alias("tokens"), bytes_.alias("ids"))
    named = turns.select(F.col("source").alias("of"), F.col("j").alias("turn"), "place")
    told = cut.join(named, cut["source"].eqNullSafe(named["of"]) & (cut["j"] == named["turn"]))
    return told.select("doc_id", (F.col("place") + F.col("low") - F.col("j") * q).alias("x"), "ids", "start", "tokens")


def pack(docs: DataFrame, path: str, end_id: int, targets: dict[str | None, float] | None = None, width: int = WIDTH, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, by sequence: see the module. `keep_ids` adds each piece's ids (unsigned 32-bit, little-endian).

    `targets`: wanted share of tokens by source; by default each source's share of the corpus,
    with which all queues end together. Texts shuffle once, to the order of their queue; a hot
    source is spread over ranges of doc_id. Per source only a total for each partition is
    gathered (at most partitions x sources rows, summed in Spark to one base per partition and source).
    """
    # at most `queues` sources have a queue and come to the driver; the others stay rows of Spark
    spark = docs.sparkSession
    wide = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    scratch = Scratch(spark, "packing")
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    ordered = thin.repartitionByRange("source", "doc_id", F.xxhash64("text")).sortWithinPartitions("source", "doc_id", "text")
    stored = scratch.put(ordered.mapInArrow(lambda it: _tokenised(it, path, end_id, wide), "doc_id long, source string, part int, at long, n long, ids binary"), "ids")
    sums = stored.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    queues = max(1, min(QUEUES, width // 4))
    own = [(r["source"], r["n"]) for r in by_source.where(F.col("n") * queues >= total).orderBy(F.desc("n"), "source").limit(queues).collect()]
    rest = total - sum(n for _, n in own)
    while own and 0 < rest * queues < total:
        rest += own.pop()[1]  # the rest is too small for a queue: the smallest source shares it
    totals, unit, targets = [n for _, n in own] + [rest] * (rest > 0), 1 << 20, targets or {}
    weights = list(totals)
    if targets:
        least = unit // queues
        others = sum(share for source, share in targets.items() if source not in dict(own))
        weights = [max(least, round(unit * targets.get(source, 0.0))) for source, _ in own] + [max(least, round(unit * others))] * (rest > 0)
    plan = Plan(totals, weights, width)
    names = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(own)], "source string, queue int")
    bases = small_side(scratch.put(_bases(sums), "bases"))
    told = stored.join(bases, stored["source"].eqNullSafe(bases["of"]) & (stored["part"] == bases["p"]))
    told = told.select("doc_id", "source", (F.col("base") + F.col("at")).alias("y"), "n", "ids")
    queued = told.join(F.broadcast(names.withColumnRenamed("source", "of")), told["source"].eqNullSafe(F.col("of")))
    rows = queued.select("doc_id", "queue", F.col("y").alias("x"), "ids", F.lit(0).cast("long").alias("start"), F.col("n").alias("tokens"))
    if rest:
        small = by_source.join(F.broadcast(names), by_source["source"].eqNullSafe(names["source"]), "left_anti")
        share = F.lit(None).cast("double")
        for source, part in targets.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(source)), float(part)).otherwise(share)
        # a source without a target comes after those with one, in its share of the tokens
        weight = F.coalesce(F.when(share > 0, share), F.col("n") / (total * queues)) if targets else F.col("n").cast("double")
        turns = scratch.put(_turns(small.withColumn("weight", weight), QUANTUM), "turns")
        mine = told.join(F.broadcast(names.withColumnRenamed("source", "of")), told["source"].eqNullSafe(F.col("of")), "left_anti")
        shared = _shared(mine, turns, QUANTUM, 4 if wide else 2)
        rows = rows.union(shared.select("doc_id", F.lit(len(own)).alias("queue"), "x", "ids", "start", "tokens"))
    return rows.mapInArrow(lambda it: _pieces(it, plan, wide, keep_ids), SCHEMA + (", ids binary" if keep_ids else ""))


def _bases(sums: DataFrame) -> DataFrame:
    """Tokens of a source before each of its partitions: a running sum over one row per source and partition."""
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("source").alias("of"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))


def assemble(pieces: DataFrame) -> DataFrame:
    """`sequence_id`, `length`, `ids` of each sequence from pieces made with `keep_ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
