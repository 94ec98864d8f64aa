"""Ordered per-key computation that stays split when one key is hot.

Window functions put a whole key in one task. That is the best plan while keys
are moderate. A key above a row limit is instead cut into consecutive chunks
by range partitioning on (key, order); every chunk gets the last rows of the
chunks before it as a halo, the window runs per (key, chunk), and the start of
the segment that is open when a chunk begins is carried over from a per-chunk
summary. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetrail.session import cut, small_side

# more chunks than this cost the driver more than they save; chunks then grow and spill
MAX_CHUNKS = 20_000
CHUNK = "_chunk"
HALO = "_halo"
# rows known from before: they take part like a halo and are not returned
SEED = "_seed"


def heavy_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than `limit` rows; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return counts.filter(F.col("_rows") > limit)


def split_by_weight(
    df: DataFrame, keys: Sequence[str], limit: int, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of ordinary keys, rows of heavy keys or None, number of heavy rows).

    `counted`, cheaper to compute, has at least the rows of `df` and is counted in its place.
    """
    heavy = heavy_groups(df if counted is None else counted, keys, limit)
    total = heavy.agg(F.sum("_rows")).first()[0]
    if total is None:
        return df, None, 0
    listed = small_side(cut(heavy.select(*keys)))
    on = list(keys)
    return df.join(listed, on, "left_anti"), df.join(listed, on, "left_semi"), int(total)


def sorted_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int
) -> DataFrame:
    """Range-partition on (keys, order) and tag rows with their chunk number.

    The result is materialised: chunk numbers come from sampled bounds, so they
    must be computed once and then read by every later step.
    """
    parts = df.repartitionByRange(min(max(chunks, 2), MAX_CHUNKS), *keys, *order)
    return cut(parts.withColumn(CHUNK, F.spark_partition_id()))


def with_halo(
    chunked: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int, payload: Sequence[str]
) -> DataFrame:
    """Add to each (key, chunk) the `depth` rows of the key that precede it.

    Halo rows carry `order` and `payload`; their other columns are null.
    """
    kept = [c for c in dict.fromkeys([*order, *payload])]
    group = [*keys, CHUNK]
    latest = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    # one array of at most `depth` structs per (key, chunk)
    tails = (
        chunked.select(*group, *kept, F.row_number().over(latest).alias("_rn"))
        .filter(F.col("_rn") <= depth)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("_tail"))
    )
    # a present chunk holds at least one row, so `depth` chunks back are enough
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-depth, -1)
    joined = F.flatten(F.collect_list("_tail").over(before))
    halo = (
        tails.select(*group, joined.alias("_all"))
        .select(
            *group,
            F.explode(
                F.slice("_all", F.greatest(F.size("_all") - depth + 1, F.lit(1)), F.lit(depth))
            ).alias("_row"),
        )
        .select(*group, *[F.col(f"_row.{c}").alias(c) for c in kept], F.lit(True).alias(HALO))
    )
    return chunked.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def over_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, list[str]], DataFrame],
    *,
    lookback: int,
    payload: Sequence[str],
    segment: str,
    heavy: DataFrame | None = None,
    heavy_rows: int = 0,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Run `compute(rows, partition_keys)` over ordinary and heavy rows.

    `compute` may look back `lookback` rows and must add `segment`: a value that
    grows along the order and is null for rows whose segment began before the
    first non-halo row it sees. Rows of `df` and `heavy` with a true `SEED` column
    come before the others of their key; they count as halo and are left out of
    the result, but the `segment` that `compute` gives them is carried on.
    """
    seeded = SEED in df.columns
    seed = F.coalesce(F.col(SEED), F.lit(False)) if seeded else F.lit(False)
    light = compute(df.withColumn(HALO, seed), list(keys))
    light = light.filter(~F.col(HALO)).drop(HALO, SEED) if seeded else light.drop(HALO)
    if heavy is None:
        return light
    chunks = -(-heavy_rows // chunk_rows)
    chunked = sorted_chunks(heavy, keys, order, chunks)
    group = [*keys, CHUNK]
    rows = with_halo(chunked, keys, order, lookback, payload)
    own = ~F.col(HALO)
    rows = rows.withColumn("_own", own).withColumn(HALO, F.col(HALO) | seed)
    done = compute(rows, group).filter("_own")
    # summary: one row per (key, chunk)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        done.groupBy(*group)
        .agg(F.max(segment).alias("_last"))
        .select(*group, F.max("_last").over(before).alias("_carry"))
    )
    filled = (
        done.filter(~F.col(HALO))
        .join(carry, group, "left")
        .withColumn(segment, F.coalesce(F.col(segment), F.col("_carry")))
        .drop("_carry", "_own", CHUNK, HALO, SEED)
    )
    return light.unionByName(filled)


def global_positions(
    df: DataFrame, order: Sequence[str], chunks: int, name: str = "position"
) -> DataFrame:
    """1-based position of every row in the total order `order`, without a single-task sort."""
    chunked = sorted_chunks(df, [], order, chunks)
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk: this window is over a chunk summary, not over the data
    starts = (
        chunked.groupBy(CHUNK)
        .agg(F.count("*").alias("_n"))
        .select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    return (
        chunked.join(starts, CHUNK)
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_start", CHUNK)
    )


#: Bins that one task of a level of the bin index orders at most.
FAN = 4096


def later_minimum(
    bins: DataFrame, keys: Sequence[str], at: str, value: str, name: str, fan: int = FAN, levels: int = 2
) -> DataFrame:
    """`bins` (one row per keys and `at`) with `name`: the least `value` of the later bins of the key.

    An index of `levels` levels: a bin looks at the rest of its group of `fan` bins, then at the later
    groups through their minima, which are looked up in the same way. No task orders more than `fan`
    bins below the top level, which has one row per fan ** levels bins. `value` grows with `at`.
    """
    later = lambda *by: F.min(value).over(
        Window.partitionBy(*by).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    if not levels:
        return bins.withColumn(name, later(*keys))
    up, least, beyond = f"_up{levels}", f"_least{levels}", f"_beyond{levels}"
    grouped = bins.withColumn(up, F.floor(F.col(at) / fan).cast("long"))
    groups = grouped.groupBy(*keys, up).agg(F.min(value).alias(least))
    above = later_minimum(groups, keys, up, least, beyond, fan, levels - 1).drop(least)
    return (
        grouped.withColumn(name, later(*keys, up))
        .join(above, [*keys, up])
        .withColumn(name, F.coalesce(name, beyond))
        .drop(up, beyond)
    )


def first_at_or_after(
    nodes: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, width: int, fan: int = FAN
) -> DataFrame:
    """For each probe (keys, `_probe`, ...) the smallest node `at` >= `_probe`, as `_hit`.

    Both sides fall into time bins of `width`; the bin minimum bridges to later
    bins through an index in levels, so neither a range join, nor a per-key sort
    of all rows, nor one of all bins is needed.
    """
    on = [*keys, "_bin"]
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    left = nodes.select(
        *keys, bin_of(at).alias("_bin"), F.col(at).alias("_t"), F.lit(1).alias("_node")
    )
    right = probes.withColumn("_bin", bin_of("_probe")).withColumn("_t", F.col("_probe"))
    right = right.withColumn("_node", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    node_time = F.when(F.col("_node") == 1, F.col("_t"))
    bins = both.groupBy(*on).agg(F.min(node_time).alias("_first"))
    bins = later_minimum(bins, keys, "_bin", "_first", "_next_bin", fan).drop("_first")
    from_end = (
        Window.partitionBy(*on).orderBy(F.col("_t").desc(), F.col("_node").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = both.withColumn("_in_bin", F.min(node_time).over(from_end)).filter("_node = 0")
    return (
        inside.join(bins, on)
        .withColumn("_hit", F.coalesce("_in_bin", "_next_bin"))
        .drop("_bin", "_t", "_node", "_in_bin", "_next_bin")
    )


def follow_jumps(start: DataFrame, jumps: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All (keys, at) on the chains that begin at `start` and follow `jumps.nxt`.

    Jump pointers are doubled each round, so a chain of n hops takes log2(n)
    rounds; every join is on (keys, at), which is unique on the jump side.
    """
    on = [*keys, at]
    reached = cut(start.select(*on))
    jumps = cut(jumps.filter(F.col("nxt").isNotNull()).select(*on, "nxt"))
    while True:
        ahead = cut(
            reached.join(jumps, on).select(*keys, F.col("nxt").alias(at))
        )
        if ahead.isEmpty():
            return reached
        reached = cut(reached.unionByName(ahead))
        second = jumps.select(*keys, F.col(at).alias("nxt"), F.col("nxt").alias("_far"))
        jumps = cut(
            jumps.join(second, [*keys, "nxt"]).select(*on, F.col("_far").alias("nxt"))
        )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in `order`.

    A rank filter of 1 lets Spark keep one row per key and task before the
    shuffle, so many copies of one key do not meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
