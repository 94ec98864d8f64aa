import bisect
import random

from pyspark.sql import functions as F

from wavetrail.operators import ordered as o


def test_global_positions(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    placed = o.global_positions(rows, ["v"], 7).collect()
    assert len(placed) == 1000 and all(r.position == r.v + 1 for r in placed)


def test_first_at_or_after(spark):
    rng = random.Random(5)
    times = {g: sorted(rng.sample(range(5000), 60)) for g in ("x", "y")}
    nodes = spark.createDataFrame([(g, t) for g in times for t in times[g]], "g string, t long")
    probes = [(g, rng.randrange(5200)) for g in ("x", "y") for _ in range(80)]
    asked = spark.createDataFrame(sorted(set(probes)), "g string, _probe long")
    for width, fan in ((1, 4096), (1, 3), (37, 2), (10_000, 4096)):
        for r in o.first_at_or_after(nodes, asked, ["g"], "t", width, fan).collect():
            at = bisect.bisect_left(times[r.g], r._probe)
            assert r._hit == (times[r.g][at] if at < 60 else None)


def test_no_task_orders_all_bins_of_a_key(spark):
    bins = spark.range(5_000).select(F.lit("k").alias("g"), (F.col("id") * 3).alias("b"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    for levels in (0, 1, 2, 3):
        got = {r.b: r.n for r in o.later_minimum(bins, ["g"], "b", "v", "n", fan=16, levels=levels).collect()}
        assert got == {3 * i: next((j for j in range(i + 1, 5_000) if j % 7 == 0), None) for i in range(5_000)}


def test_follow_jumps(spark):
    jumps = spark.createDataFrame(
        [("x", i, i + 3 if i + 3 < 40 else None) for i in range(40)], "g string, t long, nxt long"
    )
    start = spark.createDataFrame([("x", 1)], "g string, t long")
    got = sorted(r.t for r in o.follow_jumps(start, jumps, ["g"], "t").collect())
    assert got == list(range(1, 40, 3))


def test_heavy_keys_are_split(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 80, "hot").otherwise("cold").alias("k"))
    light, heavy, n = o.split_by_weight(rows, ["k"], 50)
    assert (light.count(), heavy.count(), n) == (20, 80, 80)
    assert o.split_by_weight(rows, ["k"], 90)[1] is None
