"""Shared helpers: null-safe documents, written tables, components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.session import new_table_path

#: Bytes of one Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a cluster may use --py-files instead.

    Arrow batches are bounded by bytes too, so that long texts do not add up in a worker; a
    smaller bound of the session stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") in ("67108864", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id`, `text` (null counts as empty) and the named further columns."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def hold_out(modulus: int):
    """True for rows whose crc32 of the decimal doc_id leaves remainder 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, F.lit(True))


def bounded_sample(rows: DataFrame, key, size: int, total: int) -> DataFrame:
    """About `size` of `total` rows, at most twice as many: those whose hash of `key` is small.

    A filter that every task applies on its own: nothing is sorted and no task gathers the sample.
    """
    least = F.lit(-(1 << 63) + min(size, max(total, 1)) * ((1 << 64) - 1) // max(total, 1))
    return rows.where(F.xxhash64(*key) <= least).limit(2 * size)


class Scratch:
    """Tables written below `spark.checkpoint.dir`, which every executor can read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, part: str) -> DataFrame:
        """Write `df` as Parquet and read it back: lineage ends at the files."""
        path = new_table_path(self.spark, f"{self.name}-{part}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[part] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *parts: str) -> None:
        """Delete written tables that no later plan reads."""
        for part in parts:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(part))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of `edges(a, b)`: `node`, `root` (smallest node of its component).

    Alternating large-star and small-star contraction. Every step is an aggregation to the
    smallest neighbour and an equi-join, so a hub is a skewed join that adaptive execution
    splits, never a group in one task. Nodes without an edge between different nodes are
    not listed. Each round is written, so a lost executor repeats one round at most.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, step, seen = scratch.put(pairs, "cc0"), 0, None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("u"))
        step += 1
        flat = small.select("a", "b").union(small.select(F.col("u").alias("a"), "b")).where("a <> b").distinct()
        after = scratch.put(flat, f"cc{step}")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(f"cc{step - 1}")
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
