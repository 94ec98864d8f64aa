"""Session helpers: local session for tests, shared folder, checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def local_session(cores: int | str = 8, app: str = "wavetrail") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WAVETRAIL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from `spark.checkpoint.dir`.

    Where a local session leaves it unset, a temporary folder is set once. On a
    cluster an unset folder is an error: a machine-local path would be lost.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="wavetrail-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/wavetrail/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage.

    Unlike cached blocks the files survive the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise `df` as Parquet in the shared folder: compressed, and later plans read only the columns they use."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """A bounded read proves `df` small in rows and in bytes.

    Bytes are measured on the text of the rows, nested values included.
    """
    width = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return size[0] <= max_rows and size[1] <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast only if `is_small` says so.

    Beyond its bounds the side is returned unmarked: the join then shuffles and adaptive execution
    splits skewed keys.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
