"""Readers of landed data; every schema is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail import schemas
from wavetrail.functions.identity import valid_id

# Fixed value: shortest accepted token, in bytes.
MIN_TOKEN_BYTES = 16


def read_span_exports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed trace exports (`json` lines or `parquet`)."""
    return spark.read.schema(schemas.EXPORT).format(fmt).load(path)


def read_span_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """The same exports as a stream; one micro-batch has at most `max_files` files or `max_bytes`.

    A micro-batch has one file at least, so a file above `max_bytes` comes alone. Spark takes one
    of the two bounds.
    """
    if max_files is not None and max_bytes is not None:
        raise ValueError("bound a micro-batch by files or by bytes, not by both")
    reader = spark.readStream.schema(schemas.EXPORT).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Baseline files: each a JSON array of {Tenant, Site, Aisle, Mean, StdDev}."""
    rows = spark.read.schema(schemas.BASELINE_FILE).option("multiLine", True).json(path)
    return rows.select(
        F.col("Tenant").alias("tenant_id"),
        F.col("Site").alias("site_id"),
        F.col("Aisle").alias("aisle"),
        F.col("Mean").alias("mean"),
        F.col("StdDev").alias("stddev"),
    )


def read_tenant_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token files: each a JSON object token -> tenant."""
    text = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", "map<string,string>")
    return text.select(F.explode(as_map).alias("token", "tenant_id"))


def token_violations(tokens: DataFrame) -> DataFrame:
    """Tokens below 16 bytes or with a malformed tenant."""
    short = F.octet_length("token") < MIN_TOKEN_BYTES
    return tokens.filter(short | ~valid_id("tenant_id"))


def require_tokens(tokens: DataFrame) -> DataFrame:
    """The same rows, or ValueError when there are none or one is invalid."""
    if tokens.isEmpty():
        raise ValueError("empty token map")
    if not token_violations(tokens).isEmpty():
        raise ValueError("tokens need at least 16 bytes and valid tenant ids")
    return tokens


def token_tenants(tokens: DataFrame) -> DataFrame:
    """Tenants that hold a token."""
    return tokens.select("tenant_id").distinct()


def read_waves(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Wave inputs with their branch variables."""
    return spark.read.schema(schemas.WAVE).format(fmt).load(path)
