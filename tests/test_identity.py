import hashlib

from pyspark.sql import functions as F

from wavetrail.functions import identity as i


def test_valid_id_rejects_newline_null_and_long(spark):
    values = ["a", "A-_9", "", "ab\n", "a b", "x" * 64, "x" * 65, "é", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in rows.select(i.valid_id("v")).collect()]
    assert got == [True, True, False, False, False, True, False, False, False]


def test_stable_id_uses_byte_lengths(spark):
    parts = ["demo", "é", "a:b"]
    text = b"".join(f"{len(p.encode())}:".encode() + p.encode() for p in parts)
    row = spark.range(1).select(i.stable_id(*[F.lit(p) for p in parts]).alias("h")).first()
    assert row.h == hashlib.sha256(text).hexdigest()


def test_workflow_id_is_null_with_a_null_part(spark):
    row = spark.range(1).select(
        i.workflow_id(F.lit("t"), F.lit("w")).alias("a"),
        i.workflow_id(F.lit("t"), F.lit(None).cast("string")).alias("b"),
    ).first()
    assert (row.a, row.b) == ("picking/t/w", None)


def test_retry_delay_doubles_up_to_64(spark):
    rows = spark.range(1, 10).select(i.retry_delay_seconds("id").alias("s")).collect()
    assert [r.s for r in rows] == [2, 4, 8, 16, 32, 64, 64, 64, 64]
