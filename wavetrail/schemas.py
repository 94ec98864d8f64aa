"""Declared schemas of landed data and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One nullable arm per kind of attribute value.
ANY_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("bool_value", T.BooleanType()),
        T.StructField("int_value", T.LongType()),
        T.StructField("double_value", T.DoubleType()),
        T.StructField("bytes_value", T.BinaryType()),
    ]
)
KEY_VALUE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", ANY_VALUE)])
SPAN = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("span_id", T.BinaryType()),
        T.StructField("start_unix_nano", T.DecimalType(20, 0)),
        T.StructField("end_unix_nano", T.DecimalType(20, 0)),
        T.StructField("status", T.StructType([T.StructField("code", T.IntegerType())])),
        T.StructField("attributes", T.ArrayType(KEY_VALUE)),
    ]
)
SCOPE_SPANS = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
RESOURCE_SPANS = T.StructType([T.StructField("scope_spans", T.ArrayType(SCOPE_SPANS))])
EXPORT = T.StructType(
    [
        T.StructField("export_id", T.StringType()),
        T.StructField("api_keys", T.ArrayType(T.StringType())),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("resource_spans", T.ArrayType(RESOURCE_SPANS)),
    ]
)

# File rows of the baseline list; field names are those of the file.
BASELINE_FILE = T.StructType(
    [
        T.StructField("Tenant", T.StringType()),
        T.StructField("Site", T.StringType()),
        T.StructField("Aisle", T.StringType()),
        T.StructField("Mean", T.DoubleType()),
        T.StructField("StdDev", T.DoubleType()),
    ]
)
BASELINE = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("aisle", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("stddev", T.DoubleType()),
    ]
)

WAVE = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("wave_id", T.StringType()),
        T.StructField("process_id", T.StringType()),
        T.StructField("variables", T.MapType(T.StringType(), T.StringType())),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("site_id", T.StringType(), False),
        T.StructField("aisle", T.StringType(), False),
        T.StructField("workflow_id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("task_id", T.StringType(), False),
        T.StructField("seconds", T.DoubleType(), False),
        T.StructField("observed_at", T.TimestampType(), False),
    ]
)
ALERT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("alert_id", T.StringType(), False),
        T.StructField("site_id", T.StringType(), False),
        T.StructField("aisle", T.StringType(), False),
        T.StructField("workflow_id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("mean_seconds", T.DoubleType(), False),
        T.StructField("threshold_seconds", T.DoubleType(), False),
        T.StructField("delivered_at", T.TimestampType(), True),
        T.StructField("last_error", T.StringType(), False),
        T.StructField("attempts", T.LongType(), False),
        T.StructField("next_attempt_at", T.TimestampType(), True),
        T.StructField("dead", T.BooleanType(), False),
    ]
)
PROCESS_TASK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("workflow_id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("task_id", T.StringType(), False),
        T.StructField("aisle", T.StringType(), False),
    ]
)
REROUTE = T.StructType(
    [
        T.StructField("alert_id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("site_id", T.StringType(), False),
        T.StructField("workflow_id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("aisle", T.StringType(), False),
    ]
)

# Unique keys of the stored tables.
UNIQUE_KEYS = {
    "observations": ("tenant_id", "event_id"),
    "alerts": ("tenant_id", "alert_id"),
    "process_tasks": ("tenant_id", "workflow_id", "run_id", "task_id"),
}
