"""Queries of sources, sinks, baselines and the stream.

Files are written to the shared folder first and then read by the reader under
test, so every query works on data derived from the driver tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetrail.operators import detector as d
from wavetrail.operators import ingest, outbox, receipts
from wavetrail.plans import models, stored
from wavetrail.plans.exports import SPANS_SQL, exports
from wavetrail.plans.models import MODELS_SQL, WAVES_SQL
from wavetrail.plans.movements import (
    CONFIG,
    DETECTOR_SQL,
    baselines,
    completed_movements,
    with_,
)
from wavetrail.plans.registry import query, table
from wavetrail.plans.stored import OUTBOX_SQL, RECEIPTS_SQL
from wavetrail.session import cut, new_table_path
from wavetrail.sources import process_files, readers, sinks
from wavetrail.streaming import detector as stream

# --- exports --------------------------------------------------------------

EXPORT_SQL = with_(
    SPANS_SQL,
    """select export_id, any_value(n_keys) as n_keys, count(*) as n_spans,
              cast(any_value(received_at) as varchar) as received_at
       from spans group by export_id""",
)


def _export_summary(rows: DataFrame) -> DataFrame:
    return rows.select(
        "export_id",
        F.size("api_keys").alias("n_keys"),
        ingest.span_count().cast("long").alias("n_spans"),
        F.col("received_at").cast("timestamp_ntz").cast("string").alias("received_at"),
    )


@query("read_span_exports", EXPORT_SQL)
def read_span_exports(spark, sf_dir):
    path = new_table_path(spark, "exports")
    exports(spark, sf_dir).write.json(path)
    return _export_summary(readers.read_span_exports(spark, path, "json"))


@query("read_span_stream", EXPORT_SQL)
def read_span_stream(spark, sf_dir):
    path, out = new_table_path(spark, "exports"), new_table_path(spark, "stream-out")
    exports(spark, sf_dir).write.parquet(path)
    rows = readers.read_span_stream(spark, path, "parquet", max_bytes=1 << 20)
    stream.run_to_log(_export_summary(rows), out, new_table_path(spark, "stream-state"))
    return spark.read.parquet(out)


@query("fan_out", EXPORT_SQL)
def fan_out(spark, sf_dir):
    """Two runs of a stream deliver the same export rows to the archive and to the analysed output."""
    landed, archive, out, state = (new_table_path(spark, n) for n in ("landed", "archive", "analysed", "fan-state"))
    rows, later = exports(spark, sf_dir), F.crc32("export_id") % 2
    for part in (0, 1):
        rows.filter(later == part).write.mode("append").parquet(landed)
        arrivals = readers.read_span_stream(spark, landed, "parquet", max_files=16)
        sinks.fan_out_stream(
            arrivals, archive, lambda batch: _export_summary(batch).write.mode("append").parquet(out), state
        )
    archived = spark.read.parquet(archive).select("export_id")
    return spark.read.parquet(out).join(archived, "export_id", "left_semi")


# --- baselines and tokens ---------------------------------------------------

PER_FILE = 500


def _part_baselines(spark, sf_dir) -> DataFrame:
    """One baseline per part; some break one rule each."""
    k = F.col("p_partkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nan, inf = F.lit(float("nan")), F.lit(1e308)
    return table(spark, sf_dir, "part").select(
        text("t", k % 3).alias("tenant_id"),
        F.when(k % 19 == 3, "bad site").otherwise(text("s", k % 2)).alias("site_id"),
        text("A", k).alias("aisle"),
        F.when(k % 23 == 4, 0.0).when(k % 29 == 5, nan).when(k % 31 == 7, inf)
        .otherwise(F.col("p_size").cast("double")).alias("mean"),
        F.when(k % 37 == 6, -1.0).when(k % 31 == 7, inf)
        .otherwise(F.col("p_retailprice") / 100).alias("stddev"),
    )


PART_BASELINES_SQL = """
part_baselines as (
  select 't' || p_partkey % 3 as tenant_id,
    case when p_partkey % 19 = 3 then 'bad site' else 's' || p_partkey % 2 end as site_id,
    'A' || p_partkey as aisle,
    case when p_partkey % 23 = 4 then 0.0 when p_partkey % 29 = 5 then 'nan'::double
         when p_partkey % 31 = 7 then 1e308 else p_size::double end as mean,
    case when p_partkey % 37 = 6 then -1.0 when p_partkey % 31 = 7 then 1e308
         else p_retailprice / 100 end as stddev
  from part
)
"""


def _finite(rows: DataFrame) -> DataFrame:
    """JSON has no NaN: the file holds only baselines with numbers."""
    return rows.filter(~F.isnan("mean"))


@query(
    "read_baselines",
    with_(
        PART_BASELINES_SQL,
        """select tenant_id, site_id, aisle, mean, stddev from part_baselines
           where not isnan(mean)""",
    ),
)
def read_baselines(spark, sf_dir):
    """Each file is one JSON array of at most 500 baselines."""
    path = new_table_path(spark, "baselines")
    entry = F.struct(
        F.col("tenant_id").alias("Tenant"), F.col("site_id").alias("Site"),
        F.col("aisle").alias("Aisle"), F.col("mean").alias("Mean"), F.col("stddev").alias("StdDev"),
    )
    number = F.floor(F.substring("aisle", 2, 20).cast("long") / PER_FILE)
    arrays = _finite(_part_baselines(spark, sf_dir)).groupBy(number).agg(
        F.to_json(F.collect_list(entry)).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_baselines(spark, path)


@query(
    "validate_baselines",
    with_(
        PART_BASELINES_SQL,
        """select aisle, violation from (
             select aisle, case
               when not regexp_matches(site_id, '^[A-Za-z0-9_-]{1,64}$') then 'invalid_id'
               when isnan(mean) or mean <= 0 then 'invalid_mean'
               when isnan(stddev) or stddev <= 0 then 'invalid_stddev'
               when mean > 1e307 then 'infinite_threshold' end as violation
             from part_baselines) where violation is not null""",
    ),
)
def validate_baselines(spark, sf_dir):
    rows = d.validate_baselines(_part_baselines(spark, sf_dir), CONFIG.sigma)
    return rows.select("aisle", "violation")


@query(
    "baseline_threshold",
    with_(
        PART_BASELINES_SQL,
        """select aisle, case when isnan(mean + 2.5 * stddev) then 'none'
             when isinf(mean + 2.5 * stddev) then 'infinite'
             when abs(mean + 2.5 * stddev) >= 1e15 then 'large'
             else cast(cast(floor((mean + 2.5 * stddev) * 100) as bigint) as varchar) end as threshold
           from part_baselines""",
    ),
)
def baseline_threshold(spark, sf_dir):
    """In whole hundredths; a threshold that is no number, infinite or beyond 1e15 is named."""
    rows = d.baseline_threshold(_part_baselines(spark, sf_dir), CONFIG.sigma)
    level = F.col("threshold")
    whole = F.floor(level * 100).cast("string")
    named = F.when(F.isnan(level), "none").when(F.abs(level) == float("inf"), "infinite")
    named = named.when(F.abs(level) >= 1e15, "large").otherwise(whole)
    return rows.select("aisle", named.alias("threshold"))


TOKENS_SQL = """
supplier_tokens as (
  select case when s_suppkey % 7 = 3 then 'short-' || s_suppkey else 'token-of-supplier-' || s_suppkey end
           as token,
         case when s_suppkey % 11 = 4 then 'bad tenant' else 't' || s_nationkey end as tenant_id
  from supplier
)
"""


def _read_tokens(spark, sf_dir) -> DataFrame:
    path = new_table_path(spark, "tokens")
    k = F.col("s_suppkey")
    token = F.when(k % 7 == 3, F.concat(F.lit("short-"), k.cast("string"))).otherwise(
        F.concat(F.lit("token-of-supplier-"), k.cast("string"))
    )
    tenant = F.when(k % 11 == 4, "bad tenant").otherwise(
        F.concat(F.lit("t"), F.col("s_nationkey").cast("string"))
    )
    objects = table(spark, sf_dir, "supplier").groupBy(F.floor(k / PER_FILE)).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(token, tenant)))).alias("value")
    )
    objects.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_tenant_tokens(spark, path)


@query("read_tenant_tokens", with_(TOKENS_SQL, "select token, tenant_id from supplier_tokens"))
def read_tenant_tokens(spark, sf_dir):
    return _read_tokens(spark, sf_dir)


@query(
    "token_violations",
    with_(
        TOKENS_SQL,
        "select token, tenant_id from supplier_tokens where strlen(token) < 16 or tenant_id = 'bad tenant'",
    ),
)
def token_violations(spark, sf_dir):
    return readers.token_violations(_read_tokens(spark, sf_dir))


@query("token_tenants", with_(TOKENS_SQL, "select distinct tenant_id from supplier_tokens"))
def token_tenants(spark, sf_dir):
    return readers.token_tenants(_read_tokens(spark, sf_dir))


# --- waves and models ---------------------------------------------------------


@query(
    "read_waves",
    with_(
        MODELS_SQL + WAVES_SQL,
        "select tenant_id, site_id, wave_id, process_id, service from waves",
        recursive=True,
    ),
)
def read_waves(spark, sf_dir):
    path = new_table_path(spark, "waves")
    models.waves(spark, sf_dir).drop(models.K).write.json(path)
    rows = readers.read_waves(spark, path)
    service = F.coalesce(F.col("variables")["service"], F.lit(""))
    return rows.select("tenant_id", "site_id", "wave_id", "process_id", service.alias("service"))


EXTENSION = "urn:example:picking"
DOCUMENTS_PER_TASK = 50_000


def _documents(spark, sf_dir) -> DataFrame:
    """One XML document per order key, written in its row; every model holds a bounded number of tags.

    A key that n orders have gives n processes, each with n copies of every tag, as grouped rows would.
    """
    lit = lambda v: F.lit(v) if isinstance(v, str) else v

    def tag(kind, id_, **extensions) -> Column:
        parts = [F.lit("<bpmn:"), lit(kind), F.lit(' id="'), lit(id_), F.lit('"')]
        for name, value in extensions.items():
            quoted = F.concat(F.lit(f' af:{name}="'), lit(value), F.lit('"'))
            parts.append(F.when(lit(value) != "", quoted).otherwise(""))
        return F.concat(*parts, F.lit("/>"))

    def flow(id_, source, target, value="") -> Column:
        ends = F.concat(lit(id_), F.lit('" sourceRef="'), lit(source), F.lit('" targetRef="'), lit(target))
        return tag("sequenceFlow", ends, value=value)

    k, d, n, extra = F.col(models.K), F.col("d"), F.col("n"), F.col("extra")
    text, task = models.text, "serviceTask"
    only = lambda condition, *tags: F.when(condition, F.concat(*tags)).otherwise("")
    each = lambda last, of: F.array_join(
        F.transform(F.filter(F.sequence(F.lit(0), last), lambda i: i > 0), of), ""
    )

    def pick(i: Column) -> Column:
        aisle = text("A0", (k + i) % 3 + 1)
        alternative = F.when((k + i) % 4 == 0, "").otherwise(text("B0", (k + i) % 3 + 1))
        node = tag(
            task, text("t", i), aisle=F.when((d == 3) & (i == 1), "A 1").otherwise(aisle),
            alternative=F.when((d == 4) & (i == 1), aisle).otherwise(alternative),
        )
        after = F.when(d == 6, "missing").when(d == 8, "t1").otherwise(F.when(extra > 0, "x1").otherwise("gate"))
        target = F.when(i == n, after).otherwise(text("t", i + 1))
        id_ = F.when((d == 18) & (i == 1), "t1").otherwise(text("f", i))
        return F.concat(node, flow(id_, text("t", i), target, F.when((d == 7) & (i == n), "stray").otherwise("")))

    def link(c: Column) -> Column:
        target = F.when(c == extra, "gate").otherwise(text("x", c + 1))
        return F.concat(tag(task, text("x", c), aisle="C01"), flow(text("g", c), text("x", c), target))

    body = F.concat(
        tag("startEvent", "start"),
        only(
            d != 15, each(n, pick), each(extra, link),
            tag(F.when(d == 11, "parallelGateway").otherwise("exclusiveGateway"), "gate",
                variable=F.when(d == 5, "").otherwise("service")),
            tag(task, "pack_std", aisle="PACK"), tag(task, "pack_exp", aisle="EXPRESS"),
            only(d == 9, tag(task, "orphan", aisle="A01")), only(d == 12, tag(task, "t1", aisle="A01")),
            only(d == 16, tag(task, "u1", aisle="A01"), tag(task, "u2", aisle="A01")),
        ),
        only(d == 1, tag("startEvent", "start2")), only(d != 2, tag("endEvent", "end")),
        flow("f0", "start", F.when(d == 15, "end").otherwise("t1")),
        only(
            d != 15, flow("b1", "gate", "pack_std", "standard"),
            only(d != 14, flow("b2", "gate", "pack_exp", F.when(d == 10, "standard").otherwise("express"))),
            flow("e1", "pack_std", "end"), flow("e2", "pack_exp", "end"),
            only(d == 16, flow("u12", "u1", "u2"), flow("u21", "u2", "u1")),
        ),
    )
    small = F.concat(
        tag("startEvent", "start"), tag(task, "only", aisle="A01"), tag("endEvent", "end"),
        flow("f0", "start", "only"), flow("f1", "only", "end"),
    )
    process = lambda id_, runs, inner: F.repeat(
        F.concat(
            F.lit('<bpmn:process id="'), id_, F.lit('" isExecutable="'), lit(runs), F.lit('">'),
            F.repeat(inner, F.col("_n")), F.lit("</bpmn:process>"),
        ),
        F.col("_n"),
    )
    head = (
        '<?xml version="1.0"?><bpmn:definitions '
        f'xmlns:bpmn="{process_files.MODEL_NAMESPACE}" xmlns:af="{EXTENSION}">'
    )
    orders = models.shape(spark, sf_dir).filter(k.isNotNull())
    # a thin row becomes a document: adaptive execution would join tasks by the bytes of the thin rows
    orders = orders.repartition(models.tasks_of(orders, DOCUMENTS_PER_TASK), k)
    orders = orders.groupBy(*orders.columns).agg(F.count("*").cast("int").alias("_n"))
    return orders.select(
        text("doc", k).alias("doc_id"),
        F.concat(
            F.lit(head), process(F.col("process_id"), F.when(d == 17, "false").otherwise("true"), body),
            F.when(d == 19, process(text("q", k), "true", small)).otherwise(""), F.lit("</bpmn:definitions>"),
        ).alias("xml"),
    )


@query(
    "read_process_models",
    with_(
        MODELS_SQL,
        """select process_id, id, kind, aisle, alternative, variable, '' as source, '' as target, '' as value
           from nodes where kind <> 'parallelGateway'
           union all
           select process_id, id, 'sequenceFlow', '', '', '', source, target, value from flows""",
    ),
)
def read_process_models(spark, sf_dir):
    path = new_table_path(spark, "documents")
    _documents(spark, sf_dir).write.parquet(path)
    return process_files.parse_process_models(spark.read.parquet(path), EXTENSION).elements


@query(
    "model_document_violations",
    with_(
        MODELS_SQL,
        """select 'doc' || k as doc_id, 'unknown_element' as rule, 'bpmn:parallelGateway' as subject
             from shape where d = 11
           union all select 'doc' || k, 'one_process', '' from shape where d = 19
           union all select 'doc' || k, 'unknown_attribute', 'serviceTask@af:note' from shape where k % 43 = 1
           union all select 'doc' || k, 'doctype', '' from shape where k % 43 = 2
           union all select 'doc' || k, 'malformed_xml', '' from shape where k % 43 = 2
           union all select 'doc' || k, 'text', '' from shape where k % 43 = 3
           union all select 'doc' || k, 'unknown_element', 'bpmn:boundaryEvent' from shape where k % 43 = 4""",
    ),
)
def model_document_violations(spark, sf_dir):
    """Documents get further defects by order key: attribute, doctype, text, element."""
    k = F.substring("doc_id", 4, 20).cast("long")
    # a pick that every defective document ends with
    end = "</bpmn:process></bpmn:definitions>"
    insert = lambda text: F.concat(
        F.expr(f"substring(xml, 1, length(xml) - {len(end)})"), F.lit(text + end)
    )
    documents = _documents(spark, sf_dir).withColumn(
        "xml",
        F.when(k % 43 == 1, insert('<bpmn:serviceTask id="z" af:note="1"/>'))
        .when(k % 43 == 2, F.concat(F.lit("<!DOCTYPE x>"), "xml"))
        .when(k % 43 == 3, insert("stray"))
        .when(k % 43 == 4, insert('<bpmn:boundaryEvent id="z"/>'))
        .otherwise(F.col("xml")),
    )
    return process_files.parse_process_models(documents, EXTENSION).document_violations


# --- sinks --------------------------------------------------------------------


def _detector_sql(select: str) -> str:
    return with_(DETECTOR_SQL, select, recursive=True)


@query(
    "write_observation_log",
    _detector_sql(
        """select c.event_id, c.seq, coalesce(a.alert_id, '') as alert_id
           from committed c left join alerts a on a.tenant_id = c.tenant_id and a.event_id = c.event_id"""
    ),
)
def write_observation_log(spark, sf_dir):
    path = new_table_path(spark, "log")
    rows = completed_movements(spark, sf_dir)
    committed = d.committed_windows(rows, baselines(spark), CONFIG)
    alerts = d.detect_congestion(rows, baselines(spark), CONFIG)
    rows = cut(sinks.observation_log(committed, alerts))
    sinks.write_observation_log(rows.filter("seq % 2 = 0"), path)
    for _ in range(2):  # the second and third write meet stored rows
        sinks.write_observation_log(rows, path)
    return spark.read.parquet(path).select(
        "event_id", "seq", F.coalesce("alert.alert_id", F.lit("")).alias("alert_id")
    )


@query(
    "write_alerts",
    _detector_sql(
        "select alert_id, tenant_id, aisle, workflow_id, run_id, threshold_seconds from alerts"
    ),
)
def write_alerts(spark, sf_dir):
    path = new_table_path(spark, "alerts")
    alerts = cut(d.detect_congestion(completed_movements(spark, sf_dir), baselines(spark), CONFIG))
    for _ in range(2):
        sinks.write_alerts(alerts, path)
    return spark.read.parquet(path).select(
        "alert_id", "tenant_id", "aisle", "workflow_id", "run_id", "threshold_seconds"
    )


@query(
    "write_receipts",
    with_(RECEIPTS_SQL, "select distinct tenant_id, workflow_id, run_id, task_id from receipts"),
)
def write_receipts(spark, sf_dir):
    path = new_table_path(spark, "receipts")
    rows = stored.receipts(spark, sf_dir)
    for part in (rows.filter("task_id < 'pick_03'"), rows, rows):
        sinks.write_receipts(part, path, stored.RECEIPT_ARRIVAL)
    return spark.read.parquet(path).select(*receipts.RECEIPT_KEY)


@query(
    "write_reroutes",
    with_(
        OUTBOX_SQL,
        """select alert_id, tenant_id, site_id, workflow_id, run_id, aisle from chosen""",
    ),
)
def write_reroutes(spark, sf_dir):
    path = new_table_path(spark, "reroutes")
    scoped = outbox.dispatch_scope(stored.alerts(spark, sf_dir), stored.tokens(spark))
    sinks.write_reroutes(outbox.pending_top_k(scoped, stored.now()), path)
    return spark.read.schema(", ".join(f"{c} string" for c in sinks.REROUTE_FIELDS)).json(path)


# --- stream -------------------------------------------------------------------

# events span January 2024: three arrival slices, each consumed by its own run
SLICES = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


@query(
    "detect_congestion_stream",
    _detector_sql(
        """select c.event_id, coalesce(a.alert_id, '') as alert_id,
                  coalesce(round(a.mean_seconds, 6), -1) as mean_seconds
           from committed c left join alerts a on a.tenant_id = c.tenant_id and a.event_id = c.event_id"""
    ),
)
def detect_congestion_stream(spark, sf_dir):
    """Three slices of arrivals, the stream restarted from its checkpoint for each."""
    source, log, state = (new_table_path(spark, n) for n in ("arrivals", "log", "state"))
    rows = completed_movements(spark, sf_dir)
    at = F.col("received_at")
    first, second = (F.expr(f"timestamp_ntz '{s}'") for s in SLICES)
    stream.use_state_store(spark)
    for part in (at < first, (at >= first) & (at < second), at >= second):
        rows.filter(part).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(rows.schema).parquet(source)
        out = stream.detect_congestion_stream(arrivals, baselines(spark), CONFIG)
        stream.run_to_log(out, log, state)
    return spark.read.parquet(log).select(
        "event_id",
        F.coalesce("alert.alert_id", F.lit("")).alias("alert_id"),
        F.coalesce(F.round("alert.mean_seconds", 6), F.lit(-1.0)).alias("mean_seconds"),
    )
