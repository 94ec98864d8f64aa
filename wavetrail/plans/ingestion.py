"""Queries of span ingest over exports derived from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetrail.operators import detector, ingest
from wavetrail.plans.exports import SPANS_SQL, exports, tokens
from wavetrail.plans.movements import BASELINES_SQL, baselines, with_
from wavetrail.plans.registry import query

POS = "export_id, rs_pos, ss_pos, sp_pos"


def _sql(select: str) -> str:
    return with_(SPANS_SQL, select)


def _decoded(spark, sf_dir) -> DataFrame:
    accepted = ingest.accepted_exports(exports(spark, sf_dir), tokens(spark))
    return ingest.decode_spans(ingest.flatten_spans(accepted))


EXPORT_STATUS = """case when n_keys <> 1 or unknown_key then 'unauthenticated'
                        when export_spans > 1000 then 'resource_exhausted' else 'ok' end"""


@query(
    "authenticate_exports",
    _sql(
        """select distinct export_id,
                  case when n_keys = 1 and not unknown_key then tenant_id else '' end as tenant_id
           from spans"""
    ),
)
def authenticate_exports(spark, sf_dir):
    rows = ingest.authenticate_exports(exports(spark, sf_dir), tokens(spark))
    return rows.select("export_id", F.coalesce("tenant_id", F.lit("")).alias("tenant_id"))


@query(
    "cap_export_size",
    _sql(f"select distinct export_id, export_spans as n_spans, {EXPORT_STATUS} as status from spans"),
)
def cap_export_size(spark, sf_dir):
    rows = ingest.export_status(ingest.authenticate_exports(exports(spark, sf_dir), tokens(spark)))
    return rows.select("export_id", ingest.span_count().cast("long").alias("n_spans"), "status")


@query("flatten_spans", _sql(f"select {POS}, is_movement from spans"))
def flatten_spans(spark, sf_dir):
    rows = ingest.flatten_spans(exports(spark, sf_dir))
    return _long_positions(rows).select(
        *ingest.SPAN_POSITION, (F.col("name") == ingest.MOVEMENT_SPAN).alias("is_movement")
    )


def _long_positions(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "rs_pos": F.col("rs_pos").cast("long"),
            "ss_pos": F.col("ss_pos").cast("int"),
            "sp_pos": F.col("sp_pos").cast("long"),
        }
    )


@query("filter_movement_spans", _sql(f"select {POS} from spans where is_movement"))
def filter_movement_spans(spark, sf_dir):
    rows = ingest.filter_movement_spans(ingest.flatten_spans(exports(spark, sf_dir)))
    return _long_positions(rows).select(*ingest.SPAN_POSITION)


@query(
    "extract_attributes",
    _sql(
        f"""select {POS}, case when has_duplicate then 8 else 7 end as n_relevant,
                   case when has_duplicate or has_bool then '' else
                     concat_ws('|', tenant_attr, site_id, aisle, task_id, wave_id, workflow_id, run_id)
                   end as attribute_values
            from looked_at"""
    ),
)
def extract_attributes(spark, sf_dir):
    keys = (ingest.TENANT, ingest.SITE, ingest.AISLE, ingest.TASK, ingest.WAVE,
            ingest.WORKFLOW, ingest.RUN)
    joined = F.concat_ws("|", *[ingest.attribute(k) for k in keys])
    return _long_positions(_decoded(spark, sf_dir)).select(
        *ingest.SPAN_POSITION,
        F.size("relevant").alias("n_relevant"),
        F.when(F.col("attrs").isNull(), "").otherwise(joined).alias("attribute_values"),
    )


# query name -> the rule whose first-failing spans it lists
RULE_QUERIES = {
    "reject_duplicate_attribute": "duplicate_attribute",
    "reject_non_string_attribute": "non_string_attribute",
    "match_tenant": "tenant_mismatch",
    "validate_span_ids": "invalid_id",
    "match_workflow": "workflow_mismatch",
    "validate_run_id": "invalid_run_id",
    "reject_failed_span": "failed_span",
    "validate_duration": "invalid_duration",
    "validate_freshness": "stale_or_future",
    "validate_trace_ids": "invalid_trace_ids",
}


def _rule_query(name: str, reason: str) -> None:
    sql = _sql(f"select {POS}, tenant_id from decoded where reject_reason = '{reason}'")

    @query(name, sql)
    def rejected(spark, sf_dir):
        rows = ingest.span_rejects(_decoded(spark, sf_dir), reason)
        return _long_positions(rows).drop("reject_reason")


for _name, _reason in RULE_QUERIES.items():
    _rule_query(_name, _reason)


@query(
    "span_rejects",
    _sql(f"select {POS}, tenant_id, reject_reason from decoded where reject_reason is not null"),
)
def span_rejects(spark, sf_dir):
    return _long_positions(ingest.span_rejects(_decoded(spark, sf_dir)))


EVENT_SQL = """sha256(concat(strlen(tenant_id), ':', tenant_id, strlen(workflow_id), ':', workflow_id,
                  strlen(run_id), ':', run_id, strlen(task_id), ':', task_id))"""


@query(
    "derive_event_id",
    _sql(f"select {POS}, {EVENT_SQL} as event_id from decoded where reject_reason is null"),
)
def derive_event_id(spark, sf_dir):
    valid = _decoded(spark, sf_dir).filter("reject_reason is null")
    rows = ingest.derive_event_id(valid)
    return _long_positions(rows).select(*ingest.SPAN_POSITION, "event_id")


@query(
    "project_observation",
    _sql(
        f"""select {POS}, tenant_id, site_id, aisle, workflow_id, run_id, task_id,
                   {EVENT_SQL} as event_id, round(took, 6) as seconds, -end_offset as age_seconds
            from decoded where reject_reason is null"""
    ),
)
def project_observation(spark, sf_dir):
    rows = ingest.project_observation(_decoded(spark, sf_dir))
    age = F.unix_micros("received_at") - F.unix_micros("observed_at")
    return _long_positions(rows).select(
        *ingest.SPAN_POSITION, "tenant_id", "site_id", "aisle", "workflow_id", "run_id", "task_id",
        "event_id", F.round("seconds", 6).alias("seconds"),
        F.floor(age / 1_000_000).cast("long").alias("age_seconds"),
    )


@query(
    "partial_success",
    with_(
        SPANS_SQL + "," + BASELINES_SQL,
        """select export_id, count(*) as rejected_spans,
                  'some spans were refused, their reasons are in span_rejects' as error_message
           from decoded left join baselines b using (tenant_id, site_id, aisle)
           where reject_reason is not null or b.mean is null
           group by export_id""",
    ),
)
def partial_success(spark, sf_dir):
    known = baselines(spark)
    return ingest.partial_success(_decoded(spark, sf_dir), lambda rows: detector.entry_reason(rows, known))
