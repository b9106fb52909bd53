"""Registered queries of the payload readers, over payloads that are built from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.common import Registry, r, second, tidy
from tracemill.plans.records import EVENTS_SQL, _components
from tracemill.sources import otlp

registry = Registry()


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces of each user and hour as one JSON batch; every fifth user sends no metadata."""
    ev = _components(spark, sf_dir)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    component = text('{"component_type":"step","event_type":"', F.col("event_type"), '","timestamp":"', F.col("event_ts").cast("string"), '","data":', F.col("data"), "}")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", component.alias("c")))), lambda x: x["c"]), ",")
    made = ev.groupBy("user_id", "trace_id").agg(F.max("task_id").alias("task_id"), F.max("signature_key_id").alias("key"), F.date_trunc("hour", F.max("event_ts")).alias("hour"), listed.alias("components"))
    trace = text('{"event_type":"complete_trace","trace":{"trace_id":"', F.col("trace_id"), '","task_id":"', F.col("task_id"), '","signature":"sig","signature_key_id":"', F.col("key"), '","components":[', F.col("components"), "]}}")
    whole = made.groupBy("user_id", "hour").agg(F.array_join(F.sort_array(F.collect_list(trace)), ",").alias("events"))
    north = ((F.col("user_id") % 100) / 8).cast("string")
    meta = F.when(F.col("user_id") % 5 > 0, text(',"correlation_metadata":{"deployment_region":"eu","user_location":"Town","user_latitude":', north, ',"user_longitude":-', north, "}")).otherwise("")
    return whole.select(text('{"events":[', F.col("events"), '],"batch_timestamp":"2024-01-31","consent_timestamp":"2024-01-01"', meta, "}").alias("value"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.parse_trace_batches(_envelopes(spark, sf_dir))


_CELL = "round_even((user_id % 100) / 8.0 / 0.5, 0) * 0.5"
registry.queries["parse_trace_batches"] = lambda spark, d: tidy(_traces(spark, d).select("trace_id", "task_id", "signature_key_id", "consent_timestamp", "trace_level", "deployment_region", "user_latitude", "user_longitude", F.size("components").alias("components")))
registry.sql["parse_trace_batches"] = f"""with ev as ({EVENTS_SQL}) select trace_id, max(task_id) as task_id, max(signature_key_id) as signature_key_id, '2024-01-01' as consent_timestamp, 'generic' as trace_level, case when max(user_id) % 5 > 0 then 'eu' end as deployment_region,
    case when max(user_id) % 5 > 0 then {r(_CELL.replace('user_id', 'max(user_id)'))} end as user_latitude, case when max(user_id) % 5 > 0 then {r('-' + _CELL.replace('user_id', 'max(user_id)'))} end as user_longitude, count(*) as components from ev group by trace_id"""
registry.queries["explode_components"] = lambda spark, d: tidy(otlp.explode_components(_traces(spark, d)).select("trace_id", "component_type", "event_type", "i", F.get_json_object("data", "$.thought_type").alias("thought_type")))
registry.sql["explode_components"] = f"with ev as ({EVENTS_SQL}) select trace_id, 'step' as component_type, event_type, row_number() over (partition by trace_id order by i) - 1 as i, data ->> '$.thought_type' as thought_type from ev"


def _nanos(ts: str) -> Column:
    return (F.unix_micros(ts) * 1000).cast("string")


def _attribute(key: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))


def _payload(outer: str, inner: str, items: str, item: Column) -> Column:
    """One item as its sender nests it."""
    scope = F.struct(F.array(item).alias(items))
    return F.to_json(F.struct(F.array(F.struct(F.array(scope).alias(inner))).alias(outer)))


def _metrics(points: DataFrame) -> DataFrame:
    """Each point as a gauge or a sum, whole numbers as text, every seventh without a number."""
    whole, none = F.col("metric") == "requests.total", F.col("event_id") % 7 == 0
    number = F.struct(F.when(~none & ~whole, F.col("value")).alias("asDouble"), F.when(~none & whole, F.col("value").cast("long").cast("string")).alias("asInt"), _nanos("ts").alias("timeUnixNano"), F.array(_attribute("service", "stringValue", F.col("service"))).alias("attributes"))
    points_ = F.struct(F.array(number).alias("dataPoints"))
    metric = F.struct(F.col("metric").alias("name"), F.when(whole, points_).alias("sum"), F.when(~whole, points_).alias("gauge"))
    return points.select(_payload("resourceMetrics", "scopeMetrics", "metrics", metric).alias("value"))


registry.on_derived(
    "flatten_otlp_metrics", "points",
    lambda p: otlp.flatten_otlp_metrics(_metrics(p)).groupBy("name", F.element_at("labels", "service").alias("service")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("newest")),
    f"select metric as name, service, count(*) as n, {r('sum(value)')} as total, {second('max(ts)')} as newest from points where event_id % 7 <> 0 group by all",
)


def _spans(spans: DataFrame) -> DataFrame:
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").cast("string").alias("spanId"), F.when(F.col("span_id") % 3 > 0, (F.col("span_id") - 1).cast("string")).otherwise("").alias("parentSpanId"), F.col("service").alias("name"), _nanos("started").alias("startTimeUnixNano"),
        ((F.unix_micros("started") + F.col("duration_us")) * 1000).cast("string").alias("endTimeUnixNano"), F.struct(F.when(F.col("status") != "OK", F.col("status")).alias("code")).alias("status"),
    )
    return spans.select(_payload("resourceSpans", "scopeSpans", "spans", span).alias("value"))


registry.on_derived(
    "flatten_otlp_spans", "spans",
    lambda s: otlp.flatten_otlp_spans(_spans(s)).select(F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.col("parentSpanId").alias("parent"), "name", "started", "ended", "status"),
    f"select trace_id, cast(span_id as varchar) as span_id, case when span_id % 3 > 0 then cast(span_id - 1 as varchar) end as parent, service as name, {second('started')} as started, {second('started + to_microseconds(duration_us)')} as ended, coalesce(status, 'OK') as status from spans",
)


def _records(logs: DataFrame) -> DataFrame:
    number = F.when(F.col("level") == "CRITICAL", 21).when(F.col("level") == "ERROR", 17).when(F.col("level") == "WARNING", 13).otherwise(F.when(F.col("log_id") % 2 == 0, 9).otherwise(3))
    record = F.struct(_nanos("ts").alias("timeUnixNano"), number.alias("severityNumber"), F.struct(F.col("message").alias("stringValue")).alias("body"))
    return logs.select(_payload("resourceLogs", "scopeLogs", "logRecords", record).alias("value"))


registry.on_derived("flatten_otlp_logs", "logs", lambda x: otlp.flatten_otlp_logs(_records(x)).groupBy("level", "message").agg(F.count("*").alias("n"), F.min("ts").alias("oldest")), f"select level, message, count(*) as n, {second('min(ts)')} as oldest from logs group by all")
