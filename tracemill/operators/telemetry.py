"""Rollups of traces, metrics, logs, spans and status checks, and alert rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.ingest import TRACE_TYPES
from tracemill.operators.windows import lagged, moment, trailing

#: fixed value: providers behind the proxy
LLM_PROVIDERS = ("openrouter", "groq", "together", "openai")
GAP_SECONDS = 300
#: fixed values: checks of a trace
CHECKS = ("conscience", "entropy", "coherence", "optimization_veto", "epistemic_humility")
#: fixed values: what messages of the billing service are about, in the order in which they are tried
BILLING_CLASSES = {
    "Credit Checks": "/v1/billing/credits/check",
    "LLM Usage": "/v1/billing/litellm/usage",
    "Charges": "/v1/billing/charges",
    "Integrity": "/v1/integrity",
}
BAD_LEVELS = ("ERROR", "CRITICAL")
#: the service whose messages are classified and watched, unless a caller names another
BILLING = "billing"


def bucket(size: str, ts: str = "ts") -> Column:
    """Start of the bucket of ``size`` ("5 minutes", "1 hour") that a time falls into."""
    return F.window(ts, size)["start"]


def _pass(flag: str) -> Column:
    return F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))


def traces_hourly(tr: DataFrame) -> DataFrame:
    """Hourly summary of verified traces; a check that was not run counts as failed in the rates."""
    is_ = lambda column, value: F.count_if(F.col(column) == value)
    mean, least = (lambda column, name, f=f: f(column).alias(name) for f in (F.avg, F.min))
    verified = tr.where("signature_verified")
    return verified.groupBy(bucket("1 hour").alias("hour")).agg(
        F.count("*").alias("trace_count"),
        F.countDistinct("agent_id_hash").alias("unique_agents"),
        *[is_("trace_type", t).alias(f"{t.lower()}_count") for t in TRACE_TYPES],
        mean("csdma", "avg_csdma_plausibility"),
        least("csdma", "min_csdma_plausibility"),
        mean("dsdma", "avg_dsdma_alignment"),
        least("dsdma", "min_dsdma_alignment"),
        mean("entropy", "avg_entropy_level"),
        mean("coherence", "avg_coherence_level"),
        *[_pass(f"{c}_passed").alias(f"{c}_pass_rate") for c in CHECKS],
        F.count_if("action_was_overridden").alias("overrides_count"),
        *[is_("selected_action", a).alias(f"{a.lower()}_count") for a in ("SPEAK", "DEFER", "PONDER", "TASK_COMPLETE")],
        F.sum("tokens_total").alias("total_tokens"),
        F.sum("cost_cents").alias("total_cost_cents"),
        F.sum("llm_calls").alias("total_llm_calls"),
        mean("processing_ms", "avg_processing_ms"),
        F.max("processing_ms").alias("max_processing_ms"),
    )


def metrics_rollup(points: DataFrame, size: str) -> DataFrame:
    return points.groupBy("agent", "metric", bucket(size).alias("bucket")).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def metrics_minute(points: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    return metrics_rollup(trailing(points, as_of, hours=hours), "1 minute")


def uptime(checks: DataFrame, size: str) -> DataFrame:
    up = 100.0 * F.count_if(F.col("status") == "operational") / F.count("*")
    return checks.groupBy("region", "service", "provider", bucket(size).alias("bucket")).agg(up.alias("uptime"), F.avg("latency_ms").alias("avg_ms"), F.max("latency_ms").alias("max_ms"), F.count("*").alias("n"), F.count_if(F.col("status") == "outage").alias("outages"))


def uptime_history(daily: DataFrame) -> DataFrame:
    """Mean uptime of every day over all, and in each region."""
    return daily.groupingSets([["bucket"], ["bucket", "region"]], "bucket", "region").agg(F.avg("uptime").alias("uptime"), F.sum("n").alias("n"))


def latest_status(checks: DataFrame) -> DataFrame:
    """The newest check of each service."""
    newest = F.max_by(F.struct("status", "latency_ms", "ts"), F.struct("ts", "event_id"))
    return checks.groupBy("region", "service", "provider").agg(newest.alias("s")).select("region", "service", "provider", "s.status", "s.latency_ms", "s.ts")


def region_status(latest: DataFrame) -> DataFrame:
    """The worst of a region's services.  The proxy is as bad as the best of its model providers."""
    of_proxy = (F.col("service") == "proxy") & F.col("provider").isin(*LLM_PROVIDERS)
    all_ = lambda *bad: F.coalesce(F.every(F.when(of_proxy, F.coalesce(F.col("status").isin(*bad), F.lit(False)))), F.lit(False))
    other = lambda bad: F.coalesce(F.bool_or((F.col("service") != "proxy") & (F.col("status") == bad)), F.lit(False))
    flags = latest.groupBy("region").agg(
        other("outage").alias("out"), other("degraded").alias("slow"), all_("outage").alias("proxy_out"), all_("degraded", "outage").alias("proxy_slow"),
        F.countDistinct("service").alias("services"),
    )
    status = F.when(F.col("out") | F.col("proxy_out"), "outage").when(F.col("slow") | F.col("proxy_slow"), "degraded").otherwise("operational")
    return flags.select("region", status.alias("status"), "services")


def counter_rate(points: DataFrame, name: str, bits: int = 32) -> DataFrame:
    """Growth a second of a counter; after a reset the value itself, after a long gap none.

    An agent's points are compared in slices of 2**bits microseconds (about an hour), so
    one that sends most of all points is not one task.
    """
    rows = points.where(F.col("metric") == name).select("agent", "event_id", "ts", "value")
    micros = F.unix_micros("ts")
    step = lagged(rows, "agent", micros, ["event_id"], ["value", "ts"], bits, levels=1)
    seconds = (micros - F.unix_micros("before.ts")) / 1e6
    grown = F.when(F.col("value") >= F.col("before.value"), F.col("value") - F.col("before.value")).otherwise(F.col("value"))
    rate = F.when((seconds <= 0) | (seconds >= GAP_SECONDS), 0.0).otherwise(grown / seconds)
    return step.where("before.value is not null").select("agent", "event_id", "ts", rate.alias("rate"))


def _whole(value: Column) -> Column:
    return F.round(value).cast("long")


def agent_overview(points: DataFrame) -> DataFrame:
    """One row for each agent from the newest value of each of its series (metric and labels): services, totals, state."""
    newest = points.groupBy("agent", "metric", "service").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    of = lambda name: F.max(F.when(F.col("metric") == name, F.col("v")))
    services = F.countDistinct(F.when(F.col("metric").startswith("service."), F.col("service")))
    return newest.groupBy("agent").agg(
        services.alias("services"),
        _whole(of("requests.total")).alias("total_requests"),
        _whole(of("errors.total")).alias("total_errors"),
        of("system.error_rate").alias("error_rate"),
        _whole(of("system.uptime")).alias("uptime_seconds"),
        _whole(of("system.healthy")).alias("healthy"),
    )


def value_at_latest(points: DataFrame, name: str) -> DataFrame:
    """The sum of all values of a metric at its newest time; the newest time is found first, one row."""
    rows = points.where(F.col("metric") == name).select("ts", "value")
    newest = rows.agg(F.max("ts").alias("ts"))
    return rows.join(F.broadcast(newest), "ts", "left_semi").agg(_whole(F.sum("value")).alias("value"), F.max("ts").alias("ts"))


def service_health(points: DataFrame, agent: str | None = None) -> DataFrame:
    """Requests, errors, error rate, uptime and health of each agent's services; series without a service are left out."""
    rows = points.where(F.col("metric").startswith("service.") & F.col("service").isNotNull())
    rows = rows if agent is None else rows.where(F.col("agent") == agent)
    of = lambda name, other=None: F.when(F.col("metric") == f"service.{name}", F.col("value")).otherwise(F.lit(other).cast("double"))
    return rows.groupBy(F.concat_ws("/", "agent", "service").alias("service")).agg(
        _whole(F.sum(of("requests", 0))).alias("total_requests"),
        _whole(F.sum(of("errors", 0))).alias("total_errors"),
        F.avg(of("error_rate")).alias("error_rate"),
        _whole(F.avg(of("uptime"))).alias("uptime_seconds"),
        _whole(F.max(of("healthy", 0))).alias("healthy"),
    )


def series_by_label(points: DataFrame, name: str, agent: str | None = None) -> DataFrame:
    """The series of a metric: (time, agent/service, value), in the order of time; without a service it has no name."""
    rows = points.where(F.col("metric") == name)
    rows = rows if agent is None else rows.where(F.col("agent") == agent)
    return rows.select("ts", F.concat("agent", F.lit("/"), "service").alias("metric"), "value").orderBy("ts", "metric", "value")


def error_rate_series(points: DataFrame) -> DataFrame:
    """Each agent's error rate at every time that has one."""
    return points.where("metric = 'system.error_rate'").groupBy("ts", "agent").agg(F.avg("value").alias("value")).orderBy("ts", "agent")


def log_volume(logs: DataFrame, by: list[str], size: str = "5 minutes") -> DataFrame:
    return logs.groupBy(bucket(size).alias("bucket"), *by).agg(F.count("*").alias("n"))


def _class(message: Column, classes: dict[str, str]) -> Column:
    found = F.lit("Other")
    for name, part in reversed(classes.items()):
        found = F.when(message.contains(part), name).otherwise(found)
    return found


def _billing(logs: DataFrame, service: str) -> DataFrame:
    """Messages of the billing service but its health checks; a line without a message is none."""
    return logs.where((F.col("service") == service) & ~F.col("message").contains("/health"))


def classify_messages(logs: DataFrame, service: str = BILLING) -> DataFrame:
    """Messages of the billing service by class in steps of five minutes."""
    rows = _billing(logs, service)
    return rows.groupBy(bucket("5 minutes").alias("time"), _class(F.col("message"), BILLING_CLASSES).alias("metric")).agg(F.count("*").alias("value"))


def billing_operations(logs: DataFrame, n: int = 100, service: str = BILLING) -> DataFrame:
    """The newest operations of the billing service, sign-ins among them, with what they say."""
    one = {name.removesuffix("s") if name != "LLM Usage" else name: part for name, part in BILLING_CLASSES.items()} | {"OAuth": "oauth"}
    newest = _billing(logs, service).orderBy(F.desc("ts"), F.desc("log_id")).limit(n)
    return newest.select("log_id", "ts", "level", _class(F.col("message"), one).alias("operation"), F.substring("message", 1, 150).alias("details"))


def trailing_counts(logs: DataFrame, as_of: str, hours: float = 24, short_hours: float = 1, service: str = BILLING) -> DataFrame:
    """What the panels count up to ``as_of``: most over ``hours``, some over the last ``short_hours``; the start is no part of a window."""
    since = lambda h: F.col("ts") > moment(as_of) - F.make_dt_interval(secs=F.lit(int(h * 3600)))
    bad, late, mine = F.col("level").isin(*BAD_LEVELS), since(short_hours), F.col("service") == service
    calls = {"credit_checks": "Credit Checks", "llm_usage": "LLM Usage", "charges": "Charges"}
    return logs.where(since(hours) & (F.col("ts") <= moment(as_of))).agg(
        F.count("*").alias("logs"),
        F.count_if(bad).alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"),
        F.countDistinct(F.when(late, F.col("service"))).alias("active_services"),
        F.count_if(bad & late).alias("recent_errors"),
        F.countDistinct(F.when(bad, F.col("service"))).alias("services_with_errors"),
        *[F.count_if(mine & F.col("message").contains(BILLING_CLASSES[c])).alias(name) for name, c in calls.items()],
        F.count_if(mine & bad).alias("billing_errors"),
    )


def recent(logs: DataFrame, n: int) -> DataFrame:
    return logs.orderBy(F.desc("ts"), F.desc("log_id")).limit(n)


def errors_by_service(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("level").isin("ERROR", "CRITICAL")).groupBy("service").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service")


def span_stats(spans: DataFrame) -> DataFrame:
    ms = F.col("duration_us") / 1000
    return spans.groupBy("service").agg(F.countDistinct("trace_id").alias("traces"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"), F.count_if(F.col("status") != "OK").alias("failures"))


def alert_rules(logs: DataFrame, minutes: int = 5, service: str = BILLING) -> DataFrame:
    """The rules that fire in windows of ``minutes``, one starting each minute: any error, many errors, any error of the billing service."""
    bad = logs.where(F.col("level").isin(*BAD_LEVELS))
    of_billing = F.count_if(F.col("service") == service)
    counts = bad.groupBy(F.window("ts", f"{minutes} minutes", "1 minute").alias("w")).agg(F.count("*").alias("errors"), of_billing.alias("billing"))
    rules = F.array_compact(F.array(F.lit("errors"), F.when(F.col("errors") > 5, F.lit("many_errors")), F.when(F.col("billing") > 0, F.lit("billing"))))
    return counts.select(F.col("w.start").alias("start"), "errors", "billing", F.explode(rules).alias("rule"))


def agent_health(configs: DataFrame, points: DataFrame, spans: DataFrame, logs: DataFrame, failures: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Four trailing counts for each configured agent, each aggregated before it is joined, and what follows.

    Healthy is who was collected within ``minutes`` and had no failure that stands open;
    degraded who was collected within three times as long; all others are unhealthy.
    """
    since = lambda df, ts, times=1: df.where((F.col(ts) > moment(as_of) - F.make_dt_interval(mins=F.lit(times * minutes))) & (F.col(ts) <= moment(as_of)))
    n = lambda df, name: df.groupBy("agent").agg(F.count("*").alias(name))
    open_ = since(failures, "ts").where(F.col("resolved_at").isNull() & F.col("source").startswith("agent:")).withColumn("agent", F.substring("source", 7, 1 << 20))
    names = ["recent_metric_count", "recent_trace_count", "recent_log_count", "recent_error_count"]
    whole = configs
    for part, name in zip((since(points, "ts"), since(spans, "started"), since(logs, "ts"), open_), names, strict=True):
        whole = whole.join(n(part, name), "agent", "left")
    whole = whole.na.fill(0, names)
    fresh = lambda times: F.col("last_collection") > moment(as_of) - F.make_dt_interval(mins=F.lit(times * minutes))
    status = F.when(fresh(1) & (F.col("recent_error_count") == 0), "healthy").when(fresh(3), "degraded").otherwise("unhealthy")
    return whole.withColumn("health_status", status)


def span_durations(spans: DataFrame) -> DataFrame:
    """Spans with their end and length in milliseconds."""
    ended = F.timestamp_micros(F.unix_micros("started") + F.col("duration_us"))
    return spans.withColumn("ended", ended).withColumn("duration_ms", (F.unix_micros("ended") - F.unix_micros("started")) / 1000)
