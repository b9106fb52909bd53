"""Registered telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import telemetry as T
from tracemill.operators.stores import Rollup
from tracemill.plans.common import Registry, r, second, tidy
from tracemill.sources.adapter import AS_OF, derived, with_derived

registry = Registry()
_BAD = "level in ('ERROR', 'CRITICAL')"


def _avg(c: str) -> str:
    return r(f"avg({c})")


def _rate(c: str) -> str:
    return r(f"avg(case when {c} then 1.0 else 0.0 end)")


def _bucket(size: str, ts: str = "ts") -> str:
    return second(f"time_bucket(interval '{size}', {ts})")


_HOURLY = ", ".join(
    ["count(*) as trace_count", "count(distinct agent_id_hash) as unique_agents"]
    + [f"count(*) filter (where trace_type = '{t}') as {t.lower()}_count" for t in ("VERIFY_IDENTITY", "VALIDATE_INTEGRITY", "EVALUATE_RESILIENCE", "ACCEPT_INCOMPLETENESS", "EXPRESS_GRATITUDE")]
    + [f"{_avg('csdma')} as avg_csdma_plausibility", f"{r('min(csdma)')} as min_csdma_plausibility", f"{_avg('dsdma')} as avg_dsdma_alignment", f"{r('min(dsdma)')} as min_dsdma_alignment"]
    + [f"{_avg('entropy')} as avg_entropy_level", f"{_avg('coherence')} as avg_coherence_level"]
    + [f"{_rate(c + '_passed')} as {c}_pass_rate" for c in ("conscience", "entropy", "coherence", "optimization_veto", "epistemic_humility")]
    + ["count(*) filter (where action_was_overridden = true) as overrides_count"]
    + [f"count(*) filter (where selected_action = '{a}') as {a.lower()}_count" for a in ("SPEAK", "DEFER", "PONDER", "TASK_COMPLETE")]
    + ["cast(sum(tokens_total) as bigint) as total_tokens", f"{r('sum(cost_cents)')} as total_cost_cents", "cast(sum(llm_calls) as bigint) as total_llm_calls"]
    + [f"{_avg('processing_ms')} as avg_processing_ms", "max(processing_ms) as max_processing_ms"]
)
registry.on_traces("traces_hourly", T.traces_hourly, f"select {_bucket('1 hour')} as hour, {_HOURLY} from tr where signature_verified = true group by {_bucket('1 hour')}")
_ROLL = f"{_avg('value')} as avg, {r('min(value)')} as min, {r('max(value)')} as max, count(*) as n"
on = registry.on_derived
for name, size in (("metrics_hourly", "1 hour"), ("metrics_daily", "1 day")):
    on(name, "points", lambda p, size=size: T.metrics_rollup(p, size), f"select agent, metric, {_bucket(size)} as bucket, {_ROLL} from points group by agent, metric, {_bucket(size)}")
_POINTS = Rollup(keys=("agent", "metric"), values=("value",), distinct=("service",))
on(
    "metrics_daily_merged",
    "points",
    lambda p: _POINTS.finished(_POINTS.merged(_POINTS.states(p), "1 day")),
    f"select agent, metric, {_bucket('1 day')} as bucket, count(*) as n, {_avg('value')} as avg_value, {r('sum(value)')} as sum_value, {r('min(value)')} as min_value, {r('max(value)')} as max_value, count(distinct service) as distinct_service from points group by agent, metric, {_bucket('1 day')}",
)
on("metrics_minute", "points", lambda p: T.metrics_minute(p, AS_OF, 72), f"select agent, metric, {_bucket('1 minute')} as bucket, {_ROLL} from points where ts >= timestamp '{AS_OF}' - interval 72 hour and ts <= timestamp '{AS_OF}' group by agent, metric, {_bucket('1 minute')}")
_UP = "select region, service, provider, {b} as bucket, {u} as uptime, {a} as avg_ms, {m} as max_ms, count(*) as n, count(*) filter (where status = 'outage') as outages from checks group by region, service, provider, {b}"
for name, size in (("uptime_hourly", "1 hour"), ("uptime_daily", "1 day")):
    on(name, "checks", lambda c, size=size: T.uptime(c, size), _UP.format(b=_bucket(size), u=r("100.0 * count(*) filter (status = 'operational') / count(*)"), a=_avg("latency_ms"), m=r("max(latency_ms)")))
on(
    "uptime_history",
    "checks",
    lambda c: T.uptime_history(T.uptime(c, "1 day")),
    f"with d as (select region, service, provider, {_bucket('1 day')} as bucket, 100.0 * count(*) filter (status = 'operational') / count(*) as uptime, count(*) as n from checks group by all) select bucket, region, {_avg('uptime')} as uptime, cast(sum(n) as bigint) as n from d group by grouping sets ((bucket), (bucket, region))",
)
_LATEST = "select region, service, provider, arg_max({s: status, l: latency_ms, t: ts}, (ts, event_id)) as s from checks group by all"
on("latest_status", "checks", T.latest_status, f"select region, service, provider, s.s as status, {r('s.l')} as latency_ms, {second('s.t')} as ts from ({_LATEST}) l")
on(
    "region_status",
    "checks",
    lambda c: T.region_status(T.latest_status(c)),
    f"""with l as (select region, service, provider in ('openrouter', 'groq', 'together', 'openai') as llm, s.s as status from ({_LATEST}) x),
             p as (select region, case when bool_and(status = 'outage') then 'outage' when bool_and(status in ('degraded', 'outage')) then 'degraded' else 'operational' end as status from l where service = 'proxy' and llm group by region),
             a as (select region, status from l where service <> 'proxy' union all select region, status from p)
        select region, case when bool_or(a.status = 'outage') then 'outage' when bool_or(a.status = 'degraded') then 'degraded' else 'operational' end as status, any_value(services) as services from a join (select region, count(distinct service) as services from l group by region) n using (region) group by region""",
)
on(
    "counter_rate",
    "points",
    lambda p: T.counter_rate(p, "requests.total"),
    f"""with l as (select agent, event_id, ts, value, lag(value) over w as before, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6 as seconds from points where metric = 'requests.total' window w as (partition by agent order by ts, event_id))
        select agent, event_id, {second('ts')} as ts, {r('case when seconds <= 0 or seconds >= 300 then 0 else (case when value >= before then value - before else value end) / seconds end')} as rate from l where before is not null""",
)
on(
    "agent_overview",
    "points",
    T.agent_overview,
    f"""with latest_metrics as (select agent, metric, value, service, row_number() over (partition by agent, metric, service order by ts desc, event_id desc) as rn from points)
        select agent, count(distinct case when metric like 'service.%' then service end) as services, round(max(case when metric = 'requests.total' then value end))::bigint as total_requests,
               round(max(case when metric = 'errors.total' then value end))::bigint as total_errors, {r("max(case when metric = 'system.error_rate' then value end)")} as error_rate,
               round(max(case when metric = 'system.uptime' then value end))::bigint as uptime_seconds, round(max(case when metric = 'system.healthy' then value end))::bigint as healthy
        from latest_metrics where rn = 1 group by agent""",
)
_DAYS = "date_trunc('day', ts)"  # so that many series have the newest time
on(
    "value_at_latest",
    "points",
    lambda p: T.value_at_latest(p.withColumn("ts", F.date_trunc("day", "ts")), "requests.total"),
    f"""select round(sum(value))::bigint as value, {second(f'max({_DAYS})')} as ts from points where metric = 'requests.total' and {_DAYS} = (select max({_DAYS}) from points where metric = 'requests.total')""",
)
on(
    "service_health",
    "points",
    T.service_health,
    f"""select agent || '/' || service as service, round(sum(case when metric = 'service.requests' then value else 0 end))::bigint as total_requests, round(sum(case when metric = 'service.errors' then value else 0 end))::bigint as total_errors,
               {r("avg(case when metric = 'service.error_rate' then value else null end)")} as error_rate, round(avg(case when metric = 'service.uptime' then value else null end))::bigint as uptime_seconds,
               round(max(case when metric = 'service.healthy' then value else 0 end))::bigint as healthy
        from points where metric like 'service.%' and service is not null group by agent, points.service""",
)
on("series_by_label", "points", lambda p: T.series_by_label(p, "service.requests"), f"select {second('ts')} as ts, agent || '/' || service as metric, {r('value')} as value from points where metric = 'service.requests'")
on("error_rate_series", "points", T.error_rate_series, f"select {second('ts')} as ts, agent, {_avg('value')} as value from points where metric = 'system.error_rate' group by points.ts, agent")
on("log_volume", "logs", lambda x: T.log_volume(x, ["service", "level"]), f"select {_bucket('5 minutes')} as bucket, service, level, count(*) as n from logs group by {_bucket('5 minutes')}, service, level")
on(
    "classify_messages",
    "logs",
    T.classify_messages,
    f"""select {_bucket('5 minutes')} as time, case when message like '%/v1/billing/credits/check%' then 'Credit Checks' when message like '%/v1/billing/litellm/usage%' then 'LLM Usage' when message like '%/v1/billing/charges%' then 'Charges'
               when message like '%/v1/integrity%' then 'Integrity' else 'Other' end as metric, count(*) as value from logs where service = 'billing' and message not like '%/health%' group by 1, 2""",
)
on(
    "billing_operations",
    "logs",
    T.billing_operations,
    f"""select log_id, {second('ts')} as ts, level, case when message like '%/v1/billing/credits/check%' then 'Credit Check' when message like '%/v1/billing/litellm/usage%' then 'LLM Usage' when message like '%/v1/billing/charges%' then 'Charge'
               when message like '%/v1/integrity%' then 'Integrity' when message like '%oauth%' then 'OAuth' else 'Other' end as operation, left(message, 150) as details
        from logs where service = 'billing' and message not like '%/health%' order by logs.ts desc, log_id desc limit 100""",
)
_SINCE = lambda hours: f"ts > timestamp '{AS_OF}' - interval {hours} hour"
on(
    "trailing_counts",
    "logs",
    lambda x: T.trailing_counts(x, AS_OF, 240, 48),
    f"""select count(*) as logs, count(*) filter ({_BAD}) as errors, count(*) filter (level = 'WARNING') as warnings, count(distinct service) filter ({_SINCE(48)}) as active_services, count(*) filter ({_BAD} and {_SINCE(48)}) as recent_errors,
               count(distinct service) filter ({_BAD}) as services_with_errors, count(*) filter (service = 'billing' and message like '%/v1/billing/credits/check%') as credit_checks,
               count(*) filter (service = 'billing' and message like '%/v1/billing/litellm/usage%') as llm_usage, count(*) filter (service = 'billing' and message like '%/v1/billing/charges%') as charges,
               count(*) filter (service = 'billing' and {_BAD}) as billing_errors from logs where {_SINCE(240)} and ts <= timestamp '{AS_OF}'""",
)
on("recent_logs", "logs", lambda x: T.recent(x, 100), f"select log_id, {second('ts')} as ts, service, level, message, agent from logs order by logs.ts desc, log_id desc limit 100")
on("errors_by_service", "logs", T.errors_by_service, f"select service, count(*) as n from logs where {_BAD} group by service")
on("span_stats", "spans", T.span_stats, f"select service, count(distinct trace_id) as traces, {_avg('duration_us / 1000')} as avg_ms, {r('max(duration_us / 1000)')} as max_ms, count(*) filter (status <> 'OK') as failures from spans group by service")
on("span_durations", "spans", T.span_durations, f"select trace_id, span_id, service, {second('started')} as started, duration_us, status, {second('started + to_microseconds(duration_us)')} as ended, {r('duration_us / 1000')} as duration_ms from spans")
on(
    "alert_rules",
    "logs",
    T.alert_rules,
    f"""with w as (select time_bucket(interval '1 minute', ts) - to_minutes(k) as start, service from logs, range(5) t(k) where {_BAD}),
             c as (select start, count(*) as errors, count(*) filter (service = 'billing') as billing from w group by start)
        select {second('start')} as start, errors, billing, 'errors' as rule from c union all select {second('start')}, errors, billing, 'many_errors' from c where errors > 5 union all select {second('start')}, errors, billing, 'billing' from c where billing > 0""",
)
_HEALTH = ("configs", "points", "spans", "logs", "failures")
registry.queries["agent_health"] = lambda spark, d: tidy(T.agent_health(*[derived(spark, d, t).withColumn("agent", F.concat(F.lit("agent"), F.substring("service", 4, 9))) if t == "spans" else derived(spark, d, t) for t in _HEALTH], AS_OF, 1440))
_DAY = lambda ts: f"{ts} > timestamp '{AS_OF}' - interval 1 day and {ts} <= timestamp '{AS_OF}'"
registry.sql["agent_health"] = with_derived(
    f"""select agent, enabled, {second('last_collection')} as last_collection, coalesce(m, 0) as recent_metric_count, coalesce(t, 0) as recent_trace_count, coalesce(l, 0) as recent_log_count, coalesce(e, 0) as recent_error_count,
               case when last_collection > timestamp '{AS_OF}' - interval 24 hour and coalesce(e, 0) = 0 then 'healthy' when last_collection > timestamp '{AS_OF}' - interval 72 hour then 'degraded' else 'unhealthy' end as health_status
        from configs left join (select agent, count(*) as m from points where {_DAY('ts')} group by agent) m using (agent) left join (select 'agent' || substring(service, 4) as agent, count(*) as t from spans where {_DAY('started')} group by all) t using (agent)
        left join (select agent, count(*) as l from logs where {_DAY('ts')} group by agent) l using (agent) left join (select substring(source, 7) as agent, count(*) as e from failures where {_DAY('ts')} and resolved_at is null and source like 'agent:%' group by all) e using (agent)""",
    *_HEALTH,
)
