"""Registered governance, registry and input-composition queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import privacy as P
from tracemill.operators import governance as G
from tracemill.operators import ingest as I  # noqa: E741
from tracemill.operators import scoring as S
from tracemill.plans.common import Registry, r, second, tidy
from tracemill.plans.records import EVENTS_SQL, LAST_STEP, _components, attack_names, attack_steps
from tracemill.plans.scoring import BASE, START
from tracemill.sources.adapter import AS_OF, derived, traces, with_derived, with_traces

registry = Registry()
on = registry.on_traces

_SINCE7 = f"ts > timestamp '{AS_OF}' - interval 7 day and ts <= timestamp '{AS_OF}'"
_STATUS = f"""select agent, wbd_enabled, pdma_enabled, compliance_score, manager_id, coalesce(n, 0) as recent_pdma_events, coalesce(risk, 0) as avg_risk_magnitude, coalesce(k, 0) as recent_wbd_deferrals, coalesce(open, 0) as pending_deferrals,
    case when wbd_enabled and coalesce(open, 0) > 5 then 'NEEDS_ATTENTION' when pdma_enabled and coalesce(risk, 0) > 3 then 'ELEVATED_RISK' when compliance_score < 0.7 then 'NON_COMPLIANT' else 'COMPLIANT' end as compliance_status
    from agents left join (select agent, count(*) as n, avg(risk_magnitude) as risk from pdma where {_SINCE7} group by agent) p using (agent) left join (select agent, count(*) as k, count(*) filter (status = 'PENDING') as open from wbd where {_SINCE7} group by agent) w using (agent)"""
_several = registry.on_several
_several("compliance_status", ("agents", "pdma", "wbd"), lambda a, p, w: G.compliance_status(a, p, w, AS_OF), f"select * replace ({r('avg_risk_magnitude')} as avg_risk_magnitude, {r('compliance_score')} as compliance_score) from ({_STATUS}) s")
_several(
    "compliance_summary",
    ("agents", "pdma", "wbd", "sunsets"),
    lambda a, p, w, s: G.compliance_summary(G.compliance_status(a, p, w, AS_OF), p, w, s, AS_OF),
    "select " + ", ".join(f"(select count(*) from ({_STATUS}) s where compliance_status = '{s}') as {s.lower()}" for s in ("COMPLIANT", "NON_COMPLIANT", "ELEVATED_RISK", "NEEDS_ATTENTION"))
    + f", (select count(*) from pdma where risk_magnitude >= 4 and ts > timestamp '{AS_OF}' - interval 1 day and ts <= timestamp '{AS_OF}') as high_risk_pdma_24h, (select count(*) from wbd where status = 'PENDING') as pending_wbd_deferrals, (select count(*) from sunsets where status in ('INITIATED', 'IN_PROGRESS')) as active_sunset_protocols",
)
#: lists: table, key, filter, size
_LISTS = {
    "list_deferrals": ("wbd", "wbd_id", {"status": "PENDING"}, 50),
    "list_pdma_events": ("pdma", "pdma_id", {"risk_magnitude": 5}, 40),
    "list_sunsets": ("sunsets", "sunset_id", {"status": "IN_PROGRESS"}, 20),
    "list_creations": ("creations", "entry_id", {"agent": "agent3"}, 30),
    "list_service_logs": ("logs", "log_id", {"level": "ERROR", "service": "svc1"}, 30),
}
for _name, (_source, _key, _filters, _n) in _LISTS.items():
    _said = " and ".join(f"{k} = {v if isinstance(v, int) else repr(v)}" for k, v in _filters.items())
    registry.on_derived(_name, _source, lambda x, k=_key, f=_filters, n=_n: G.listed(x, "ts", k, n, **f), f"select * replace ({second('ts')} as ts) from {_source} where {_said} order by {_source}.ts desc, {_key} desc limit {_n}")
#: pages after a cursor: table, key, filter
_AT = "2024-01-20 12:00:00"
_PAGES = {
    "list_llm_calls": ("calls", "call_id", {"model": "m1", "status": "ok"}),
    "list_attestations": ("attestations", "attestation_id", {"attestation_type": "vouch"}),
    "list_revocations": ("revocations", "revocation_id", {"pqc_completed": True}),
}
for _name, (_source, _key, _filters) in _PAGES.items():
    _said = " and ".join(f"{k} = {str(v).lower() if isinstance(v, bool) else repr(v)}" for k, v in _filters.items())
    registry.on_derived(
        _name, _source, lambda x, k=_key, f=_filters: G.keyset(x, k, (_AT, 500), 60, **f),
        f"select * replace ({second('ts')} as ts) from {_source} where {_said} and ({_source}.ts < timestamp '{_AT}' or ({_source}.ts = timestamp '{_AT}' and {_key} < 500)) order by {_source}.ts desc, {_key} desc limit 60",
    )
registry.on_derived("list_keys", "keys", lambda x: G.keyset(x, "key_id", None, 30, revoked=False, algorithm="ed25519"), f"select * replace ({second('ts')} as ts) from keys where not revoked and algorithm = 'ed25519' order by keys.ts desc, key_id desc limit 30")


def _alerts(tr):  # noqa: ANN001, ANN202
    """Alerts of every overridden trace: critical at a high entropy, some acknowledged."""
    severity = F.when(F.col("entropy") > 0.5, "critical").otherwise("warning")
    return tr.where("action_was_overridden").select(F.col("trace_id").alias("alert_id"), "ts", "agent_id_hash", severity.alias("severity"), F.lit("conscience_override").alias("mechanism"), F.coalesce("conscience_passed", F.lit(False)).alias("acknowledged"))


on(
    "list_alerts",
    lambda tr: G.list_alerts(_alerts(tr), AS_OF, 240, severity="critical", mechanism="conscience_override", unacknowledged=True, limit=50),
    f"""select trace_id as alert_id, {second('ts')} as ts, agent_id_hash, 'critical' as severity, 'conscience_override' as mechanism, false as acknowledged from tr where action_was_overridden and entropy > 0.5 and not coalesce(conscience_passed, false)
        and ts > timestamp '{AS_OF}' - interval 240 hour and ts <= timestamp '{AS_OF}' order by tr.ts desc, trace_id desc limit 50""",
)
_several("fleet_view", ("agents", "managers", "telemetry", "visibility"), G.fleet_view, f"select *, {r('compliance_score')} as score from agents left join managers using (manager_id) left join telemetry using (agent) left join visibility using (agent)".replace(f"*, {r('compliance_score')} as score", f"* replace ({r('compliance_score')} as compliance_score)"))
_SEEN = f"select manager_id, agent, logs.ts as seen, managers.enabled from logs join agents using (agent) join managers using (manager_id) where managers.enabled and logs.ts >= timestamp '{AS_OF}' - interval 240 hour and logs.ts <= timestamp '{AS_OF}'"


def _sightings(logs, agents):  # noqa: ANN001, ANN202
    """A log line is a sighting of its agent."""
    return logs.select("agent", F.col("ts").alias("seen")).join(agents.select("agent", "manager_id"), "agent")


_several("live_agents", ("logs", "agents", "managers"), lambda x, a, m: G.live_agents(_sightings(x, a), m, AS_OF, 14400), f"select * replace ({second('seen')} as seen) from ({_SEEN}) s")
_several(
    "fleet_stats",
    ("logs", "agents", "managers"),
    lambda x, a, m: G.fleet_stats(_sightings(x, a), m, AS_OF, 14400),
    f"""select (select count(*) from managers where enabled = true) as total_managers, (select count(*) from managers where enabled = true and last_error is not null) as managers_with_errors,
               (select count(distinct agent) from logs join agents using (agent) where logs.ts > timestamp '{AS_OF}' - interval 240 hour and logs.ts <= timestamp '{AS_OF}') as total_agents""",
)


def _detail(spark, sf_dir: str):  # noqa: ANN001, ANN202
    whole = G.trace_detail(traces(spark, sf_dir).select("trace_id", "agent_name", "selected_action"), _components(spark, sf_dir), derived(spark, sf_dir, "calls"))
    events = F.array_join(F.transform("events", lambda e: F.concat_ws("=", e["event_type"], e["data"])), ",")
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws("=", c["model"], c["status"])), ",")
    return whole.select("trace_id", "agent_name", "selected_action", events.alias("events"), calls.alias("calls"))


registry.queries["trace_detail"] = _detail
registry.sql["trace_detail"] = with_derived(
    with_traces(
        f"""with ev as ({EVENTS_SQL}) select trace_id, agent_name, selected_action, e.events, c.calls from tr left join (select trace_id, string_agg(event_type || '=' || data, ',' order by i) as events from ev group by trace_id) e using (trace_id)
            left join (select trace_id, string_agg(model || '=' || status, ',' order by call_id) as calls from calls group by trace_id) c using (trace_id)"""
    ),
    "calls",
)
registry.queries["calls_of_events"] = lambda spark, d: tidy(G.calls_of_events(derived(spark, d, "calls").select("call_id", "trace_id", "parent_event_type", "parent_attempt_index"), _components(spark, d).withColumn("attempt_index", F.lit(0).cast("long"))))
registry.sql["calls_of_events"] = with_derived(f"with ev as ({EVENTS_SQL}) select call_id, trace_id, parent_event_type, parent_attempt_index, i as event_index, data as event_data from calls left join ev on ev.trace_id = calls.trace_id and ev.event_type = parent_event_type and parent_attempt_index = 0".replace("select call_id, trace_id", "select call_id, calls.trace_id"), "calls")
_RULES = [("DMA_RESULTS", "csdma.plausibility_score", "float", "csdma"), ("ACTION_RESULT", "tokens_total", "int", "tokens"), ("ACTION_RESULT", "models_used[0]", "string", "model"), ("ACTION_RESULT", "has_positive_moment", "bool", "positive"), ("THOUGHT_START", "thought_type", "string", "thought_type")]
registry.queries["extract_fields"] = lambda spark, d: tidy(I.extract_fields(_components(spark, d), _RULES))
registry.sql["extract_fields"] = f"""with ev as ({EVENTS_SQL}) select trace_id, {r("max(try_cast(data ->> '$.csdma.plausibility_score' as double)) filter (event_type = 'DMA_RESULTS')")} as csdma, max(data ->> '$.models_used[0]') filter (event_type = 'ACTION_RESULT') as model,
    cast(floor(try_cast(max(data ->> '$.tokens_total') filter (event_type = 'ACTION_RESULT') as double)) as bigint) as tokens, case when max(data ->> '$.has_positive_moment') filter (event_type = 'ACTION_RESULT') = 'yes' then true end as positive,
    max(data ->> '$.thought_type') filter (event_type = 'THOUGHT_START') as thought_type from ev group by trace_id"""


def _registry(spark):  # noqa: ANN001, ANN202
    rows = [("1.9.3", [*I.SIX, I.SEVENTH], "all", 1), ("1.8", list(I.SIX), "all", 2), ("connectivity", list(I.CONNECTIVITY), "any", 3)]
    return spark.createDataFrame(rows, "version string, types array<string>, mode string, priority int")


registry.queries["detect_by_registry"] = lambda spark, d: tidy(I.detect_by_registry(_components(spark, d), _registry(spark)))
registry.sql["detect_by_registry"] = f"""with ev as ({EVENTS_SQL}) select trace_id, case when count(distinct event_type) filter (event_type not in ('startup', 'shutdown', 'WEIRD')) = 7 then '1.9.3'
    when count(distinct event_type) filter (event_type in ('{"', '".join(I.SIX)}')) = 6 then '1.8' when bool_or(event_type in ('startup', 'shutdown')) then 'connectivity' else 'unknown' end as version from ev group by trace_id"""
registry.queries["payload_digest"] = lambda spark, d: I.payload_digest(_components(spark, d))


def _raw_logs(logs):  # noqa: ANN001, ANN202
    """Log lines as services send them: secrets in the text, levels of any kind, some without a time."""
    n = F.col("log_id").cast("string")
    secret = F.when(F.col("log_id") % 5 == 0, F.concat(F.lit(" Bearer ab-"), n)).when(F.col("log_id") % 5 == 1, F.concat(F.lit(" password=p"), n, F.lit(" by u"), n, F.lit("@x.org"))).when(F.col("log_id") % 5 == 2, " 4111 1111 1111 1111 and 123-45-6789").otherwise("")
    level = F.when(F.col("log_id") % 7 == 0, F.lower("level")).when(F.col("log_id") % 7 == 1, "warn").when(F.col("log_id") % 7 == 2, "noise").when(F.col("log_id") % 7 != 3, F.col("level"))
    return logs.select("log_id", F.when(F.col("log_id") % 11 > 0, F.col("ts")).alias("ts"), "service", level.alias("level"), F.concat("message", secret).alias("message"), F.col("agent").alias("user"))


registry.on_derived(
    "service_logs",
    "logs",
    lambda x: I.service_logs(_raw_logs(x), AS_OF),
    f"""select log_id, case when log_id % 11 > 0 then {second('ts')} else '{AS_OF}' end as ts, service, case log_id % 7 when 1 then 'WARNING' when 2 then 'INFO' when 3 then 'INFO' else level end as level,
        message || case log_id % 5 when 0 then ' Bearer [REDACTED]' when 1 then ' password=[REDACTED] by [EMAIL]' when 2 then ' [CARD] and [SSN]' else '' end as message, left(sha256(agent), 16) as user_hash from logs""",
)
_ARGS = (START, AS_OF, BASE)
_IN = f"ts between timestamp '{START}' and timestamp '{AS_OF}'"
_INPUTS = f"""select s.*, coalesce(case when o.sd > 0 then (mean - o.m) / o.sd else 0 end, 0) as drift_z, hourly_coherence, hours from
    (select agent_id_hash, count(*) as n, count(*) filter (renamed) as renames, count(*) filter (action_was_overridden) as overrides, count(*) filter (gap) as gaps, count(*) filter (signature_verified) as signed, count(*) filter (recovered) as recoveries,
            avg(abs(csdma - cast(action_success as int))) as calibration_error, avg(case when entropy > 0.5 and not action_success then 1.0 else 0.0 end) as unsafe, avg(csdma) as mean
     from (select *, lag(agent_name) over w <> agent_name as renamed, audit_sequence_number - lag(audit_sequence_number) over w <> 1 as gap, lag(fragility) over w and not fragility as recovered from tr where {_IN} window w as (partition by agent_id_hash order by ts, event_id)) x group by agent_id_hash) s
    left join (select agent_id_hash, avg(csdma) as m, stddev_samp(csdma) as sd from tr where ts between timestamp '{BASE}' and timestamp '{START}' group by agent_id_hash) o using (agent_id_hash)
    join (select agent_id_hash, avg(c) as hourly_coherence, count(*) as hours from (select agent_id_hash, avg(coherence) as c from tr where {_IN} group by agent_id_hash, date_trunc('hour', ts)) h group by agent_id_hash) hh using (agent_id_hash)"""
_SHOW = ", ".join(f"{r(c)} as {c}" for c in ("calibration_error", "unsafe", "drift_z", "hourly_coherence"))
on("factor_inputs", lambda tr: S.factor_inputs(tr, *_ARGS), f"select agent_id_hash, n, renames, overrides, gaps, signed, recoveries, hours, {_SHOW} from ({_INPUTS}) i")
_PARTS = f"""select agent_id_hash, n, exp(-5.0 * renames / n) * exp(-10.0 * overrides / n) as c, greatest(0.1, (1 - gaps / n) * signed / n) as i_int,
    1.0 - case when abs(drift_z) < 0.05 then 0 when abs(drift_z) >= 0.15 then 1 else (abs(drift_z) - 0.05) / 0.10 end as r, (1 - coalesce(calibration_error, 0.1)) * (1 - unsafe) as i_inc, greatest(0.1, coalesce(hourly_coherence, 0.5)) as s from ({_INPUTS}) i"""
on("composite_from_inputs", lambda tr: S.composite_from_inputs(S.factor_inputs(tr, *_ARGS)), "select agent_id_hash, n, " + ", ".join(f"{r(c)} as {c}" for c in ("c", "i_int", "r", "i_inc", "s")) + f", {r('c * i_int * r * i_inc * s')} as composite from ({_PARTS}) p")
_AGO = lambda d: f"timestamp '{AS_OF}' - interval {d} day"
_NOW = f"ts <= timestamp '{AS_OF}'"
_COVER = " + ".join(f"cast({c} is not null as int)" for c in S.COVERED)
_V1 = f"""with k as (select * from tr where {_NOW}), w as (select * from k where ts > {_AGO(10)}),
    a as (select agent_name, count(*) as n, count(*) filter (action_was_overridden) as o, count(*) filter (signature_verified) as v, avg(({_COVER}) / 10.0) as cov, count(*) filter (entropy > 0.5 and not action_success) as u, avg(csdma) as p, avg(coherence) as h from w group by agent_name),
    b as (select agent_name, avg(csdma) as pm, stddev_samp(csdma) as ps, avg(coherence) as hm, stddev_samp(coherence) as hs from k where ts between {_AGO(30)} and {_AGO(10)} group by agent_name),
    l as (select agent_name, fragility, ts, lead(fragility) over x as after, lead(ts) over x as until from w where fragility is not null window x as (partition by agent_name order by ts, event_id)),
    m as (select agent_name, avg((epoch_us(until) - epoch_us(ts)) / 3600000000.0) as mttr from l where fragility and not after group by agent_name),
    q as (select agent_name, avg(case when action_success then 1.0 else 0.0 end) as s, avg(csdma) as c, count(*) as k from w where csdma is not null and action_success is not null group by agent_name, floor(csdma * 10)),
    e as (select agent_name, sum(k * abs(c - s)) / sum(k) as ece from q group by agent_name),
    d as (select agent_name, avg(case when coherence_passed then exp(-0.05 * (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 86400000000.0) else 0 end) as s from k where ts > {_AGO(40)} group by agent_name),
    z as (select *, greatest(coalesce(abs(p - pm) / nullif(ps, 0), 0), coalesce(abs(h - hm) / nullif(hs, 0), 0)) as drift, coalesce(mttr, 0) as mttr_hours from a left join b using (agent_name) left join m using (agent_name) left join e using (agent_name) left join d using (agent_name)),
    f as (select agent_name, n, exp(-10.0 * o / n) as c, v / n * cov as i_int, 1 / (1 + exp(-5.0 * ((1 - least(drift / 3, 1)) / (1 + mttr_hours) - 0.5))) as r, (1 - coalesce(nullif(ece, 0), 0.1)) * (1 - u / n) as i_inc, coalesce(s, 0) as s, drift, mttr_hours from z)"""
on("factors_v1", lambda tr: S.factors_v1(tr, AS_OF, 10), f"{_V1} select agent_name, n, " + ", ".join(f"{r(c)} as {c}" for c in ("c", "i_int", "r", "i_inc", "s", "drift", "mttr_hours")) + " from f")
on(
    "composite_v1",
    lambda tr: S.composite_v1(S.factors_v1(tr, AS_OF, 10)),
    f"""{_V1}, x as (select agent_name, n, c * greatest(i_int, 0.1) * r * i_inc * greatest(s, 0.1) as y from f) select agent_name, n, {r('y')} as composite, {r('1 / (0.001 + y)')} as fragility,
        case when y < 0.3 then 'high_fragility' when y < 0.6 then 'moderate' when y < 0.85 then 'healthy' else 'high_capacity' end as category, case when n < 10 then 'minimal' when n < 30 then 'provisional' else 'sufficient' end as data, n < 30 as is_provisional from x""",
)


def _attacked() -> Column:
    """Addresses, some too long and some with a sign of an attack."""
    return F.concat(F.col("url"), F.when(F.col("page_id") % 4 == 0, F.lit("/../x")).when(F.col("page_id") % 4 == 1, F.repeat(F.lit("y"), F.lit(300))).otherwise(""))


registry.on_table(
    "validate_identifier",
    "pages",
    lambda p: p.select("page_id", P.validate_identifier(_attacked(), "url").alias("v")).select("page_id", "v.value", "v.issues"),
    f"""with {attack_steps("select page_id, length(u) > 256 as long, left(u, 256) as v from (select page_id, url || case when page_id % 4 = 0 then '/../x' when page_id % 4 = 1 then repeat('y', 300) else '' end as u from pages) p", lambda _: "")},
             f as (select page_id, {attack_names("v")} as found from s0)
        select page_id, v as value, concat_ws(',', case when long then 'url_truncated' end, nullif(found, '')) as issues from {LAST_STEP} join f using (page_id)""",
)


def _named() -> Column:
    """Model lists as senders have them: a name, lists, an object, a list that is too long, none."""
    return F.when(F.col("event_id") % 6 == 0, "solo").when(F.col("event_id") % 6 == 1, '["a", null, "", "b"]').when(F.col("event_id") % 6 == 2, '{"a": 1}').when(F.col("event_id") % 6 == 3, F.concat(F.lit('["'), F.repeat(F.lit("m"), F.lit(260)), F.lit('", "../z"]'))).when(F.col("event_id") % 6 == 4, F.to_json(F.array_repeat(F.lit("n"), 1002)))


registry.on_table(
    "validate_models",
    "events",
    lambda e: e.select("event_id", P.validate_models(_named()).alias("v")).select("event_id", "v.value", "v.issues"),
    """select event_id, case event_id % 6 when 0 then 'solo' when 1 then 'a,,b' when 2 then '' when 3 then repeat('m', 256) || '[TRUNCATED],[PATH_REMOVED]z' when 4 then rtrim(repeat('n,', 1000), ',') else '' end as value,
              case event_id % 6 when 0 then 'models_used_was_string' when 1 then 'models_used_was_string' when 2 then 'models_used_was_string,models_used_invalid_type' when 3 then 'models_used_was_string,size_limit_exceeded,path_traversal' when 4 then 'models_used_was_string,models_used_truncated' else '' end as issues from events""",
)
registry.on_derived(
    "deferral_rows",
    "wbd",
    lambda w: I.deferral_rows(w.select("agent", F.concat(F.lit("  "), "status").alias("reason"), F.to_date("ts").cast("string").alias("defer_until"))),
    f"select distinct agent, status as reason, {second('date_trunc(chr(100)||chr(97)||chr(121), ts)')} as defer_until from wbd".replace("chr(100)||chr(97)||chr(121)", "'day'"),
)
