"""Registered detector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import detectors as D
from tracemill.plans.common import Registry, day, last, newest5, r
from tracemill.sources.adapter import AS_OF

DAYS = 30
registry = Registry()
_ALERT = "sha256('{m}' || '|' || agent_id_hash || '|' || coalesce(domain, '') || '|' || metric || '|' || severity) as alert_id, severity, '{m}' as mechanism, agent_id_hash, domain, metric"


def _alert(mechanism: str, findings: str) -> str:
    numbers = ", ".join(f"{r(c)} as {c}" for c in ("value", "baseline", "deviation"))
    said = f"printf('{D.SAID[mechanism]}', cast(deviation as double))"
    action = f"'{D.ADVICE[mechanism].replace(chr(39), chr(39) * 2)} (agent ' || agent_id_hash || ', ' || metric || ')'"
    return f"select {_ALERT.format(m=mechanism)}, {numbers}, {said} as deviation_text, {action} as recommended_action, evidence from ({findings}) f"


_CROSS = f"""
    with per as (select agent_id_hash, dsdma_domain as domain, avg(csdma) as csdma, avg(dsdma) as dsdma, avg(coherence) as coherence, {newest5()} as evidence
                 from tr where {last(DAYS)} and signature_verified and csdma is not null group by all having count(*) >= 10),
         long as (unpivot per on csdma, dsdma, coherence into name metric value value),
         dom as (select domain, metric, avg(value) as baseline, stddev_samp(value) as sd from long group by all having count(*) >= 3 and stddev_samp(value) > 0),
         z as (select l.*, baseline, (value - baseline) / sd as deviation from long l join dom using (domain, metric))
    select *, case when abs(deviation) > 3 then 'critical' else 'warning' end as severity from z where abs(deviation) > 2"""
_INTRA = f"""
    select agent_id_hash, cast(null as varchar) as domain, trace_type as metric, stddev_samp(csdma) as value, 0.15 as baseline, count(distinct selected_action) as deviation,
           case when count(distinct selected_action) > 3 and stddev_samp(csdma) > 0.2 then 'critical' else 'warning' end as severity, {newest5()} as evidence
    from tr where {last(DAYS)} group by agent_id_hash, trace_type having count(distinct selected_action) > 2 and stddev_samp(csdma) > 0.15"""
_GAPS = "select agent_id_hash, trace_id, prev_seq, seq, seq - prev_seq as gap from (select *, audit_sequence_number as seq, lag(audit_sequence_number) over (partition by agent_id_hash order by audit_sequence_number, trace_id) as prev_seq from {t}) s where seq - prev_seq <> 1"
_CHAIN = f"""
    select agent_id_hash, cast(null as varchar) as domain, 'audit_sequence' as metric, count(*) as value, 0 as baseline, count(*) as deviation, 'critical' as severity,
           array_to_string(list_slice(list(trace_id order by seq, trace_id), 1, 5), ',') as evidence
    from ({_GAPS.format(t=f"(select * from tr where {last(DAYS)})")}) g group by agent_id_hash"""
_DRIFT = f"""
    with daily as (select agent_id_hash, cast(ts as date) as day, avg(csdma) as csdma, avg(coherence) as coherence, {newest5()} as evidence
                   from tr where {last(DAYS)} group by all having count(*) >= 5),
         j as (select *, lag(csdma) over w as c0, lag(coherence) over w as h0 from daily window w as (partition by agent_id_hash order by day)),
         s as (select *, abs(csdma - c0) as a, abs(coherence - h0) as b from j)
    select agent_id_hash, {day('day')} as domain, case when a >= b then 'csdma' else 'coherence' end as metric, case when a >= b then csdma else coherence end as value,
           case when a >= b then c0 else h0 end as baseline, greatest(a, b) as deviation, case when greatest(a, b) > 0.25 then 'critical' else 'warning' end as severity, evidence
    from s where greatest(a, b) > 0.15"""
_OVERRIDE = f"""
    with rates as (select agent_id_hash, dsdma_domain as domain, cast(count(*) filter (action_was_overridden) as double) / count(*) as value, {newest5()} as evidence
                   from tr where {last(DAYS)} group by all having count(*) >= 20),
         dom as (select domain, avg(value) as baseline from rates group by all)
    select agent_id_hash, domain, 'override_rate' as metric, value, baseline, value / baseline as deviation, case when value > 3 * baseline then 'critical' else 'warning' end as severity, evidence
    from rates join dom using (domain) where value > 2 * baseline"""

on = registry.on_traces
on("cross_agent_divergence", lambda tr: D.cross_agent_divergence(tr, AS_OF, DAYS), _alert("cross_agent_divergence", _CROSS))
on(
    "cohort_divergence",
    lambda tr: D.cohort_divergence(tr, AS_OF, DAYS),
    f"""with per as (select deployment_domain, agent_id_hash, count(*) as n, avg(csdma) as csdma, avg(dsdma) as dsdma, avg(k_eff) as k_eff, avg(correlation_risk) as correlation_risk,
                            avg(case when action_was_overridden then 1.0 else 0.0 end) as override_rate from tr where {last(DAYS)} group by all having count(*) >= 10),
             long as (unpivot per on csdma, dsdma, k_eff, correlation_risk, override_rate into name metric value value)
        select deployment_domain, agent_id_hash, n, metric, {r('value')} as value,
               {r('case when stddev_samp(value) over w > 0 then (value - avg(value) over w) / stddev_samp(value) over w else 0 end')} as z from long window w as (partition by deployment_domain, metric)""",
)
on("intra_agent_inconsistency", lambda tr: D.intra_agent_inconsistency(tr, AS_OF, DAYS), _alert("intra_agent_inconsistency", _INTRA))
on("hash_chain_gaps", D.hash_chain_gaps, _GAPS.format(t="tr"))
on("hash_chain_alerts", lambda tr: D.hash_chain_alerts(tr, AS_OF, DAYS), _alert("hash_chain", _CHAIN))
on("daily_drift", lambda tr: D.daily_drift(tr, AS_OF, DAYS), _alert("temporal_drift", _DRIFT))
on(
    "welch_drift",
    lambda tr: D.welch_drift(tr, AS_OF, 20, 10),
    f"""with long as (unpivot (select agent_id_hash, ts >= timestamp '{AS_OF}' - interval 10 day as recent, csdma, dsdma, coherence from tr where {last(30)}) on csdma, dsdma, coherence into name metric value x),
             s as (select agent_id_hash, metric, avg(x) filter (not recent) as m1, avg(x) filter (recent) as m2, var_samp(x) filter (not recent) as v1, var_samp(x) filter (recent) as v2,
                          count(x) filter (not recent) as n1, count(x) filter (recent) as n2 from long group by all having count(x) filter (not recent) > 1 and count(x) filter (recent) > 1),
             z as (select *, case when v1 / n1 + v2 / n2 > 0 then (m2 - m1) / sqrt(v1 / n1 + v2 / n2) end as z from s)
        select agent_id_hash, metric, {r('m1')} as baseline_mean, {r('m2')} as recent_mean, n1 as baseline_n, n2 as recent_n, {r('z')} as z, case when abs(z) > 3 then 'critical' when abs(z) > 2 then 'warning' else 'ok' end as level from z""",
)
on("override_rate_anomalies", lambda tr: D.override_rate_anomalies(tr, AS_OF, DAYS), _alert("conscience_override", _OVERRIDE))
on(
    "cohort_override_rates",
    lambda tr: D.cohort_override_rates(tr, AS_OF, DAYS),
    f"""with rates as (select deployment_domain, agent_id_hash, count(*) as n, count(*) filter (action_was_overridden) as k from tr where {last(DAYS)} group by all having count(*) >= 10),
             p as (select *, sum(k) over w / sum(n) over w as pooled from rates window w as (partition by deployment_domain))
        select deployment_domain, agent_id_hash, n, {r('k / n')} as rate, {r('pooled')} as cohort_rate, {r('case when pooled > 0 then k / n / pooled end')} as multiple from p""",
)
_ALL = " union all ".join(_alert(m, f) for m, f in (("cross_agent_divergence", _CROSS), ("intra_agent_inconsistency", _INTRA), ("hash_chain", _CHAIN), ("temporal_drift", _DRIFT), ("conscience_override", _OVERRIDE)))
on("run_all_detections", lambda tr: D.run_all_detections(tr, AS_OF, DAYS), f"select * from ({_ALL}) alerts")
def _settled(alerts: DataFrame) -> DataFrame:
    """Half of the alerts acknowledged and a quarter resolved, by their ids."""
    return alerts.withColumn("acknowledged", F.col("alert_id") < "8").withColumn("resolved", F.col("alert_id") < "4")


on(
    "alert_stats",
    lambda tr: D.alert_stats(_settled(D.run_all_detections(tr, AS_OF, DAYS))),
    f"""select mechanism, count(*) as alerts, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warnings, count(*) filter (not coalesce(alert_id < '8', true)) as unacknowledged,
               count(*) filter (alert_id < '4') as resolved, count(distinct agent_id_hash) as agents from ({_ALL}) alerts group by rollup (mechanism)""",
)
on(
    "z_scores",
    lambda tr: D.z_scores(tr.select("trace_id", "agent_id_hash", "csdma"), "csdma", "agent_id_hash"),
    f"select trace_id, agent_id_hash, {r('csdma')} as csdma, {r('case when count(csdma) over w < 2 then null when stddev_pop(csdma) over w = 0 then 0 else (csdma - avg(csdma) over w) / stddev_pop(csdma) over w end')} as z from tr window w as (partition by agent_id_hash)",
)
on(
    "outliers",
    lambda tr: D.outliers(tr.select("trace_id", "agent_id_hash", "csdma"), "csdma", "agent_id_hash", 1.7),
    f"with s as (select trace_id, agent_id_hash, csdma, case when count(csdma) over w < 2 then null when stddev_pop(csdma) over w = 0 then 0 else (csdma - avg(csdma) over w) / stddev_pop(csdma) over w end as z from tr window w as (partition by agent_id_hash)) select trace_id, agent_id_hash, {r('csdma')} as csdma, {r('z')} as z from s where abs(z) > 1.7",
)
on(
    "weekly_rolling",
    D.weekly_rolling,
    f"with d as (select agent_id_hash, cast(ts as date) as day, avg(coherence) as m from tr group by all) select agent_id_hash, {day('day')} as day, {r('avg(m) over (partition by agent_id_hash order by d.day rows between 6 preceding and current row)')} as avg7 from d",
)
on("override_pct_daily", lambda tr: D.override_pct_daily(tr, AS_OF), f"select agent_id_hash, {day('cast(ts as date)')} as day, {r('100.0 * count(*) filter (action_was_overridden) / count(*)')} as override_pct, count(*) as n from tr where {last(30)} group by agent_id_hash, cast(ts as date)")
on(
    "faculty_pass_rates",
    lambda tr: D.faculty_pass_rates(tr, AS_OF, DAYS),
    "select agent_id_hash, " + ", ".join(f"{r(f'avg(case when {f}_passed then 1.0 else 0.0 end)')} as {f}_rate" for f in ("entropy", "coherence", "optimization_veto", "epistemic_humility")) + f" from tr where {last(DAYS)} group by agent_id_hash",
)
on("action_distribution", lambda tr: D.action_distribution(tr, AS_OF, DAYS), f"select agent_id_hash, trace_type, selected_action, count(*) as n from tr where {last(DAYS)} group by all")
on(
    "mean_divergence",
    D.mean_divergence,
    f"with a as (select dsdma_domain, agent_id_hash, avg(csdma) as m from tr group by all), d as (select dsdma_domain, avg(m) as dm, stddev_samp(m) as sd from a group by all) select dsdma_domain, {r('avg(abs(m - dm) / nullif(sd, 0))')} as avg_z from a join d using (dsdma_domain) group by dsdma_domain",
)
