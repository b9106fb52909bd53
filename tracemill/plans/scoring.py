"""Registered scoring queries: the last ten days against the twenty before."""

from __future__ import annotations

from tracemill.operators import scoring as S
from tracemill.plans.common import Registry, r, second
from tracemill.sources.adapter import AS_OF

START, BASE = "2024-01-21 00:00:00", "2024-01-01 00:00:00"
registry = Registry()
_WINDOW = f"ts between timestamp '{START}' and timestamp '{AS_OF}'"
_LIVE = "(idma_result is null or idma_result not ilike '%benchmark%')"
_IN = f"{_WINDOW} and {_LIVE}"
_ACT = "selected_action in ('SPEAK', 'TOOL', 'MEMORIZE', 'FORGET')"
_C = f"select agent_name, count(*) as n, exp(-10.0 * count(*) filter (action_was_overridden) / count(*)) as score from tr where {_IN} and {_ACT} group by agent_name"
_COVER = " + ".join(f"cast({c} is not null as int)" for c in S.COVERED)
_I_INT = f"select agent_name, count(*) as n, count(*) filter (signature_verified) / count(*) * avg(({_COVER}) / 10.0) as score from tr where {_IN} group by agent_name"
_R = f"""
    with s as (select agent_name, avg(csdma) filter (ts <= timestamp '{START}') as b, count(*) filter (ts <= timestamp '{START}') as bn, avg(csdma) filter (ts >= timestamp '{START}') as r,
                      count(*) filter (ts >= timestamp '{START}') as n from tr where ts between timestamp '{BASE}' and timestamp '{AS_OF}' and {_LIVE} and {_ACT} group by agent_name),
         d as (select *, abs(coalesce(nullif(r, 0), nullif(b, 0), 0.9) - coalesce(nullif(b, 0), 0.9)) as change from s where n > 0)
    select agent_name, n, change, 1.0 - (case when change < 0.05 then 0.0 when change >= 0.15 then 1.0 else (change - 0.05) / 0.10 end) * (case when bn < 10 then 0.5 when bn < 20 then 0.75 else 1.0 end) as score from d"""
_I_INC = f"""
    with k as (select agent_name, avg(case when action_success then 1.0 else 0.0 end) as s, avg(csdma) as c, count(*) as k from tr
               where {_IN} and {_ACT} and csdma is not null and action_success is not null group by agent_name, floor(csdma * 10)),
         e as (select agent_name, sum(k * abs(c - s)) / sum(k) as ece from k group by agent_name),
         u as (select agent_name, count(*) as n, count(*) filter (entropy > 0.5 and not action_success) as u from tr where {_IN} and {_ACT} group by agent_name)
    select agent_name, n, coalesce(nullif(ece, 0), 0.1) as ece, (1 - coalesce(nullif(ece, 0), 0.1)) * (1 - u / n) as score from u left join e using (agent_name)"""
_PASSED = " and ".join(f"coalesce({c}, false)" for c in S.FACULTIES)
_RUN = " and ".join(f"{c} is not null" for c in S.FACULTIES)
_WEIGHT = f"exp(-0.05 * (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 86400000000.0)"
_S = f"""
    with s as (select agent_name, count(*) as n, sum(case when coherence_passed then {_WEIGHT} else 0 end) / sum(case when coherence_passed is not null then {_WEIGHT} end) as base,
                      count(*) filter (has_positive_moment) as p, count(*) filter ({_PASSED}) as f, count(*) filter ({_RUN}) as e from tr where {_IN} and {_ACT} group by agent_name)
    select agent_name, n, least(1.0, coalesce(nullif(base, 0), 0.5) * (1 + 0.15 * p / n) * (1 + 0.10 * f / greatest(e, 1))) as score from s"""
_WHOLE = f"""
    with p as (select i.agent_name, i.n as traces, coalesce(c.score, 1.0) as c, i.score as i_int, coalesce(r.score, 1.0) as r, coalesce(q.score, 0.9) as i_inc, coalesce(s.score, 0.5) as s
               from ({_I_INT}) i left join ({_C}) c using (agent_name) left join ({_R}) r using (agent_name) left join ({_I_INC}) q using (agent_name) left join ({_S}) s using (agent_name)),
         x as (select *, c * greatest(i_int, 0.1) * r * i_inc * s as composite from p)
    select *, 1 / (0.001 + composite) as fragility, case when composite < 0.3 then 'high_fragility' when composite < 0.6 then 'moderate' when composite < 0.85 then 'healthy' else 'high_capacity' end as category,
           case when traces < 10 then 'insufficient' when traces < 30 then 'low' when traces < 100 then 'medium' else 'high' end as confidence from x"""
_NUMBERS = ", ".join(f"{r(c)} as {c}" for c in ("c", "i_int", "r", "i_inc", "s", "composite", "fragility"))
_SHOWN = f"agent_name, traces, {_NUMBERS}, category, confidence"
_WEAKEST = "struct_extract(list_sort([{x: c, n: 'c'}, {x: i_int, n: 'i_int'}, {x: r, n: 'r'}, {x: i_inc, n: 'i_inc'}, {x: s, n: 's'}])[1], 'n')"

on = registry.on_traces
_ARGS = (START, AS_OF)
on("score_factor_c", lambda tr: S.factor_c(tr, *_ARGS), f"select agent_name, n, {r('score')} as score from ({_C}) f")
on("score_factor_i_int", lambda tr: S.factor_i_int(tr, *_ARGS), f"select agent_name, n, {r('score')} as score from ({_I_INT}) f")
on("score_factor_r", lambda tr: S.factor_r(tr, *_ARGS, BASE), f"select agent_name, n, {r('change')} as change, {r('score')} as score from ({_R}) f")
on("score_factor_i_inc", lambda tr: S.factor_i_inc(tr, *_ARGS), f"select agent_name, n, {r('ece')} as ece, {r('score')} as score from ({_I_INC}) f")
on("score_factor_s", lambda tr: S.factor_s(tr, *_ARGS), f"select agent_name, n, {r('score')} as score from ({_S}) f")
on(
    "score_trend",
    lambda tr: S.trend(tr, *_ARGS),
    f"""with t as (select agent_name, csdma, row_number() over (partition by agent_name order by ts desc, event_id desc) as rn from tr where {_IN} and {_ACT} and csdma is not null),
             d as (select agent_name, rn, csdma, csdma - lag(csdma) over (partition by agent_name order by rn desc) as step from t where rn <= 5),
             s as (select agent_name, count(*) as k, arg_min(csdma, rn) - arg_max(csdma, rn) as size, coalesce(max(step), 0) as top, coalesce(min(step), 0) as low from d group by agent_name)
        select agent_name, {r('case when k >= 3 then size else 0 end')} as magnitude,
               case when k >= 3 and abs(size) > 0.05 and top <= 0 then 'declining' when k >= 3 and abs(size) > 0.05 and low >= 0 then 'improving' else 'stable' end as direction from s""",
)
on("score_composite", lambda tr: S.composite(tr, *_ARGS, BASE), f"select {_SHOWN} from ({_WHOLE}) w")
on("fleet_scores", lambda tr: S.fleet_scores(tr, *_ARGS, BASE), f"select {_SHOWN}, {_WEAKEST} as weakest from ({_WHOLE}) w")
on("score_alerts", lambda tr: S.score_alerts(S.composite(tr, *_ARGS, BASE)), f"select {_SHOWN} from ({_WHOLE}) w where composite < 0.3")
on("fleet_summary", lambda tr: S.fleet_summary(S.composite(tr, *_ARGS, BASE)), f"select category, count(*) as agents, {r('avg(composite)')} as mean from ({_WHOLE}) w group by category")
on(
    "identity_drift",
    S.identity_drift,
    f"with l as (select agent_id_hash, agent_name <> lag(agent_name) over (partition by agent_id_hash order by ts, event_id) as changed from tr) select agent_id_hash, count(*) as n, count(*) filter (changed) as changes, {r('count(*) filter (changed) / count(*)')} as drift from l group by agent_id_hash",
)
on(
    "fragility_mttr",
    S.fragility_mttr,
    f"""with l as (select agent_id_hash, fragility, ts, lead(fragility) over w as after, lead(ts) over w as until from tr where fragility is not null window w as (partition by agent_id_hash order by ts, event_id))
        select agent_id_hash, {r('avg((epoch_us(until) - epoch_us(ts)) / 3600000000.0)')} as mttr_hours, count(*) as recoveries from l where fragility and not after group by agent_id_hash""",
)
on(
    "hourly_coherence_divergence",
    lambda tr: S.hourly_coherence_divergence(tr, AS_OF, 20),
    f"""with h as (select date_trunc('hour', ts) as hour, agent_name, avg(coherence) as m from tr where ts > timestamp '{AS_OF}' - interval 20 day and ts <= timestamp '{AS_OF}' group by all)
        select {second('hour')} as hour, {r('stddev(m)')} as cross_agent_divergence, {r('avg(m)')} as fleet_coherence from h group by h.hour""",
)
_DECAYED = f"""select agent_name, avg(cast(coherence_passed as int)) as raw_rate, sum(case when coherence_passed then {_WEIGHT} else 0 end) / sum(case when coherence_passed is not null then {_WEIGHT} end) as s_base
    from tr where {_IN} and {_ACT} group by agent_name"""
on(
    "score_diagnosis",
    lambda tr: S.diagnose(tr, *_ARGS, BASE),
    f"""with d as (select agent_name, count(*) as total, count(*) filter (where {_ACT}) as non_exempt, avg((epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 86400000000.0) as age_days,
                      count(*) filter (where coherence_passed is not null) as has_coherence, count(*) filter (where coherence_passed = true) as coherent from tr where {_WINDOW} group by agent_name),
             x as (select *, has_coherence / nullif(non_exempt, 0) as coverage, raw_rate - s_base as decay_impact, {_WEAKEST} as lowest
                   from d join ({_WHOLE}) w using (agent_name) left join ({_DECAYED}) y using (agent_name) left join (select agent_name, change from ({_R}) z) v using (agent_name))
        select agent_name, total, non_exempt, has_coherence, coherent, {", ".join(f"{r(c)} as {c}" for c in ("age_days", "c", "i_int", "r", "i_inc", "s", "composite", "change", "coverage", "decay_impact"))}, lowest,
               concat_ws(',', {", ".join(f"case when {c} < 0.7 then '{c}_low' end" for c in ("c", "i_int", "r", "i_inc", "s"))}, case when raw_rate > 0.9 and s_base < 0.7 then 'decay' end, case when change > 0.05 then 'drift' end,
                         case when total < 30 then 'few_traces' end, case when coverage < 0.8 then 'low_coverage' end) as issues from x""",
)
