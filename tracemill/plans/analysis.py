"""Registered view and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import corpus as C
from tracemill.operators import views as V
from tracemill.plans.common import Registry, r, second, tidy
from tracemill.sources.adapter import GATES, TRACE_SQL, derived, traces, with_derived

registry = Registry()
on = registry.on_traces
_CLASS = (
    "case when channel_id like 'model\\_eval\\_%' escape '\\' then 'qa_eval' when channel_id like 'api\\_google%' escape '\\' then 'real_user_web' when channel_id like 'discord%' then 'discord' when channel_id like 'websocket%' then 'real_user_ws' "
    "when channel_id like 'http%' then 'real_user_http' when cognitive_state = 'wakeup' then 'wakeup_ritual' when regexp_matches(task_id, '^(VERIFY_IDENTITY|VALIDATE_INTEGRITY|EVALUATE_RESILIENCE|EXPRESS_GRATITUDE|ACCEPT_INCOMPLETENESS)') then 'wakeup_ritual' "
    "when channel_id is null then 'unknown' else 'other' end"
)
_STAGES = (("thought_start_at", "snapshot_at", "t_snap_ms"), ("snapshot_at", "dma_results_at", "t_dma_ms"), ("dma_results_at", "aspdma_at", "t_aspdma_ms"), ("aspdma_at", "conscience_at", "t_conscience_ms"), ("conscience_at", "action_result_at", "t_action_ms"))
_PROMOTED = ", ".join(f"try_cast(conscience_result ->> '$.{k}' as {v}) as {k}" for k, v in V.PROMOTED.items())
_BATCH = ", ".join(f"correlation_metadata ->> '$.{k}' as {k}" for k in V.BATCH_KEYS)
#: DuckDB finds keys at any depth itself
_TC = f"""select *, {_CLASS} as task_class, nullif(regexp_extract(channel_id, '^model_eval_([a-z]+)_', 1), '') as qa_language, try_cast(nullif(regexp_extract(channel_id, '^model_eval_[a-z]+_([0-9]+)', 1), '') as bigint) as qa_question from
    (select trace_id, thought_id, task_id, agent_id_hash, agent_name, ts, cognitive_state, trace_level, selected_action, csdma, dsdma, coherence, entropy, k_eff, correlation_risk, fragility, entropy_passed, coherence_passed, optimization_veto_passed,
        epistemic_humility_passed, conscience_passed, action_was_overridden, {_PROMOTED}, tokens_total, processing_ms, cost_cents, {", ".join(f"(epoch_us({b}) - epoch_us({a})) / 1000 as {n}" for a, b, n in _STAGES)},
        coalesce(snapshot_and_context ->> '$.system_snapshot.channel_id', (thought_start ->> '$..channel_id')[1], (snapshot_and_context ->> '$..channel_id')[1]) as channel_id, {_BATCH},
        try_cast(correlation_metadata ->> '$.user_latitude' as decimal(4,1)) as user_latitude_cell, try_cast(correlation_metadata ->> '$.user_longitude' as decimal(5,1)) as user_longitude_cell,
        coalesce(snapshot_and_context ->> '$.agent_version', snapshot_and_context ->> '$.system_snapshot.agent_version') as agent_version, case when json_type(models_used) = 'ARRAY' then models_used ->> '$[0]' end as primary_model,
        try_cast(coalesce(snapshot_and_context ->> '$.attestation_level', snapshot_and_context ->> '$.verify_attestation.attestation_level') as bigint) as attestation_level,
        coalesce(snapshot_and_context ->> '$.attestation_status', snapshot_and_context ->> '$.verify_attestation.attestation_status') as attestation_status, signature_verified
     from tr left join batches using (batch_id)) joined"""
_FLOATS = ", ".join(f"{r(c)} as {c}" for c in ("csdma", "dsdma", "coherence", "entropy", "k_eff", "correlation_risk", "cost_cents", *V.PROMOTED, *(n for _, _, n in _STAGES), "user_latitude_cell", "user_longitude_cell"))


def _context(spark, sf_dir: str):  # noqa: ANN001, ANN202
    return V.trace_context(traces(spark, sf_dir), derived(spark, sf_dir, "batches"))


def _on_context(name: str, build, sql: str | None) -> None:  # noqa: ANN001
    """A query over the analysis view; its SQL reads it as ``tc``."""
    registry.queries[name] = lambda spark, d: tidy(build(_context(spark, d)))
    if sql:
        registry.sql[name] = with_derived(f"with tr as ({TRACE_SQL}), tc as ({_TC})" + (f", {sql[5:]}" if sql.startswith("with ") else f" {sql}"), "batches")


_on_context("trace_context", lambda tc: tc, f"select * replace ({_FLOATS}, {second('ts')} as ts) from tc")
_YES = lambda c: f"coalesce({c}, false)"
_OUT = f"""case when selected_action = 'REJECT' or {_YES("action_was_overridden")} then 'red' when {_YES("has_positive_moment")} then 'green' when selected_action = 'TASK_COMPLETE' or {_YES("action_success")} then 'yellow'
    when selected_action in ('SPEAK', 'OBSERVE', 'TOOL', 'MEMORIZE', 'RECALL', 'PONDER', 'DEFER') then 'yellow' else 'red' end"""
_TASK = """select task_id, count(*) as traces, case when count(*) filter (selected_action = 'TASK_COMPLETE') > 0 then case when count(*) filter (selected_action = 'TASK_COMPLETE' and has_positive_moment) > 0 then 'green' else 'yellow' end
    when count(*) filter (selected_action = 'REJECT') > 0 or count(*) filter (action_was_overridden) > 0 then 'red' when count(*) filter (action_success) > 0 then 'yellow' else 'red' end as outcome from tr where task_id is not null group by task_id"""
on("trace_outcome", V.trace_outcome, f"select trace_id, task_id, {_OUT} as outcome from tr")
on("task_outcome", V.task_outcome, _TASK)
_GATES = " union all ".join(f"select trace_id, schema_version, '{g}' as gate, {i} as i, epoch_us({c}) as us, '{c.removesuffix('_at')}' as step from tr" for i, (g, c) in enumerate(GATES.items(), 1))
on("stage_times", lambda tr: V.stage_times(tr).select("trace_id", *[n for _, _, n in _STAGES]), "select trace_id, " + ", ".join(r(f"(epoch_us({b}) - epoch_us({a})) / 1000") + f" as {n}" for a, b, n in _STAGES) + " from tr")
on("step_durations", V.step_durations, f"with g as ({_GATES}), n as (select trace_id, step, us - lag(us) over (partition by trace_id order by i) as d from g where us is not null) select trace_id, step, {r('d / 1000')} as ms from n where d is not null")
on(
    "gate_sequence",
    V.gate_sequence,
    f"with g as ({_GATES}), f as (select *, min(us) over (partition by trace_id) as first from g) select trace_id, cast(i as bigint) as phase_index, gate, {r('(us - first) / 1000')} as elapsed_ms, us is not null as observed from f where gate <> 'IDMA_RESULT' or schema_version = '1.9.3'",
)
_TERMS = (
    "0.18 * coalesce(1 - csdma, 0) + 0.18 * coalesce(1 - dsdma, 0) + 0.18 * coalesce(1 - coherence, 0) + 0.12 * coalesce(cast(fragility as int), 0) + 0.10 * coalesce(least(1, greatest(0, (2 - k_eff) / 2)), 0) "
    "+ 0.10 * coalesce(cast(action_was_overridden as int), 0) + 0.07 * coalesce(cast(is_recursive as int), 0) + 0.04 * coalesce(cast(has_execution_error as int), 0) + 0.03 * coalesce(cast(not action_success as int), 0)"
)
on("instability", V.instability, f"select trace_id, {r(_TERMS)} as instability from tr")
on(
    "resolve_agent",
    lambda tr: V.resolve_agent(tr, tr.select("agent_name").union(tr.select(F.concat(F.lit("no_"), "agent_name"))).distinct()),
    """with s as (select agent_name, count(distinct agent_id_hash) as k, max(agent_id_hash) as h from tr group by agent_name), asked as (select agent_name from s union select 'no_' || agent_name from s)
       select agent_name, case when k = 1 then h end as hash, case when k = 1 then 'ok' when k > 1 then 'conflict' else 'not_found' end as resolution from asked left join s using (agent_name)""",
)
on(
    "promote_json",
    lambda tr: V.promote_json(tr).select("trace_id", *V.PROMOTED, V.channel().alias("channel")),
    f"select trace_id, {', '.join(f'{r(k)} as {k}' for k in V.PROMOTED)}, channel from (select trace_id, {_PROMOTED}, coalesce(snapshot_and_context ->> '$.system_snapshot.channel_id', (thought_start ->> '$..channel_id')[1], (snapshot_and_context ->> '$..channel_id')[1]) as channel from tr) p",
)
registry.on_table(
    "stewardship_tier",
    "orders",
    lambda o: o.select("o_orderkey", V.stewardship_tier(F.col("o_orderkey") % 11, F.col("o_custkey") % 7, F.col("o_orderkey") % 5).alias("tier")),
    "select o_orderkey, least(5, greatest(1, cast(ceil(((o_orderkey % 11) + (o_custkey % 7)) * (o_orderkey % 5) / 7.0) as bigint))) as tier from orders",
)
_on_context("corpus_totals", C.corpus_totals, f"select count(*) as traces, count(distinct task_id) as tasks, count(distinct thought_id) as thoughts, count(distinct agent_name) as agents, {second('min(ts)')} as first_ts, {second('max(ts)')} as last_ts from tc")
_on_context(
    "corpus_facets",
    C.corpus_facets,
    "with f as (" + " union all ".join(f"select '{f}' as facet, cast({f} as varchar) as value, count(*) as n from tc {w} group by {f}" for f, w in ((f, "where task_class = 'qa_eval'" if f.startswith("qa_") else "") for f in C.FACETS)) + f") select facet, value, n, {r('n / (select count(*) from tc)')} as share from f",
)
on(
    "top_cells",
    lambda tr: C.top_cells(tr, ["deployment_region", "selected_action"], "agent_id_hash", 20, 3),
    "select deployment_region, selected_action, count(distinct agent_id_hash) as entities, count(*) as n from tr group by all having count(distinct agent_id_hash) >= 3 order by n desc, deployment_region nulls first, selected_action nulls first limit 20",
)
on("k_anonymous", lambda tr: C.k_anonymous(tr, ["deployment_region", "cognitive_state"], "agent_id_hash", 3), "select deployment_region, cognitive_state, count(distinct agent_id_hash) as entities, count(*) as n from tr group by all having count(distinct agent_id_hash) >= 3")
on(
    "signal_health",
    C.signal_health,
    """select count(*) filter (where csdma = 0) as csdma_zero, count(*) filter (where csdma >= 0.9) as csdma_high, count(*) filter (where coherence_passed = false) as coherence_vetoed, count(*) filter (where entropy_passed = false) as entropy_vetoed,
              count(*) filter (where optimization_veto_passed = false) as optimization_vetoed, count(*) filter (where epistemic_humility_passed = false) as epistemic_vetoed, count(*) filter (where fragility = true) as fragile,
              count(*) filter (where signature_verified = true) as signature_ok, count(*) filter (where action_was_overridden = true) as overridden, count(*) as total from tr""",
)
_GAPPED = "case when event_id % 7 = 0 or ts > timestamp '2024-01-25' then null else csdma end"  # a metric whose values end early
on(
    "stationarity",
    lambda tr: C.stationarity(tr.withColumn("csdma", F.expr(_GAPPED))),
    "with c as (select ts, {g} as csdma, dsdma, coherence, entropy from tr)".format(g=_GAPPED)
    + " union all ".join(
        f""" select '{m}' as metric, {r('avg(x) filter (where not late)')} as first, {r('avg(x) filter (where late)')} as second, count(x) filter (where not late) as first_n, count(x) filter (where late) as second_n,
                    abs(avg(x) filter (where not late) - avg(x) filter (where late)) >= 0.10 as shifted
             from (select {m} as x, epoch_us(ts) >= (select (epoch_us(min(ts)) + epoch_us(max(ts))) / 2 from c where {m} is not null) as late from c where {m} is not null) y"""
        for m in ("csdma", "dsdma", "coherence", "entropy")
    ),
)
_KINDS = {"plain": "cast({c} as double)", "zero": "coalesce(cast({c} as double), 0)", "flag": "case when {c} then 1 else 0 end", "tri": "cast({c} as int)"}
_on_context("constraint_vector", C.constraint_vector, "select trace_id, " + ", ".join(f"{r(_KINDS[kind].format(c=c))} as {c}" for c, kind in C.FEATURES.items()) + " from tc")
registry.queries["n_eff"] = lambda spark, d: tidy(C.n_eff(C.newest(_context(spark, d), 2000)))
registry.queries["n_eff_by_domain"] = lambda spark, d: tidy(C.n_eff(C.newest(_context(spark, d), 500, by="task_class"), by="task_class"))
registry.queries["rolling_n_eff"] = lambda spark, d: tidy(C.rolling_n_eff(_context(spark, d), 500, 100))
on(
    "repository_stats",
    C.repository_stats,
    " union all ".join(
        f"""select '{level}' as level, {domain} as dsdma_domain, count(*) as traces, count(distinct agent_id_hash) as agents, count(distinct dsdma_domain) as domains, {r('avg(csdma)')} as csdma, {r('avg(dsdma)')} as dsdma, {r('avg(k_eff)')} as k_eff,
                   {r('avg(case when conscience_passed then 1.0 else 0.0 end)')} as conscience_pass_rate, {r('avg(case when action_was_overridden then 1.0 else 0.0 end)')} as override_rate, {r('avg(case when fragility then 1.0 else 0.0 end)')} as fragile_rate
            from tr {rest}"""
        for level, domain, rest in (("all", "null::varchar", ""), ("domain", "tr.dsdma_domain", "where tr.dsdma_domain is not null group by tr.dsdma_domain"))
    ),
)
on("action_share", lambda tr: C.share_of(tr, "selected_action"), f"select selected_action, count(*) as n, {r('count(*) / sum(count(*)) over ()')} as share from tr group by selected_action")
on("llm_costs", C.llm_costs, f"select primary_model, agent_name, dsdma_domain, cast(grouping_id(primary_model, agent_name, dsdma_domain) as bigint) as level, count(*) as calls, cast(sum(tokens_total) as bigint) as tokens, {r('sum(cost_cents)')} as cost_cents from tr group by grouping sets ((primary_model), (agent_name), (dsdma_domain), ())")
on(
    "task_flow",
    C.task_flow,
    f"""select f.task_id, thoughts, {r('span')} as span_minutes, {r('p')} as p, {r('a')} as a, {r('c')} as c, final, outcome from
        (select task_id, count(*) as thoughts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 as span, avg(csdma) as p, avg(dsdma) as a, avg(coherence) as c, arg_max(selected_action, (ts, event_id)) as final from tr where task_id is not null group by task_id) f
        join ({_TASK}) o using (task_id)""",
)
on("verb_outcomes", C.verb_outcomes, f"select selected_action, outcome, count(*) as n from (select selected_action, {_OUT} as outcome from tr) o group by rollup (selected_action, outcome)")
on("journey_points", C.journey_points, f"select task_id, trace_id, {r('csdma')} as csdma, {r('dsdma')} as dsdma, {r('coherence')} as coherence, outcome from tr join ({_TASK}) o using (task_id) where csdma is not null and dsdma is not null and coherence is not null")
on("frechet_pairs", lambda tr: C.frechet_pairs(C.task_paths(tr)))
on("route_clusters", lambda tr: C.route_clusters(C.task_paths(tr), 0.2, 5))
on("route_labels", lambda tr: C.route_labels(C.task_paths(tr), C.frechet_pairs(C.task_paths(tr))))
on("route_rates", lambda tr: C.route_rates(C.route_labels(C.task_paths(tr), C.frechet_pairs(C.task_paths(tr)))))
