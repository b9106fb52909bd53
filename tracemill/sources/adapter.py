"""Canonical traces derived from the ``events`` table by integer arithmetic.

``TRACE_SQL`` is one query that both Spark and DuckDB run, so a query and its
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: the fixed time that stands for "now" in every registered query
AS_OF = "2024-01-31 00:00:00"

ACTIONS = ("SPEAK", "DEFER", "PONDER", "RECALL", "MEMORIZE", "FORGET", "OBSERVE", "REJECT", "TOOL", "TASK_COMPLETE")
_ACTION = "case event_id % 10 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ACTIONS)) + " end"


def _tenth(a: int, m: int, scale: str = "100") -> str:
    return f"cast((event_id * {a}) % {m} as double) / {scale}"


#: every class of channel, and none
_CHANNEL = (
    "case event_id % 9 when 0 then 'model_eval_en_' || cast(event_id % 20 as varchar(20)) when 1 then 'discord_' || cast(user_id as varchar(20)) when 2 then 'api_google_' || cast(user_id as varchar(20)) when 3 then null "
    "when 4 then 'websocket_' || cast(user_id as varchar(20)) when 5 then 'http_' || cast(user_id as varchar(20)) when 6 then 'model_eval_de_' || cast(event_id % 20 as varchar(20)) || '_again' else 'chan' || cast(event_id % 7 as varchar(20)) end"
)
#: the channel in one of three places of two JSON columns, deeper than the first in some
_SNAPSHOT = (
    f"""coalesce(case event_id % 3 when 0 then '{{"system_snapshot": {{"channel_id": "' || {_CHANNEL} || '", "agent_version": "2.1"}}, "attestation_level": 3}}' """
    f"""when 1 then '{{"agent_version": "2.0", "note": "no channel_id here", "verify_attestation": {{"attestation_level": "4", "attestation_status": "ok"}}, "deep": {{"list": [{{"x": 1}}, {{"channel_id": "' || {_CHANNEL} || '"}}]}}}}' end, '{{"attestation_status": "none"}}')"""
)
_START = """case when event_id % 6 = 2 then '{"meta": {"channel_id": "discord_start"}}' when event_id % 6 = 5 then '{"thought_type": "standard"}' end"""
_CHECKS = """case when event_id % 5 = 0 then null when event_id % 5 = 1 then '{"entropy_score": "0.87", "coherence_score": 0.25}' else '{"entropy_score": 0.' || cast(event_id % 10 as varchar(20)) || ', "optimization_veto_entropy_ratio": ' || cast(event_id % 7 as varchar(20)) || '.5, "epistemic_humility_certainty": "high"}' end"""
#: gates of one trace in their order, and the column that says when each was passed
GATES = {
    "THOUGHT_START": "thought_start_at",
    "SNAPSHOT_AND_CONTEXT": "snapshot_at",
    "DMA_RESULTS": "dma_results_at",
    "ASPDMA_RESULT": "aspdma_at",
    "IDMA_RESULT": "idma_at",
    "TSASPDMA_RESULT": "tsaspdma_at",
    "CONSCIENCE_RESULT": "conscience_at",
    "ACTION_RESULT": "action_result_at",
}


def _passed(i: int, column: str) -> str:
    """A gate's time: some are missing, and tool gates mostly."""
    missing = "event_id % 4 <> 3" if column == "tsaspdma_at" else f"(event_id + {i}) % 9 = 0"
    return f"case when {missing} then null else cast(ts as timestamp) + interval '1' second * cast({i} * (1 + event_id % 13) as int) end"


COLUMNS = {
    "event_id": "event_id",
    "trace_id": "'t' || cast(event_id as varchar(20))",
    "thought_id": "'th' || cast(event_id as varchar(20))",
    "task_id": "case when event_id % 23 = 0 then null when event_id % 8 = 0 then 'VERIFY_IDENTITY_' || cast(cast((event_id - event_id % 5) / 5 as bigint) as varchar(20)) when event_id % 12 = 6 then 'express_gratitude_' || cast(cast((event_id - event_id % 5) / 5 as bigint) as varchar(20)) else 'task-' || cast(cast((event_id - event_id % 5) / 5 as bigint) as varchar(20)) end",
    "agent_id_hash": "'a' || cast(user_id as varchar(20))",
    "agent_name": "case when user_id % 9 = 0 and event_id % 2 = 0 then 'renamed' else 'agent' || cast(user_id % 50 as varchar(20)) end",
    "dsdma_domain": "'d' || cast(user_id % 2 as varchar(20))",
    "deployment_domain": "'p' || cast(user_id % 3 as varchar(20))",
    "deployment_region": "case when event_id % 13 = 0 then null else 'r' || cast(user_id % 4 as varchar(20)) end",
    "trace_type": "case event_id % 8 when 0 then 'VERIFY_IDENTITY' when 1 then 'VALIDATE_INTEGRITY' when 2 then 'EVALUATE_RESILIENCE' when 3 then 'ACCEPT_INCOMPLETENESS' when 4 then 'EXPRESS_GRATITUDE' else 'type' || cast(event_id % 3 as varchar(20)) end",
    "cognitive_state": "case event_id % 4 when 0 then 'work' when 1 then 'play' when 2 then 'dream' else case when event_id % 5 = 0 then 'wakeup' else 'solitude' end end",
    "trace_level": "case event_id % 3 when 0 then 'generic' when 1 then 'detailed' else 'full_traces' end",
    "schema_version": "case event_id % 4 when 0 then '1.8' when 1 then '1.9' when 2 then '1.9.1' else '1.9.3' end",
    "channel_id": _CHANNEL,
    "ts": "cast(ts as timestamp)",
    "selected_action": _ACTION,
    "csdma": "cast(case when user_id % 13 = 0 then (event_id * 37) % 51 else (event_id * 37) % 101 end as double) / 100",
    "dsdma": _tenth(41, 101),
    "coherence": _tenth(53, 97),
    "entropy": _tenth(29, 101),
    "correlation_risk": _tenth(31, 101),
    "k_eff": _tenth(17, 400),
    "signature_verified": "event_id % 17 <> 0",
    "conscience_passed": "case when event_id % 29 = 0 then null else event_id % 7 <> 0 end",
    "action_was_overridden": "case when event_id % 19 = 0 then null else event_id % 10 = 0 or (user_id % 11 = 0 and event_id % 3 = 0) end",
    "entropy_passed": "case when event_id % 11 = 0 then null else event_id % 6 <> 0 end",
    "coherence_passed": "case when event_id % 31 = 0 then null else event_id % 8 <> 0 end",
    "optimization_veto_passed": "case when event_id % 37 = 0 then null else event_id % 9 <> 0 end",
    "epistemic_humility_passed": "case when event_id % 41 = 0 then null else event_id % 14 <> 0 end",
    "action_success": "case when event_id % 43 = 0 then null else event_id % 15 <> 0 end",
    "fragility": "case when event_id % 12 = 0 then null else (event_id + user_id) % 5 = 0 end",
    "has_positive_moment": "event_id % 16 = 0",
    "public_sample": "event_id % 20 = 0",
    "pii_scrubbed": "event_id % 3 <> 0 and event_id % 18 <> 1",
    "signature_key_id": "'k' || cast(user_id % 7 as varchar(20))",
    "primary_model": "'m' || cast(event_id % 4 as varchar(20))",
    "thought_depth": "cast(event_id % 5 as int)",
    "tokens_total": "100 + (event_id * 13) % 900",
    "llm_calls": "case when event_id % 14 = 0 then null else event_id % 6 end",
    "cost_cents": "cast((event_id * 7) % 500 as double) / 100",
    "processing_ms": "50 + (event_id * 11) % 3000",
    "is_recursive": "case when event_id % 27 = 0 then null else event_id % 21 = 0 end",
    "has_execution_error": "case when event_id % 33 = 0 then null else event_id % 25 = 0 end",
    "batch_id": "'b' || cast(user_id % 40 as varchar(20))",
    "snapshot_and_context": _SNAPSHOT,
    "thought_start": _START,
    "conscience_result": _CHECKS,
    "models_used": """case event_id % 5 when 0 then null when 1 then '"m1"' else '["m' || cast(event_id % 4 as varchar(20)) || '", "m9"]' end""",
    "idma_result": "case when event_id % 4 = 0 then null when event_id % 30 = 1 then '{\"source\": \"HE-300 Benchmark\"}' else '{\"source\": \"live\"}' end",
    **{column: _passed(i, column) for i, column in enumerate(GATES.values())},
}
#: traces before their sequence numbers
_BARE_SQL = "select " + ", ".join(f"{sql} as {name}" for name, sql in COLUMNS.items()) + " from events"
#: a number is skipped behind every trace of such an id, so chains have gaps though no trace is left out
_SKIPS = "event_id % 97 = 0"
TRACE_SQL = f"""select *, row_number() over w + cast(coalesce(sum(case when {_SKIPS} then 1 else 0 end) over (partition by agent_id_hash order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as audit_sequence_number
    from ({_BARE_SQL}) bare window w as (partition by agent_id_hash order by ts, event_id)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trace, all of them; sequence numbers have gaps.

    The numbering is a window that Spark drops from plans which do not use it.
    """
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(TRACE_SQL)


def with_traces(sql: str) -> str:
    """DuckDB SQL over ``tr``, the canonical traces."""
    return f"with tr as ({TRACE_SQL}) {sql}" if not sql.lstrip().lower().startswith("with ") else f"with tr as ({TRACE_SQL}), {sql.lstrip()[5:]}"

#: telemetry and other tables derived from ``events`` in the same way
DERIVED = {
    "logs": """select event_id as log_id, cast(ts as timestamp) as ts, case when user_id % 5 = 4 then 'billing' else 'svc' || cast(user_id % 5 as varchar(20)) end as service,
        case when event_type = 'error' then case when event_id % 3 = 0 then 'CRITICAL' else 'ERROR' end when event_id % 7 = 0 then 'WARNING' else 'INFO' end as level,
        case event_id % 9 when 0 then 'payment failed for order' when 1 then 'POST /v1/billing/charges 200' when 2 then 'GET /v1/billing/credits/check 200' when 3 then 'timeout after 30s' when 4 then 'POST /v1/billing/litellm/usage 200'
             when 5 then 'GET /v1/integrity 200' when 6 then 'GET /health 200' when 7 then 'oauth sign-in' else 'started' end as message,
        'agent' || cast(user_id % 50 as varchar(20)) as agent from events""",
    "points": """select 'agent' || cast(user_id % 50 as varchar(20)) as agent,
        case event_id % 10 when 0 then 'requests.total' when 1 then 'errors.total' when 2 then 'system.error_rate' when 3 then 'system.uptime' when 4 then 'system.healthy'
             when 5 then 'service.requests' when 6 then 'service.errors' when 7 then 'service.error_rate' when 8 then 'service.uptime' else 'service.healthy' end as metric,
        cast(ts as timestamp) as ts,
        case event_id % 10 when 0 then cast((event_id * 3) % 1000 as double) when 1 then cast((event_id * 7) % 50 as double) when 4 then cast(user_id % 2 as double) when 9 then cast(user_id % 2 as double)
             when 2 then cast((event_id * 3) % 101 as double) / 100 when 7 then cast((event_id * 7) % 101 as double) / 100 else cast((event_id * 11) % 5000 as double) / 8 end as value,
        case when event_id % 10 < 5 or event_id % 33 = 0 then null else 'svc' || cast(user_id % 5 as varchar(20)) end as service, event_id from events""",
    "spans": """select 'tr' || cast(cast((event_id - event_id % 3) / 3 as bigint) as varchar(20)) as trace_id, event_id as span_id, 'svc' || cast(user_id % 5 as varchar(20)) as service, cast(ts as timestamp) as started,
        (event_id * 977) % 5000000 as duration_us, case when event_type = 'error' then 'ERROR' when event_id % 8 = 0 then 'UNSET' when event_id % 21 = 0 then null else 'OK' end as status from events""",
    "checks": """select cast(ts as timestamp) as ts, 'r' || cast(user_id % 9 as varchar(20)) as region, case when event_id % 4 = 3 then 'proxy' else 'svc' || cast(event_id % 4 as varchar(20)) end as service,
        case when event_id % 4 = 3 then case event_id % 3 when 0 then 'openrouter' when 1 then 'groq' else 'together' end else 'internal' end as provider,
        case when event_id % 4 = 3 and user_id % 9 = 3 then 'outage' when event_id % 4 = 3 and user_id % 9 = 4 then case when event_id % 3 = 0 then 'outage' else 'degraded' end
             when event_type = 'error' and user_id % 9 < 3 then 'outage' when event_id % 11 = 0 then 'degraded' else 'operational' end as status, cast((event_id * 17) % 900 as double) as latency_ms, event_id from events""",
    "batches": """select distinct 'b' || cast(user_id % 40 as varchar(20)) as batch_id, '{"deployment_region": "r' || cast(user_id % 4 as varchar(20)) || '", "deployment_type": "prod", "agent_role": "helper", "user_timezone": "tz' || cast(user_id % 5 as varchar(20)) || '", "user_latitude": "' || cast(user_id % 20 as varchar(20)) || '.5", "user_longitude": -7}' as correlation_metadata
        from events where user_id % 40 <> 7""",
    "agents": """select distinct 'agent' || cast(user_id % 50 as varchar(20)) as agent, user_id % 50 % 4 <> 0 as wbd_enabled, user_id % 50 % 5 <> 1 as pdma_enabled, cast(20 + user_id % 50 * 7 % 90 as double) / 100 as compliance_score,
        'mgr' || cast(user_id % 50 % 4 as varchar(20)) as manager_id from events""",
    "managers": "select distinct 'mgr' || cast(user_id % 50 % 4 as varchar(20)) as manager_id, user_id % 50 % 4 <> 2 as enabled, case when user_id % 50 % 4 > 0 then 'refused' end as last_error from events where user_id % 50 % 4 <> 3",
    "telemetry": "select distinct 'agent' || cast(user_id % 50 as varchar(20)) as agent, 10 * (1 + user_id % 50 % 6) as every_seconds from events where user_id % 50 % 3 <> 0",
    "visibility": "select distinct 'agent' || cast(user_id % 50 as varchar(20)) as agent, user_id % 50 % 2 = 0 as visible from events where user_id % 50 % 7 <> 0",
    "pdma": "select event_id as pdma_id, 'agent' || cast(user_id % 50 as varchar(20)) as agent, cast(ts as timestamp) as ts, 1 + event_id % 3 + user_id % 50 % 3 as risk_magnitude, case when event_id % 4 = 0 then 'open' else 'closed' end as status from events",
    "wbd": "select event_id as wbd_id, 'agent' || cast(user_id % 50 as varchar(20)) as agent, cast(ts as timestamp) as ts, case when event_id % 3 = 0 and user_id % 50 % 3 > 0 then 'PENDING' else 'RESOLVED' end as status, cast(null as varchar(20)) as resolution from events",
    "sunsets": "select distinct 'agent' || cast(user_id % 50 as varchar(20)) as agent, case user_id % 50 % 4 when 0 then 'INITIATED' when 1 then 'IN_PROGRESS' else 'COMPLETED' end as status, timestamp '2024-01-01 00:00:00' as ts, user_id % 50 as sunset_id from events",
    "creations": "select event_id as entry_id, 'agent' || cast(user_id % 50 as varchar(20)) as agent, cast(ts as timestamp) as ts, event_id % 11 as creator_weight, event_id % 7 as influence_weight, event_id % 5 as risk from events",
    "configs": "select distinct 'agent' || cast(user_id % 50 as varchar(20)) as agent, user_id % 50 % 6 <> 0 as enabled, timestamp '2024-01-31 00:00:00' - interval '1' hour * cast(user_id % 50 * 2 as int) as last_collection from events",
    "failures": "select event_id as failure_id, case when event_id % 5 = 0 then 'scheduler' else 'agent:agent' || cast(user_id % 50 as varchar(20)) end as source, cast(ts as timestamp) as ts, case when event_id % 3 = 0 then cast(ts as timestamp) end as resolved_at from events where event_type = 'error'",
    "calls": """select event_id as call_id, 't' || cast(event_id as varchar(20)) as trace_id, 'th' || cast(event_id as varchar(20)) as thought_id, 'a' || cast(user_id as varchar(20)) as agent_id_hash, cast(ts as timestamp) as ts, 'm' || cast(event_id % 4 as varchar(20)) as model,
        case when event_id % 9 = 0 then 'error' else 'ok' end as status, case event_id % 3 when 0 then 'DMA_RESULTS' when 1 then 'ASPDMA_RESULT' else 'IDMA_RESULT' end as parent_event_type, event_id % 2 as parent_attempt_index, 100 + event_id * 13 % 900 as tokens from events""",
    "keys": """select distinct 'k' || cast(user_id % 70 as varchar(20)) as key_id, 'a' || cast(user_id % 70 as varchar(20)) as agent_id_hash, case when user_id % 70 % 2 = 0 then 'ed25519' else 'ml-dsa' end as algorithm, user_id % 70 % 5 = 0 as revoked, user_id % 70 % 3 = 0 as pqc_completed,
        timestamp '2024-01-01 00:00:00' + interval '1' hour * cast(user_id % 70 % 20 as int) as ts from events""",
    "attestations": "select event_id as attestation_id, 'k' || cast(user_id % 70 as varchar(20)) as attesting_key_id, 'k' || cast(event_id % 70 as varchar(20)) as attested_key_id, case when event_id % 2 = 0 then 'vouch' else 'delegate' end as attestation_type, cast(ts as timestamp) as ts from events",
    "revocations": "select event_id as revocation_id, 'k' || cast(event_id % 70 as varchar(20)) as revoked_key_id, 'k' || cast(user_id % 70 as varchar(20)) as revoking_key_id, event_id % 3 = 0 as pqc_completed, cast(ts as timestamp) as ts from events",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of ``DERIVED``."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(DERIVED[name])


def with_derived(sql: str, *names: str) -> str:
    head = ", ".join(f"{n} as ({DERIVED[n]})" for n in names)
    return f"with {head} {sql}" if not sql.lstrip().lower().startswith("with ") else f"with {head}, {sql.lstrip()[5:]}"
