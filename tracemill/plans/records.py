"""Registered filter, ingest and privacy queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions import privacy as P
from tracemill.operators import filters as L
from tracemill.operators import ingest as I  # noqa: E741
from tracemill.operators.views import task_class
from tracemill.plans.common import Registry, r, second, table, tidy
from tracemill.sources import otlp
from tracemill.sources.adapter import AS_OF, derived, traces, with_derived, with_traces

registry = Registry()
on, on_table = registry.on_traces, registry.on_table
_FEW = ["trace_id", "agent_id_hash", "selected_action", "csdma"]
_FEW_SQL = f"trace_id, agent_id_hash, selected_action, {r('csdma')} as csdma"

on(
    "list_traces",
    lambda tr: L.list_traces(tr, deployment_domain="p1", min_csdma=0.2, max_csdma=0.9, signature_verified=True, since="2024-01-10", until=AS_OF, cognitive_state=None).select(*_FEW),
    f"select {_FEW_SQL} from tr where deployment_domain = 'p1' and tr.csdma >= 0.2 and tr.csdma <= 0.9 and signature_verified and ts >= timestamp '2024-01-10' and ts <= timestamp '{AS_OF}'",
)
on(
    "scope_partner",
    lambda tr: L.scope(tr.withColumn("partner_access", F.when(F.col("fragility"), F.array(F.lit("p7"), F.lit("p8")))), "partner", ["a1", "a2"], "p8").select(*_FEW),
    f"select {_FEW_SQL} from tr where agent_id_hash in ('a1', 'a2') or public_sample or coalesce(fragility, false)",
)
on("scope_public", lambda tr: L.scope(tr, "public", []).select(*_FEW), f"select {_FEW_SQL} from tr where public_sample")
_DMA = """case when event_id % 4 = 0 then null else '{"csdma": {"plausibility_score": 0.5, "prompt_used": "secret"}, "dsdma": {"domain": "' || dsdma_domain || '"}, "note": "plain"}' end"""


def _unpacked(df: DataFrame) -> DataFrame:
    """Nested results as one line each, so that they compare as text."""
    inner = F.from_json("dma_results", "map<string,string>")
    return df.withColumn("dma_results", F.array_join(F.transform(F.array_sort(F.map_entries(inner)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


for _level in ("partner", "public"):
    on(
        f"mask_{_level}",
        lambda tr, level=_level: _unpacked(L.mask_fields(tr.select(*_FEW, F.expr(_DMA).alias("dma_results"), F.lit("sig").alias("audit_signature")), level)),
        f"select {_FEW_SQL}, " + ("" if _level == "partner" else "'sig' as audit_signature, ") + "case when event_id % 4 = 0 then null else " + ("'csdma={\"plausibility_score\":\"0.5\"};dsdma={\"domain\":\"' || dsdma_domain || '\"};note=plain'" if _level == "partner" else "'csdma={\"plausibility_score\":0.5,\"prompt_used\":\"secret\"};dsdma={\"domain\":\"' || dsdma_domain || '\"};note=plain'") + " end as dma_results from tr",
    )
on("page", lambda tr: L.page(tr.select(*_FEW), [F.desc("csdma"), F.col("trace_id")], 50, 100), f"select {_FEW_SQL}, count(*) over () as total, count(*) over () > 150 as has_more from tr order by tr.csdma desc, trace_id limit 50 offset 100")
on("keyset_page", lambda tr: L.keyset_page(tr, ("2024-01-20 00:00:00", "t5"), 40).select(*_FEW), f"select {_FEW_SQL} from tr where ts < timestamp '2024-01-20' or (ts = timestamp '2024-01-20' and trace_id < 't5') order by ts desc, trace_id desc limit 40")
_THOUGHT = """case event_id % 3 when 0 then '{"system_snapshot": {"current_thought_summary": {"content": "@user said: what is ' || event_id || ' ?\\nmore"}}}' when 1 then '{"system_snapshot": {"current_thought_summary": {"content": "first line ' || event_id || '"}}}' end"""
_OBSERVED = "case event_id % 3 when 0 then 'what is ' || event_id || ' ?' when 1 then 'first line ' || event_id else nullif(agent_id_hash, '') end"
on(
    "group_by_task",
    lambda tr: L.group_by_task(tr.withColumn("snapshot_and_context", F.expr(_THOUGHT.replace("\\", "\\\\"))).withColumn("action_rationale", F.col("agent_id_hash"))),
    f"""with t as (select *, coalesce(nullif(task_id, ''), 'standalone-' || trace_id) as task, {_OBSERVED} as observed from tr)
        select task, count(*) as n, arg_min(trace_id, (ts, event_id)) filter (where thought_depth = 0) as seed, arg_min(agent_name, (ts, event_id)) filter (where thought_depth = 0) as agent,
               {second('min(ts) filter (where thought_depth = 0)')} as started_at, arg_min(observed, (ts, event_id)) filter (where thought_depth = 0) as observation from t group by task""",
)
on("task_traces", L.task_traces, f"select coalesce(nullif(task_id, ''), 'standalone-' || trace_id) as task, {second('ts')} as ts, trace_id, thought_depth, agent_id_hash, selected_action from tr")
on_table(
    "conversations_by_task",
    "conversations",
    L.conversations_by_task,
    r"select conv_id, count(*) as turns, coalesce(nullif(trim(regexp_extract(arg_min(text, turn), 'said:([^\n]*)', 1)), ''), nullif(left(split_part(arg_min(text, turn), chr(10), 1), 500), ''), arg_max(role, turn)) as observation, arg_max(role, turn) as last_role from conversations group by conv_id",
)
on("window_filter", lambda tr: L.window_filter(tr, "7d", AS_OF).select(*_FEW), f"select {_FEW_SQL} from tr where ts > timestamp '{AS_OF}' - interval 7 day and ts <= timestamp '{AS_OF}'")
on_table("exclude_benchmark", "documents", lambda d: L.exclude_benchmark(d, "text").groupBy("source").agg(F.count("*").alias("n")), "select source, count(*) as n from documents where coalesce(not contains(lower(text), 'benchmark'), true) group by source")
_ENTRY = ["trace_id", "audit_sequence_number", "selected_action"]


def _sealed(tr: DataFrame) -> DataFrame:
    """A ledger with stored hashes; some entries were changed after they were sealed, one action and one link in a hundred."""
    order = Window.partitionBy("agent_id_hash").orderBy("audit_sequence_number", "trace_id")
    linked = tr.select("agent_id_hash", "event_id", *_ENTRY).withColumn("prev_hash", F.coalesce(F.sha2(F.lag("trace_id").over(order), 256), F.lit("genesis")))
    own = F.sha2("trace_id", 256)  # stands for a hash that an earlier writer stored
    return linked.withColumn("entry_hash", F.when(F.col("event_id") % 100 == 7, own).otherwise(L.seal(_ENTRY, F.col("prev_hash"))))


on(
    "ledger_chain",
    lambda tr: L.ledger_chain(tr.select("agent_id_hash", *_ENTRY), "agent_id_hash", ["audit_sequence_number", "trace_id"], _ENTRY),
    """with h as (select agent_id_hash, trace_id, audit_sequence_number, selected_action, sha256(concat_ws('|', trace_id, cast(audit_sequence_number as varchar), selected_action)) as entry_hash from tr)
       select *, coalesce(lag(entry_hash) over (partition by agent_id_hash order by audit_sequence_number, trace_id), 'genesis') as prev_hash, true as is_intact from h""",
)
on(
    "ledger_verify",
    lambda tr: L.ledger_chain(_sealed(tr), "agent_id_hash", ["audit_sequence_number", "trace_id"], _ENTRY, ("prev_hash", "entry_hash")).select("agent_id_hash", "trace_id", "expected_prev", "is_intact"),
    """with p as (select *, coalesce(sha256(lag(trace_id) over w), 'genesis') as prev_hash from tr window w as (partition by agent_id_hash order by audit_sequence_number, trace_id)),
            e as (select *, case when event_id % 100 = 7 then sha256(trace_id) else sha256(concat_ws('|', prev_hash, trace_id, cast(audit_sequence_number as varchar), selected_action)) end as entry_hash from p),
            x as (select *, coalesce(lag(entry_hash) over (partition by agent_id_hash order by audit_sequence_number, trace_id), 'genesis') as expected_prev from e)
       select agent_id_hash, trace_id, expected_prev, prev_hash = expected_prev and event_id % 100 <> 7 as is_intact from x""",
)
on("cohorts", L.cohorts, "select distinct deployment_domain, dsdma_domain from tr")
on(
    "apply_updates",
    lambda tr: L.apply_updates(
        tr.select("trace_id", "public_sample", "trace_level"),
        tr.select("trace_id", F.when(F.col("has_positive_moment"), True).alias("public_sample"), F.when(F.col("csdma") > 0.8, "first").alias("trace_level"), F.lit(1).alias("at"), F.array().cast("array<string>").alias("cleared"))
        .unionByName(tr.select("trace_id", F.lit(None).cast("boolean").alias("public_sample"), F.when(F.col("csdma") > 0.9, "second").alias("trace_level"), F.lit(2).alias("at"), F.when(F.col("csdma") < 0.1, F.array(F.lit("trace_level"))).alias("cleared"))),
        ["trace_id"], "at", "cleared",
    ),
    "select trace_id, has_positive_moment or public_sample as public_sample, case when csdma < 0.1 then null when csdma > 0.9 then 'second' when csdma > 0.8 then 'first' else trace_level end as trace_level from tr",
)
on(
    "change_access",
    lambda tr: L.change_access(
        tr.select("trace_id", F.when(F.col("public_sample"), F.array(F.lit("p1"), F.lit("p2"))).alias("partner_access")),
        tr.where("signature_verified").select("trace_id", F.when(F.col("csdma") < 0.3, "add").when(F.col("csdma") < 0.6, "remove").otherwise("set").alias("action"), F.array(F.lit("p2"), F.lit("p3")).alias("partner_ids"), F.lit(1).alias("at"))
        .unionByName(tr.where("fragility").select("trace_id", F.lit("remove").alias("action"), F.array(F.lit("p3")).alias("partner_ids"), F.lit(2).alias("at"))),
    ),
    """with a as (select *, case when public_sample then ['p1', 'p2'] end as held from tr),
            b as (select *, case when not signature_verified then held when csdma < 0.3 then case when public_sample then ['p1', 'p2', 'p3'] else ['p2', 'p3'] end when csdma < 0.6 then case when public_sample then ['p1'] else [] end else ['p2', 'p3'] end as first from a)
       select trace_id, array_to_string(case when coalesce(fragility, false) then list_filter(coalesce(first, []), lambda x: x <> 'p3') else first end, ',') as partner_access from b""",
)
on(
    "settle_alerts",
    lambda tr: L.settle_alerts(
        tr.select(F.col("trace_id").alias("alert_id"), F.lit(False).alias("acknowledged"), F.lit(None).cast("string").alias("acknowledged_by"), F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("string").alias("resolution_notes")),
        tr.where("conscience_passed").select(F.col("trace_id").alias("alert_id"), F.lit("acknowledge").alias("action"), F.col("agent_name").alias("by"), "ts", F.lit(None).cast("string").alias("notes"))
        .unionByName(tr.where("action_success").select(F.col("trace_id").alias("alert_id"), F.lit("resolve").alias("action"), F.col("agent_id_hash").alias("by"), "ts", F.col("selected_action").alias("notes"))).withColumnRenamed("ts", "at"),
    ),
    """select trace_id as alert_id, coalesce(conscience_passed, false) as acknowledged, case when conscience_passed then agent_name end as acknowledged_by, coalesce(action_success, false) as resolved,
              case when action_success then agent_id_hash end as resolved_by, case when action_success then selected_action end as resolution_notes from tr""",
)
on(
    "erase_counts",
    lambda tr: L.erase({"traces": tr, "alerts": tr.where("action_was_overridden")}, tr.where("event_id % 50 = 0").select("agent_id_hash", "signature_key_id"), ["agent_id_hash", "signature_key_id"])[1],
    """with w as (select distinct agent_id_hash, signature_key_id from tr where event_id % 50 = 0) select 'traces' as store, count(*) as erased from tr semi join w using (agent_id_hash, signature_key_id)
       union all select 'alerts', count(*) from tr semi join w using (agent_id_hash, signature_key_id) where action_was_overridden""",
)
on(
    "erase_kept",
    lambda tr: L.erase({"traces": tr}, tr.where("event_id % 50 = 0").select("agent_id_hash", "signature_key_id"), ["agent_id_hash", "signature_key_id"])[0]["traces"].select(*_FEW),
    f"with w as (select distinct agent_id_hash, signature_key_id from tr where event_id % 50 = 0) select {_FEW_SQL} from tr anti join w using (agent_id_hash, signature_key_id)",
)
on(
    "append_new",
    lambda tr: L.append_new(tr.where("event_id % 3 <> 0").select("trace_id", "ts"), tr.where("event_id % 2 = 0").select("trace_id", "ts"), ["trace_id", "ts"]).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")),
    "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from tr where event_id % 3 <> 0 or event_id % 2 = 0 group by strftime(ts, '%Y-%m-%d')",
)
on(
    "upsert_last",
    lambda tr: L.upsert_last(tr.where("event_id % 2 = 0").select("agent_id_hash", "event_id", "csdma"), tr.where("event_id % 2 = 1").select("agent_id_hash", "event_id", "csdma"), ["agent_id_hash"], "event_id"),
    f"select agent_id_hash, max(event_id) as event_id, {r('arg_max(csdma, event_id)')} as csdma from tr group by agent_id_hash",
)
on("apply_retention", lambda tr: L.apply_retention(tr, AS_OF, 14).groupBy("dsdma_domain").agg(F.count("*").alias("n")), f"select dsdma_domain, count(*) as n from tr where ts >= timestamp '{AS_OF}' - interval 14 day group by dsdma_domain")
#: batches of traces by id, with what became of them
_BATCHES = "select batch_id, min(ts) as batch_ts, count(*) % 7 as received, count(*) filter (signature_verified) % 3 as accepted, count(*) % 2 as rejected from tr group by batch_id"


def _released(tr: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    batches = tr.groupBy("batch_id").agg(F.min("ts").alias("batch_ts"), (F.count("*") % 7).alias("received"), (F.count_if("signature_verified") % 3).alias("accepted"), (F.count("*") % 2).alias("rejected"))
    return L.release_filter(tr.select(*_FEW, "ts", "signature_verified"), batches, "2024-01-15")


_LOOP = "accepted = 0 and received <= 4 and rejected > 0"
on("release_traces", lambda tr: _released(tr)[0], f"select {_FEW_SQL}, {second('ts')} as ts, signature_verified from tr where ts >= timestamp '2024-01-15' and signature_verified")
on("release_batches", lambda tr: _released(tr)[1], f"with b as ({_BATCHES}) select * replace ({second('batch_ts')} as batch_ts) from b where not ({_LOOP}) and b.batch_ts >= timestamp '2024-01-15'")
on(
    "release_filter",
    lambda tr: _released(tr)[2],
    f"""with b as ({_BATCHES}) select (select count(*) from tr where ts >= timestamp '2024-01-15' and signature_verified) as kept, (select count(*) from tr where ts >= timestamp '2024-01-15' and not signature_verified) as dropped_unverified,
        (select count(*) from tr where ts < timestamp '2024-01-15') as dropped_pre_cutoff, (select count(*) from b where not ({_LOOP}) and batch_ts >= timestamp '2024-01-15') as kept_batches, (select count(*) from b where {_LOOP}) as dropped_retry_loop""",
)
_QA_EVENTS = "select trace_id, event_id, ts, case when event_id % 5 < 3 then 'THOUGHT_START' else 'ACTION_RESULT' end as event_type, schema_version, trace_level, '{\"channel_id\": \"' || coalesce(channel_id, 'none') || '\"}' as payload from tr"
_QA_SPAN = {"since": "2024-01-03 00:00:00", "until": "2024-01-28 00:00:00"}


def _qa(part: int):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        traces(spark, sf_dir).createOrReplaceTempView("tr")
        return tidy(L.qa_export(spark.sql(_QA_EVENTS), derived(spark, sf_dir, "calls").select("call_id", "trace_id", "ts", "model", "status"), "1.9.1", **_QA_SPAN)[part])

    return run


_QA_TRACES = f"""te as ({_QA_EVENTS}), qa_traces as (select distinct trace_id from te where schema_version = '1.9.1' and event_type = 'THOUGHT_START' and payload ->> '$.channel_id' like 'model\\_eval\\_%' escape '\\'
    and trace_level in ('detailed', 'full_traces') and ts >= timestamp '{_QA_SPAN["since"]}' and ts <= timestamp '{_QA_SPAN["until"]}')"""
registry.queries["qa_export"], registry.queries["qa_export_calls"] = _qa(0), _qa(1)
registry.sql["qa_export"] = with_traces(f"with {_QA_TRACES} select trace_id, event_id, {second('ts')} as ts, event_type, schema_version, trace_level, payload from te join qa_traces using (trace_id)")
registry.sql["qa_export_calls"] = with_derived(with_traces(f"with {_QA_TRACES} select call_id, trace_id, {second('ts')} as ts, model, status from calls join qa_traces using (trace_id)"), "calls")
registry.queries["manifest"] = lambda spark, d: L.manifest({n: table(spark, d, n) for n in ("events", "orders", "documents")})


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and digest of an export, and whether it reads back whole."""
    folder = otlp.scratch(spark)
    rows = traces(spark, sf_dir).select("trace_id", "agent_id_hash", "ts", "selected_action")
    otlp.export_jsonl({"traces": rows}, folder)
    made = L.file_manifest(spark, {"traces": f"{folder}/traces"}, {"table": "traces", "columns": "4"})
    back = spark.read.schema(rows.schema).json(f"{folder}/traces").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("ids"))
    return tidy(made.select("name", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"), F.length("sha256").alias("digits"), F.element_at("parameters", "table").alias("parameter")).join(back, how="cross"))


registry.queries["export_jsonl"] = _written
registry.sql["export_jsonl"] = with_traces("select 'traces' as name, true as has_files, true as has_bytes, 64 as digits, 'traces' as parameter, count(*) as n, count(distinct trace_id) as ids from tr")


def _kept_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated store of all traces, read back by day."""
    folder = otlp.scratch(spark)
    otlp.write_traces(traces(spark, sf_dir).select("trace_id", "agent_id_hash", "ts", "csdma"), folder)
    return tidy(spark.read.parquet(folder).groupBy("dt").agg(F.count("*").alias("n"), F.countDistinct("agent_id_hash").alias("agents"), F.avg("csdma").alias("csdma")))


registry.queries["write_traces"] = _kept_by_day
registry.sql["write_traces"] = with_traces(f"select strftime(ts, '%Y-%m-%d') as dt, count(*) as n, count(distinct agent_id_hash) as agents, {r('avg(tr.csdma)')} as csdma from tr group by all")

_N = lambda m: f"cast(e.event_id % {m} as varchar(20))"
#: components of traces derived from events: eight kinds of traces by event_id, with the data of each event
_DATA = {
    0: f"""'{{"thought_type": "standard", "thought_depth": ' || {_N(5)} || ', "task_description": "' || case e.event_id % 3 when 0 then 'Please verify who you are' when 1 then 'say GRATITUDE' else 'talk to 10.0.0.1' end || '"}}'""",
    1: f"""case when e.event_id % 2 = 0 then '{{"agent_name": "Ally", "cognitive_state": "work", "relevant_memories": [1, 2, 3], "gathered_context": "met in 1999 at a place", "conversation_history": ["hi", "<script>x</script>"]}}'
        else '{{"system_snapshot": {{"agent_identity": {{"agent_id": "id' || {_N(9)} || '"}}}}, "context_tokens": 0, "total_tokens": ' || {_N(700)} || '}}' end""",
    2: f"""'{{"csdma": {{"plausibility_score": ' || {_N(10)} || ', "prompt_used": "born 1955"}}, "dsdma": {{"domain_alignment": 0.5, "domain": "d' || {_N(3)} || '"}}, "pdma": {{"stakeholders": "a and b", "conflicts": null}}, "idma": {{"k_eff": 1.5, "correlation_risk": 0.25, "fragility_flag": true, "phase": "healthy"}}, "y": 1999}}'""",
    3: f"""'{{"selected_action": "' || case when e.event_id % 5 = 0 then '' else 'HandlerActionType.SPEAK' end || '", "action_rationale": "because of 2001", "selection_confidence": 0.' || {_N(10)} || ', "is_recursive": ' || case when e.event_id % 3 = 0 then 'true' else 'false' end || ', "evaluated_actions": ["a", "b"]}}'""",
    4: """case when e.event_id % 8 = 3 then '{"entropy_level": 0.25, "checks": [1, 2, 3], "conscience_passed": true}' when e.event_id % 8 = 2 then '{"entropy_level": 0, "epistemic_data": {"entropy_level": 0.75, "reasoning_transparency": 0.5}, "entropy_passed": false, "coherence_passed": true}' else '{}' end""",
    5: f"""'{{"action_executed": "X.TOOL", "execution_success": true, "execution_time_ms": 12.5, "tokens_total": "' || {_N(50)} || '.9", "cost_cents": 0.5' || case when e.event_id % 8 = 2 then ', "has_positive_moment": "yes"' else '' end || case when e.event_id % 3 = 0 then '' else ', "models_used": ["' || case when e.user_id % 9 = 0 then 'MockLLM' else 'real' end || '", null]' end || '}}'""",
    6: """'{"k_eff": 3.5, "correlation_risk": 0.5, "fragility_flag": false, "phase": "rigid"}'""",
}
EVENTS_SQL = f"""select 't' || cast(e.event_id as varchar(20)) as trace_id, case when e.event_id % 8 = 0 then 'startup' when e.event_id % 8 = 7 and v.i = 0 then 'WEIRD' else v.event_type end as event_type, v.i as i, e.user_id as user_id, e.event_id as event_id,
  cast(e.ts as timestamp) as ts, cast(e.ts as timestamp) + interval '1' second * v.i as event_ts, case e.event_id % 3 when 0 then 'generic' when 1 then 'detailed' else 'full_traces' end as trace_level, 'b' || cast(e.user_id % 20 as varchar(20)) as batch_id,
  'k' || cast(e.user_id % 7 as varchar(20)) as signature_key_id, 'task-' || {_N(40)} as task_id, case when e.event_id % 8 = 0 then '{{}}' else case v.i {" ".join(f"when {i} then {d}" for i, d in _DATA.items())} end end as data
  from events e join (values (0, 'THOUGHT_START'), (1, 'SNAPSHOT_AND_CONTEXT'), (2, 'DMA_RESULTS'), (3, 'ASPDMA_RESULT'), (4, 'CONSCIENCE_RESULT'), (5, 'ACTION_RESULT'), (6, 'IDMA_RESULT')) as v(i, event_type)
    on v.i <= case e.event_id % 8 when 0 then 0 when 1 then 6 when 6 then 2 else 5 end and v.i >= case e.event_id % 8 when 5 then 1 else 0 end"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the numbers of their parts exploded: no join that compares ranges."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    names = ", ".join(f"'{x}'" for x in (*I.SIX, I.SEVENTH))
    parts = f"(select *, explode(sequence(case event_id % 8 when 5 then 1 else 0 end, case event_id % 8 when 0 then 0 when 1 then 6 when 6 then 2 else 5 end)) as i from events)"
    exploded = EVENTS_SQL[: EVENTS_SQL.index("from events e join")].replace("v.i", "e.i").replace("v.event_type", f"element_at(array({names}), e.i + 1)")
    return spark.sql(f"{exploded} from {parts} e")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a corpus export reads back as: rows and the ends of each data set's order."""
    tr, folder = traces(spark, sf_dir), otlp.scratch(spark)
    up = _components(spark, sf_dir).where(F.col("event_type").isin(*I.CONNECTIVITY))
    tables = {
        "traces": tr.select("event_id", "trace_id", "agent_id_hash", "ts", "csdma"),
        "trace_batches": tr.groupBy("batch_id").agg(F.min("ts").alias("batch_timestamp"), F.count("*").alias("traces")),
        "public_keys": derived(spark, sf_dir, "keys").withColumnRenamed("ts", "created_at"),
        "connectivity_events": up.select("trace_id", "event_type", F.col("event_ts").cast("timestamp").alias("ts")),
        "trace_context": tr.select("event_id", "trace_id", task_class(F.col("channel_id"), F.col("cognitive_state"), F.col("task_id")).alias("task_class")),
    }
    otlp.export_corpus(tables, folder)
    shown = lambda c, df: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if df.schema[c].dataType.typeName() == "timestamp" else F.col(c).cast("string")
    parts = []
    for name, column in otlp.DATASETS.items():
        back = spark.read.schema(tables[name].schema).json(f"{folder}/{name}")
        parts.append(back.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min(shown(column, back)).alias("first"), F.max(shown(column, back)).alias("last")))
    return reduce(DataFrame.unionByName, parts)


_TEXT = "cast(event_id as varchar)"
registry.queries["export_corpus"] = _corpus
registry.sql["export_corpus"] = with_derived(
    with_traces(
        f"""with ev as ({EVENTS_SQL}), b as (select min(ts) as first_ts from tr group by batch_id), x as (
              select 'traces' as name, {_TEXT} as v from tr union all select 'trace_context', {_TEXT} from tr union all select 'trace_batches', {second('first_ts')} from b
              union all select 'public_keys', {second('ts')} from keys union all select 'connectivity_events', {second('cast(event_ts as timestamp)')} from ev where event_type in ('startup', 'shutdown'))
            select n.name, count(v) as n, min(v) as first, max(v) as last from (values ('traces'), ('trace_context'), ('trace_batches'), ('public_keys'), ('connectivity_events')) n(name) left join x using (name) group by n.name"""
    ),
    "keys",
)


def _on_components(name: str, build, sql: str | None) -> None:  # noqa: ANN001
    registry.queries[name] = lambda spark, d: tidy(build(_components(spark, d)))
    if sql:
        registry.sql[name] = f"with ev as ({EVENTS_SQL}) {sql}" if not sql.startswith("with ") else f"with ev as ({EVENTS_SQL}), {sql[5:]}"


_SIX = "['" + "', '".join(I.SIX) + "']"
_VERSION = f"""select trace_id, types, components, moment, case when len(list_filter(types, lambda x: x not in ('startup', 'shutdown'))) = 0 then 'connectivity' when list_has_all(types, list_append({_SIX}, 'IDMA_RESULT')) then '1.9.3'
    when not list_has_all({_SIX}, types) or len(types) < 4 then 'unknown' when moment then '1.9.1' when entropy then '1.9' else '1.8' end as version
    from (select trace_id, count(*) as components, list_sort(list(distinct event_type)) as types, bool_or(event_type = 'ACTION_RESULT' and data ->> '$.has_positive_moment' is not null) as moment, bool_or(event_type = 'CONSCIENCE_RESULT' and data ->> '$.entropy_level' is not null) as entropy from ev group by trace_id) t"""
_NEEDED = f"case when version = 'connectivity' then [] when version = '1.9.3' then list_append({_SIX}, 'IDMA_RESULT') else {_SIX} end"
_KNOWN = f"case when version = 'connectivity' then ['startup', 'shutdown'] when version = '1.9.3' then list_concat({_SIX}, ['IDMA_RESULT', 'TSASPDMA_RESULT']) else {_SIX} end"
_LEAST, _MOST = ("case when version = 'connectivity' then 1 when version = '1.9.3' then {} else 6 end".format(n) for n in (7, 8))
_VALID = f"""select *, len(errors) = 0 as is_valid from (select *, list_filter([case when version = 'unknown' then 'unknown_schema' end, case when version <> 'unknown' and components < {_LEAST} then 'too_few_components' end, case when missing <> '' then 'missing_event_types' end], lambda x: x is not null) as errors,
    list_filter([case when version <> 'unknown' and components > {_MOST} then 'too_many_components' end, case when extra <> '' then 'unexpected_event_types' end], lambda x: x is not null) as warnings from
    (select *, case when version = 'unknown' then '' else array_to_string(list_sort(list_filter({_NEEDED}, lambda x: not list_contains(types, x))), ',') end as missing, case when version = 'unknown' then '' else array_to_string(list_sort(list_filter(types, lambda x: not list_contains({_KNOWN}, x))), ',') end as extra from ({_VERSION}) v) m) e"""
_on_components("detect_schema_version", I.detect_schema_version, f"select trace_id, version, array_to_string(types, ',') as types, components from ({_VERSION}) v")
_on_components(
    "validate_schema",
    lambda ev: I.validate_schema(I.detect_schema_version(ev)),
    f"select trace_id, version, is_valid, array_to_string(errors, ',') as errors, array_to_string(warnings, ',') as warnings, missing, extra, array_to_string(types, ',') as types, components from ({_VALID}) v",
)
_on_components("scoring_eligible", lambda ev: I.scoring_eligible(I.detect_schema_version(ev)), f"select trace_id, version in ('1.9.1', '1.9.3') as eligible from ({_VERSION}) v")


def _of(event: str, path: str) -> str:
    """A value of a trace's event, in DuckDB."""
    return f"max(data ->> '$.{path}') filter (event_type = '{event}')"


def _typed(event: str, path: str, kind: str) -> str:
    x = _of(event, path)
    if kind == "bool":
        return f"case when lower({x}) in ('true', 'yes', '1') then true when lower({x}) in ('false', 'no', '0') then false end"
    return {"int": f"cast(floor(try_cast({x} as double)) as bigint)", "float": r(f"try_cast({x} as double)"), "string": x}[kind]


#: columns of the typed row, worked out from the events apart from the operator
_WIDE = {
    "trace_id": "trace_id", "components": "count(*)", "task_id": "max(task_id)", "agent_id_hash": "'unknown'", "trace_level": "max(trace_level)",
    "thought_type": _typed("THOUGHT_START", "thought_type", "string"), "thought_depth": _typed("THOUGHT_START", "thought_depth", "int"),
    "trace_type": f"case when lower({_of('THOUGHT_START', 'task_description')}) like '%verify%' then 'VERIFY_IDENTITY' when {_of('THOUGHT_START', 'task_description')} like '%GRATITUDE%' then 'EXPRESS_GRATITUDE' end",
    "agent_name": f"coalesce({_of('SNAPSHOT_AND_CONTEXT', 'agent_name')}, {_of('SNAPSHOT_AND_CONTEXT', 'system_snapshot.agent_identity.agent_id')})",
    "cognitive_state": _of("SNAPSHOT_AND_CONTEXT", "cognitive_state"),
    "csdma_plausibility_score": _typed("DMA_RESULTS", "csdma.plausibility_score", "float"), "dsdma_domain_alignment": _typed("DMA_RESULTS", "dsdma.domain_alignment", "float"), "dsdma_domain": _of("DMA_RESULTS", "dsdma.domain"),
    "pdma_stakeholders": _of("DMA_RESULTS", "pdma.stakeholders"), "pdma_conflicts": _of("DMA_RESULTS", "pdma.conflicts"),
    "idma_k_eff": r(f"try_cast(case when count(*) filter (event_type = 'IDMA_RESULT') > 0 then {_of('IDMA_RESULT', 'k_eff')} else {_of('DMA_RESULTS', 'idma.k_eff')} end as double)"),
    "idma_phase": f"case when count(*) filter (event_type = 'IDMA_RESULT') > 0 then {_of('IDMA_RESULT', 'phase')} else {_of('DMA_RESULTS', 'idma.phase')} end",
    "selected_action": f"case when {_of('ASPDMA_RESULT', 'selected_action')} like '%SPEAK' then 'SPEAK' when count(*) filter (event_type = 'ACTION_RESULT') > 0 then 'TOOL' end",
    "action_rationale": _of("ASPDMA_RESULT", "action_rationale"), "selection_confidence": _typed("ASPDMA_RESULT", "selection_confidence", "float"), "is_recursive": _typed("ASPDMA_RESULT", "is_recursive", "bool"),
    "entropy_level": r(f"coalesce(nullif(try_cast({_of('CONSCIENCE_RESULT', 'entropy_level')} as double), 0), try_cast({_of('CONSCIENCE_RESULT', 'epistemic_data.entropy_level')} as double))"),
    "reasoning_transparency": _typed("CONSCIENCE_RESULT", "epistemic_data.reasoning_transparency", "float"),
    "entropy_passed": _typed("CONSCIENCE_RESULT", "entropy_passed", "bool"), "coherence_passed": _typed("CONSCIENCE_RESULT", "coherence_passed", "bool"), "conscience_passed": _typed("CONSCIENCE_RESULT", "conscience_passed", "bool"),
    "action_success": _typed("ACTION_RESULT", "execution_success", "bool"), "processing_ms": _typed("ACTION_RESULT", "execution_time_ms", "float"), "has_positive_moment": _typed("ACTION_RESULT", "has_positive_moment", "bool"),
    "tokens_total": _typed("ACTION_RESULT", "tokens_total", "int"), "cost_cents": _typed("ACTION_RESULT", "cost_cents", "float"), "models_used": f"replace({_of('ACTION_RESULT', 'models_used')}, ' ', '')",
    "snapshot_at": second("max(event_ts) filter (event_type = 'SNAPSHOT_AND_CONTEXT')"), "action_result_at": second("max(event_ts) filter (event_type = 'ACTION_RESULT')"),
}
_WEIGHTS = {
    "memory_count": f"cast(json_array_length({_of('SNAPSHOT_AND_CONTEXT', 'relevant_memories')}) as bigint)",
    "context_tokens": f"coalesce(try_cast(nullif({_of('SNAPSHOT_AND_CONTEXT', 'context_tokens')}, '0') as bigint), try_cast(nullif({_of('SNAPSHOT_AND_CONTEXT', 'total_tokens')}, '0') as bigint), cast(floor(length({_of('SNAPSHOT_AND_CONTEXT', 'gathered_context')}) / 4) as bigint))",
    "conversation_turns": f"cast(json_array_length({_of('SNAPSHOT_AND_CONTEXT', 'conversation_history')}) as bigint)",
    "alternatives_considered": f"cast(json_array_length({_of('ASPDMA_RESULT', 'evaluated_actions')}) as bigint)",
    "conscience_checks_count": f"coalesce(cast(json_array_length({_of('CONSCIENCE_RESULT', 'checks')}) as bigint), nullif(count({_of('CONSCIENCE_RESULT', 'x')}), 0))".replace(f"count({_of('CONSCIENCE_RESULT', 'x')})", "count(*) filter (event_type = 'CONSCIENCE_RESULT' and data ->> '$.entropy_passed' is not null) + count(*) filter (event_type = 'CONSCIENCE_RESULT' and data ->> '$.coherence_passed' is not null)"),
}


def _stamped(ev: DataFrame) -> DataFrame:
    return ev.withColumn("timestamp", F.col("event_ts"))


_on_components("denormalise", lambda ev: I.denormalise(_stamped(ev)).withColumn("models_used", F.replace("models_used", F.lit(" "), F.lit(""))).select(*_WIDE, *_WEIGHTS), f"select {', '.join(f'{x} as {c}' for c, x in (_WIDE | _WEIGHTS).items())} from ev group by trace_id")
_on_components("observation_weights", I.observation_weights, f"select trace_id, {', '.join(f'{x} as {c}' for c, x in _WEIGHTS.items())} from ev group by trace_id")
_MODELS = "select trace_id, bool_or(event_type = 'ACTION_RESULT' and contains(lower(data ->> '$.models_used'), 'mock')) as mock from ev group by trace_id"
_ROUTE = f"select trace_id, case when version = 'unknown' then 'malformed' when version = 'connectivity' then 'connectivity' when mock then 'mock' else 'production' end as destination from ({_VERSION}) v join ({_MODELS}) m using (trace_id)"


def _routed(ev: DataFrame) -> DataFrame:
    models = ev.groupBy("trace_id").agg(F.from_json(F.max(F.when(F.col("event_type") == "ACTION_RESULT", F.get_json_object("data", "$.models_used"))), "array<string>").alias("models"))
    return I.route(I.detect_schema_version(ev), models)


_on_components("route", _routed, _ROUTE)


def _keys(ev: DataFrame) -> DataFrame:
    """A directory in which one key is missing, one revoked and one expired."""
    ids = ev.select(F.col("signature_key_id").alias("key_id")).distinct().where("key_id <> 'k6'")
    return ids.select("key_id", (F.col("key_id") == "k1").alias("revoked"), F.when(F.col("key_id") == "k2", F.lit("2024-01-10").cast("timestamp")).alias("expires"))


_STATE = f"""select v.trace_id, batch_id, level, version, errors, case when not is_valid then 'schema: ' || array_to_string(errors, ' ') when version <> 'connectivity' and key_status <> 'known' then 'key: ' || key_status when version <> 'connectivity' and level = 'full_traces' then 'no recogniser of names' end as reason, mock
    from ({_VALID}) v join (select trace_id, max(batch_id) as batch_id, max(trace_level) as level, max(case when signature_key_id = 'k6' then 'unknown' when signature_key_id = 'k1' then 'revoked' when signature_key_id = 'k2' and ts > timestamp '2024-01-10' then 'expired' else 'known' end) as key_status from ev group by trace_id) a using (trace_id) join ({_MODELS}) m using (trace_id)"""
_RESULT = f"select trace_id, batch_id, level, version, errors, reason, case when reason is not null then 'malformed' when version = 'connectivity' then 'connectivity' when mock then 'mock' else 'production' end as destination from ({_STATE}) s"


def _ingested(ev: DataFrame) -> dict[str, DataFrame]:
    return I.ingest(_stamped(ev), _keys(ev))


def _stored(ev: DataFrame) -> DataFrame:
    """Typed rows of both repositories, with what became of texts that were scrubbed and sanitised."""
    rows = _ingested(ev)["stored"]
    said = F.get_json_object("snapshot_and_context", "$.conversation_history[1]")
    shown = ["trace_id", "destination", "schema_version", "trace_level", "csdma_plausibility_score", "dsdma_domain", "idma_k_eff", "selected_action", "action_rationale", "entropy_level", "tokens_total"]
    return rows.select(*shown, F.get_json_object("snapshot_and_context", "$.gathered_context").alias("context"), said.alias("said"), F.get_json_object("dma_results", "$.y").alias("y"), F.get_json_object("dma_results", "$.csdma.prompt_used").alias("prompt"))


_YEAR = lambda text, year: f"case when max(level) = 'detailed' then replace({text}, '{year}', '[YEAR]') else {text} end"
_on_components("ingest_results", lambda ev: _ingested(ev)["results"], f"select trace_id, batch_id, destination, reason from ({_RESULT}) r")
_on_components(
    "ingest",
    _stored,
    f"""select trace_id, max(destination) as destination, max(version) as schema_version, max(trace_level) as trace_level, {", ".join(f"{_WIDE[c]} as {c}" for c in ("csdma_plausibility_score", "dsdma_domain", "idma_k_eff", "selected_action", "entropy_level", "tokens_total"))},
        {_YEAR(_of("ASPDMA_RESULT", "action_rationale"), 2001)} as action_rationale, {_YEAR(_of("SNAPSHOT_AND_CONTEXT", "gathered_context"), 1999)} as context, case when {_of("SNAPSHOT_AND_CONTEXT", "conversation_history")} is not null then '[XSS_REMOVED:xss_script]' end as said,
        {_of("DMA_RESULTS", "y")} as y, {_YEAR(_of("DMA_RESULTS", "csdma.prompt_used"), 1955)} as prompt from ev join ({_RESULT}) r using (trace_id) where destination in ('production', 'mock') group by trace_id""".replace("max(batch_id)", "max(ev.batch_id)"),
)
_on_components(
    "malformed_records",
    lambda ev: _ingested(ev)["malformed"].drop("sha256"),
    f"""select trace_id, any_value(version) as version, any_value(array_to_string(errors, ',')) as errors, any_value(reason) as reason, cast(sum(octet_length(encode(data))) as bigint) as bytes, count(*) as component_count, array_to_string(list_sort(list(distinct event_type)), ',') as event_types,
        case when any_value(len(errors)) = 0 then 'warning' else 'error' end as severity from ev join ({_RESULT}) r using (trace_id) where destination = 'malformed' group by trace_id""",
)
_on_components(
    "malformed_stats",
    lambda ev: I.malformed_stats(_ingested(ev)["malformed"]).drop("payloads"),
    f"with b as (select trace_id, any_value(len(errors)) as k, sum(octet_length(encode(data))) as bytes from ev join ({_RESULT}) r using (trace_id) where destination = 'malformed' group by trace_id) select count(*) as n, 0 as criticals, count(*) filter (k > 0) as errors, count(*) filter (k = 0) as warnings, cast(sum(bytes) as bigint) as bytes from b",
)
_on_components(
    "batch_accounting",
    lambda ev: I.batch_accounting(_ingested(ev)["results"]),
    f"""with r as ({_RESULT}) select batch_id, count(*) as received, count(*) filter (reason is null) as accepted, count(reason) as rejected, array_to_string(list_sort(list(distinct destination)), ',') as destinations, reasons
        from r left join (select batch_id, string_agg(reason || '=' || k, ',' order by reason || '=' || k) as reasons from (select batch_id, reason, count(*) as k from r where reason is not null group by all) c group by batch_id) x using (batch_id) group by batch_id, reasons""",
)
_on_components(
    "dedup_events",
    lambda ev: I.dedup_events(ev.unionByName(ev).select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("agent_id_hash"), "trace_id", F.lit(None).cast("string").alias("thought_id"), "event_type", F.lit(0).alias("attempt_index"), "ts")).groupBy("agent_id_hash").agg(F.count("*").alias("n")),
    "select agent_id_hash, count(*) as n from (select distinct 'a' || user_id as agent_id_hash, trace_id, event_type, ts from ev) d group by agent_id_hash",
)
on(
    "check_keys",
    lambda tr: I.check_keys(tr, tr.select(F.col("signature_key_id").alias("key_id")).distinct().where("key_id <> 'k6'").select("key_id", (F.col("key_id") == "k1").alias("revoked"), F.when(F.col("key_id") == "k2", F.lit("2024-01-10").cast("timestamp")).alias("expires"))),
    "select trace_id, case when signature_key_id = 'k6' then 'unknown' when signature_key_id = 'k1' then 'revoked' when signature_key_id = 'k2' and ts > timestamp '2024-01-10' then 'expired' else 'known' end as key_status from tr",
)
on(
    "trace_type",
    lambda tr: tr.select("trace_id", I.trace_type(F.col("task_id"), F.col("conscience_result")).alias("kind"), I.token_estimate(F.col("channel_id")).alias("estimate"), I.normalise_action(F.concat(F.lit("X."), F.nullif("selected_action", F.lit("TOOL"))), F.lit("X.NONE")).alias("action")),
    "select trace_id, case when contains(task_id, 'VERIFY_IDENTITY') then 'VERIFY_IDENTITY' when contains(upper(task_id), 'EXPRESS_GRATITUDE') then 'EXPRESS_GRATITUDE' end as kind, cast(floor(length(channel_id) / 4) as bigint) as estimate, case when selected_action = 'TOOL' then 'NONE' else selected_action end as action from tr",
)
on_table(
    "coarsen_location",
    "customer",
    lambda c: I.coarsen_location(c.select("c_custkey", ((F.col("c_custkey") % 720) / 4.0 - 90).alias("lat"), ((F.col("c_custkey") % 1440) / 4.0 - 180).alias("lon")), "lat", "lon"),
    f"select c_custkey, {r('round_even(((c_custkey % 720) / 4.0 - 90) / 0.5, 0) * 0.5')} as lat_cell, {r('round_even(((c_custkey % 1440) / 4.0 - 180) / 0.5, 0) * 0.5')} as lon_cell from customer",
)

_DOCS = ("doc_id", "text")


def _sql_rules(column: str) -> str:
    for pattern, replacement in P.LOG_RULES:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


on_table("redact_log", "documents", lambda d: d.select("doc_id", F.sha2(P.redact_log(F.col("text")), 256).alias("redacted"), P.hash_user(F.col("source")).alias("user")), f"select doc_id, sha256({_sql_rules('text')}) as redacted, left(sha256(source), 16) as \"user\" from documents")


def _marked(d: DataFrame) -> DataFrame:
    """Documents, each with a line of what every rule is for, by its number."""
    n = F.col("doc_id").cast("string")
    year = (F.lit(1690) + F.col("doc_id") % 350).cast("string")
    line = F.concat(F.lit("\nfile report_"), year, F.lit("_v in "), year, F.lit(" by u"), n, F.lit("@x.org, +1 555 123 4567, 10.0."), (F.col("doc_id") % 256).cast("string"), F.lit(".1, https://x.org/"), n, F.lit(", 123-45-6789, 4111 1111 1111 1111"), F.when(F.col("doc_id") % 3 == 0, ", password=1").otherwise(""))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), line).alias("text"), "source")


def _left(d: DataFrame) -> DataFrame:
    """Documents, each with what its marked line has for a gate behind the scrub: two years and a probe, no other numbers."""
    year = (F.lit(1690) + F.col("doc_id") % 350).cast("string")
    line = F.concat(F.lit("\nfile report_"), year, F.lit("_v in "), year, F.lit(" by"), F.when(F.col("doc_id") % 3 == 0, ", password=1").otherwise(""))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), line).alias("text"))


def _attacked(p: DataFrame) -> DataFrame:
    """Pages, each with signs of an attack by its number."""
    n = F.col("page_id") % 5
    tail = F.when(n == 0, " ../etc ").when(n == 1, " '; DROP TABLE x ").when(n == 2, " $(ls) `id` ").when(n == 3, " %00 ").otherwise("")
    return p.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), tail).alias("html"))


on_table("scrub_text", "documents", lambda d: _marked(d).select("doc_id", F.sha2(P.scrub_text(F.col("text")), 256).alias("scrubbed")))
on_table("redaction_counts", "documents", lambda d: P.redaction_counts(_marked(d).select(*_DOCS), "text").drop("text"))
_LEFT = r"""with m as (select doc_id, coalesce(text, '') || chr(10) || 'file report_' || (1690 + doc_id % 350) || '_v in ' || (1690 + doc_id % 350) || ' by' || case when doc_id % 3 = 0 then ', password=1' else '' end as t from documents)
    select doc_id from m where regexp_matches(t, '\b(?:1[7-9]\d{2}|20[0-1]\d|202[0-3])\b') or contains(lower(t), 'password=')"""
on_table("residue_gate", "documents", lambda d: P.residue_gate(_left(d), "text", ["password="])[1].select("doc_id"), _LEFT)
on_table("rescrub_report", "documents", lambda d: P.rescrub_report(_marked(d), "text", ["password=1"]))
on_table("scrub_by_level", "documents", lambda d: P.scrub_by_level(_marked(d).withColumn("level", F.element_at(F.array(F.lit("generic"), F.lit("detailed"), F.lit("full_traces")), (F.col("doc_id") % 3 + 1).cast("int"))), "text", "level").select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed"), "rejected"))


def attack_steps(source: str, placeholder) -> str:  # noqa: ANN001
    """CTEs of DuckDB that replace every sign of an attack in ``v`` of ``source``, one after the other; names in ``names``."""
    steps = [f"s0 as (select *, cast([] as varchar[]) as names from ({source}) x)"]
    for k, (name, pattern) in enumerate(P.ATTACKS):
        quoted = pattern.replace("'", "''")
        steps.append(f"s{k + 1} as (select * replace (regexp_replace(v, '{quoted}', '{placeholder(name)}', 'g') as v, case when regexp_matches(v, '{quoted}') then list_append(names, '{name}') else names end as names) from s{k})")
    return ", ".join(steps)


def attack_names(v: str) -> str:
    """The names of the signs in a text, joined, in DuckDB."""
    return "concat_ws(',', " + ", ".join("case when regexp_matches({}, '{}') then '{}' end".format(v, pattern.replace("'", "''"), name) for name, pattern in P.ATTACKS) + ")"


LAST_STEP = f"s{len(P.ATTACKS)}"
_PAGE_SQL = "select page_id, coalesce(html, '') || case page_id % 5 when 0 then ' ../etc ' when 1 then ' ''; DROP TABLE x ' when 2 then ' $(ls) `id` ' when 3 then ' %00 ' else '' end as v from pages"
_ESCAPED = """replace(replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
on_table("detect_patterns", "pages", lambda p: _attacked(p).select("page_id", P.detect_patterns(F.col("html")).alias("patterns")), f"select page_id, {attack_names('v')} as patterns from ({_PAGE_SQL}) x")
on_table(
    "sanitize_text",
    "pages",
    lambda p: _attacked(p).select("page_id", P.sanitize_text(F.col("html")).alias("s")).select("page_id", F.sha2("s.value", 256).alias("value"), "s.detections", "s.was_truncated", "s.was_modified"),
    f"""with {attack_steps(f"select page_id, v as o, case when length(v) > 100000 then left(v, 100000) || '[TRUNCATED]' else v end as v from ({_PAGE_SQL}) p", P._placeholder)}
        select page_id, sha256(case when v <> o then {_ESCAPED} else v end) as value, array_to_string(list_concat(case when length(o) > 100000 then ['size_limit_exceeded'] else [] end, names), ',') as detections, length(o) > 100000 as was_truncated, v <> o as was_modified from {LAST_STEP}""",
)


def _json() -> Column:
    """A page as nested JSON: an id, listed and other keys, a number."""
    return F.to_json(F.struct(F.col("url").alias("trace_id"), F.struct(F.col("html").alias("reasoning"), F.array("html", "url").alias("flags")).alias("a"), F.col("html").alias("free"), F.col("page_id").alias("y")))


on_table("scrub_json", "pages", lambda p: _attacked(p).select("page_id", _json().alias("j")).select("page_id", F.sha2(P.scrub_json(F.col("j")), 256).alias("scrubbed")))
on_table("sanitize_json", "pages", lambda p: _attacked(p).select("page_id", _json().alias("j")).select("page_id", P.sanitize_json(F.col("j")).alias("s")).select("page_id", F.sha2("s.value", 256).alias("value"), "s.detections", "s.modified", "s.truncated"))
on_table(
    "validate_number",
    "events",
    lambda e: e.select("event_id", P.validate_number(F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("value").cast("string")), 2.0, 10.0).alias("v")).select("event_id", "v.value", "v.issues"),
    f"select event_id, {r('case when event_id % 10 = 0 then null else least(10, greatest(2, value)) end')} as value, case when event_id % 10 = 0 then 'type' when value < 2 then 'low' when value > 10 then 'high' else '' end as issues from events",
)
on("scrub_stats", lambda tr: P.scrub_stats(tr, "2024-01-08", "2024-01-20"), "select trace_level, count(*) as n, count(*) filter (pii_scrubbed) as scrubbed from tr where ts >= timestamp '2024-01-08' and ts <= timestamp '2024-01-20' group by trace_level")

