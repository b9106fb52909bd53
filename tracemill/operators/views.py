"""Projections of canonical traces and the scalar rules in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.sources.adapter import GATES

#: fixed values: task ids of the wakeup ritual, numbers that JSON columns hold, and keys of a batch's metadata
RITUAL = ("VERIFY_IDENTITY", "VALIDATE_INTEGRITY", "EVALUATE_RESILIENCE", "EXPRESS_GRATITUDE", "ACCEPT_INCOMPLETENESS")
PROMOTED = {"entropy_score": "decimal(5,4)", "coherence_score": "decimal(5,4)", "optimization_veto_entropy_ratio": "decimal(10,4)", "epistemic_humility_certainty": "decimal(5,4)"}
BATCH_KEYS = ("deployment_region", "deployment_type", "agent_role", "agent_template", "user_timezone")


def task_class(channel: Column, state: Column, task: Column) -> Column:
    """What kind of work a trace belongs to, by the first rule that fits."""
    return (
        F.when(channel.startswith("model_eval_"), "qa_eval")
        .when(channel.startswith("api_google"), "real_user_web")
        .when(channel.startswith("discord"), "discord")
        .when(channel.startswith("websocket"), "real_user_ws")
        .when(channel.startswith("http"), "real_user_http")
        .when(state == "wakeup", "wakeup_ritual")
        .when(task.rlike(f"^({'|'.join(RITUAL)})"), "wakeup_ritual")
        .when(channel.isNull(), "unknown")
        .otherwise("other")
    )


def qa_language(channel: Column) -> Column:
    return F.nullif(F.regexp_extract(channel, r"^model_eval_([a-z]+)_", 1), F.lit(""))


def qa_question(channel: Column) -> Column:
    return F.nullif(F.regexp_extract(channel, r"^model_eval_[a-z]+_([0-9]+)", 1), F.lit("")).try_cast("int")


def stewardship_tier(creator: Column, influence: Column, risk: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.ceil((creator + influence) * risk / 7).cast("int")))


def json_number(column: str, path: str, kind: str = "double") -> Column:
    """A number inside a JSON column; text that is no number, or too large for ``kind``, gives null."""
    return F.get_json_object(column, f"$.{path}").try_cast(kind)


def promote_json(df: DataFrame, column: str = "conscience_result", numbers: dict[str, str] = PROMOTED) -> DataFrame:
    """Numbers inside a JSON column as columns of their own types."""
    return df.withColumns({name: json_number(column, name, kind) for name, kind in numbers.items()})


def anywhere(json: Column, key: str) -> Column:
    """The value of a key of a JSON text at its top, else the first at any depth in the order of the text.

    A key follows ``{`` or ``,``; inside a string its quotes would be escaped, so text
    that only looks like a key is not taken for one.
    """
    deep = F.regexp_extract(json, rf'[{{,]\s*"{key}"\s*:\s*("(?:[^"\\]|\\.)*"|[^\s,}}\]]+)', 1)
    text = F.when(deep.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), deep, F.lit("}")), "$.v")).when(deep != "null", F.nullif(deep, F.lit("")))
    return F.coalesce(F.get_json_object(json, f"$.{key}"), text)


def channel() -> Column:
    """The channel of a trace, from the first of three places."""
    return F.coalesce(F.get_json_object("snapshot_and_context", "$.system_snapshot.channel_id"), anywhere(F.col("thought_start"), "channel_id"), anywhere(F.col("snapshot_and_context"), "channel_id"))


def flat_or_nested(column: str, key: str, parent: str) -> Column:
    """A value at the top of a JSON column, else under a parent."""
    return F.coalesce(F.get_json_object(column, f"$.{key}"), F.get_json_object(column, f"$.{parent}.{key}"))


def first_model(models: Column) -> Column:
    """The first model of a JSON array; of anything else none."""
    return F.when(F.ltrim(models).startswith("["), F.get_json_object(models, "$[0]"))


def stage_times(tr: DataFrame) -> DataFrame:
    """Milliseconds of the five stages; null where either end is missing."""
    gap = lambda a, b, name: ((F.unix_micros(b) - F.unix_micros(a)) / 1000).alias(name)
    stages = (("thought_start_at", "snapshot_at", "t_snap_ms"), ("snapshot_at", "dma_results_at", "t_dma_ms"), ("dma_results_at", "aspdma_at", "t_aspdma_ms"), ("aspdma_at", "conscience_at", "t_conscience_ms"), ("conscience_at", "action_result_at", "t_action_ms"))
    return tr.select("*", *[gap(*stage) for stage in stages])


def batch_context(tr: DataFrame, batches: DataFrame, most: int = 100_000) -> DataFrame:
    """Traces with their batch's metadata and its coarse place; traces without a batch stay.

    Batches are counted first: up to ``most`` of them go to the traces, which are not moved then.
    """
    meta = lambda key: F.get_json_object("correlation_metadata", f"$.{key}")
    cells = {"user_latitude_cell": meta("user_latitude").try_cast("decimal(4,1)"), "user_longitude_cell": meta("user_longitude").try_cast("decimal(5,1)")}
    known = batches.select("batch_id", *[meta(k).alias(k) for k in BATCH_KEYS], *[c.alias(k) for k, c in cells.items()])
    few = batches.limit(most + 1).count() <= most
    return tr.drop(*BATCH_KEYS, *cells).join(F.broadcast(known) if few else known, "batch_id", "left")


def trace_context(tr: DataFrame, batches: DataFrame) -> DataFrame:
    """The analysis view: class, question, scores, timings, versions and batch of every trace on one row."""
    found = channel()
    timed = stage_times(promote_json(batch_context(tr, batches)))
    return timed.select(
        "trace_id", "thought_id", "task_id", "agent_id_hash", "agent_name", "ts", "cognitive_state", "trace_level", "selected_action", "csdma", "dsdma", "coherence", "entropy", "k_eff", "correlation_risk", "fragility",
        "entropy_passed", "coherence_passed", "optimization_veto_passed", "epistemic_humility_passed", "conscience_passed", "action_was_overridden", *PROMOTED, "tokens_total", "processing_ms", "cost_cents",
        "t_snap_ms", "t_dma_ms", "t_aspdma_ms", "t_conscience_ms", "t_action_ms", found.alias("channel_id"), task_class(found, F.col("cognitive_state"), F.col("task_id")).alias("task_class"),
        qa_language(found).alias("qa_language"), qa_question(found).alias("qa_question"), *BATCH_KEYS, "user_latitude_cell", "user_longitude_cell",
        flat_or_nested("snapshot_and_context", "agent_version", "system_snapshot").alias("agent_version"), first_model(F.col("models_used")).alias("primary_model"),
        flat_or_nested("snapshot_and_context", "attestation_level", "verify_attestation").try_cast("int").alias("attestation_level"),
        flat_or_nested("snapshot_and_context", "attestation_status", "verify_attestation").alias("attestation_status"), "signature_verified",
    )


def trace_outcome(tr: DataFrame) -> DataFrame:
    """Green, yellow or red for every trace."""
    return tr.select("trace_id", "task_id", outcome().alias("outcome"))


def outcome() -> Column:
    """Red if rejected or overridden, green with a positive moment, yellow for what was done, else red."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    verb = F.upper("selected_action")
    done = (verb == "TASK_COMPLETE") | yes("action_success") | verb.isin("SPEAK", "OBSERVE", "TOOL", "MEMORIZE", "RECALL", "PONDER", "DEFER")
    return F.when((verb == "REJECT") | yes("action_was_overridden"), "red").when(yes("has_positive_moment"), "green").when(done, "yellow").otherwise("red")


def task_outcome(tr: DataFrame) -> DataFrame:
    """A completed task is green with a positive moment at its completion, else yellow; others are red if rejected, overridden or without success."""
    verb = F.upper("selected_action")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    colour = (
        F.when(any_((verb == "TASK_COMPLETE") & F.col("has_positive_moment")), "green")
        .when(any_(verb == "TASK_COMPLETE"), "yellow")
        .when(any_(verb == "REJECT") | any_(F.col("action_was_overridden")), "red")
        .when(any_(F.col("action_success")), "yellow")
        .otherwise("red")
    )
    return tr.where("task_id is not null").groupBy("task_id").agg(F.count("*").alias("traces"), colour.alias("outcome"))


def step_durations(tr: DataFrame) -> DataFrame:
    """Milliseconds of each gate since the gate before it, of those that have a time."""
    held = F.filter(F.array(*[F.struct(F.lit(c.removesuffix("_at")).alias("step"), F.unix_micros(c).alias("us")) for c in GATES.values()]), lambda x: x["us"].isNotNull())
    pairs = F.zip_with(F.slice(held, 2, len(GATES)), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), lambda b, a: F.struct(b["step"].alias("step"), ((b["us"] - a["us"]) / 1000).alias("ms")))
    return tr.select("trace_id", F.explode(pairs).alias("p")).select("trace_id", "p.step", "p.ms")


def gate_sequence(tr: DataFrame) -> DataFrame:
    """Gates in their canonical order with the time since the first; null where a gate was not observed.

    The intuition gate is one of its own only in schema 1.9.3.  A tool gate that was not passed stays as unobserved.
    """
    at = lambda gate: F.unix_micros(GATES[gate])
    first = F.array_min(F.array(*[at(g) for g in GATES]))
    gates = F.array(*[F.struct(F.lit(i).alias("phase_index"), F.lit(g).alias("gate"), ((at(g) - first) / 1000).alias("elapsed_ms"), at(g).isNotNull().alias("observed")) for i, g in enumerate(GATES, 1)])
    shown = F.filter(gates, lambda x: (x["gate"] != "IDMA_RESULT") | (F.col("schema_version") == "1.9.3"))
    return tr.select("trace_id", F.explode(shown).alias("g")).select("trace_id", "g.*")


def instability(tr: DataFrame) -> DataFrame:
    """Weighted sum of nine signs of trouble between 0 and 1; a missing one adds nothing."""
    flag = lambda c, bad=True: (F.col(c) == F.lit(bad)).cast("double")
    narrow = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (2 - F.col("k_eff")) / 2))
    terms = (
        (0.18, 1 - F.col("csdma")), (0.18, 1 - F.col("dsdma")), (0.18, 1 - F.col("coherence")), (0.12, flag("fragility")), (0.10, narrow),
        (0.10, flag("action_was_overridden")), (0.07, flag("is_recursive")), (0.04, flag("has_execution_error")), (0.03, flag("action_success", False)),
    )
    return tr.select("trace_id", sum((weight * F.coalesce(term, F.lit(0.0)) for weight, term in terms), F.lit(0.0)).alias("instability"))


def resolve_agent(tr: DataFrame, names: DataFrame) -> DataFrame:
    """The agent of each name asked for, or that the name stands for none or for several."""
    seen = tr.groupBy("agent_name").agg(F.countDistinct("agent_id_hash").alias("hashes"), F.max("agent_id_hash").alias("hash"))
    found = F.when(F.col("hashes") == 1, "ok").when(F.col("hashes") > 1, "conflict").otherwise("not_found")
    return names.join(seen, "agent_name", "left").select("agent_name", F.when(F.col("hashes") == 1, F.col("hash")).alias("hash"), found.alias("resolution"))
