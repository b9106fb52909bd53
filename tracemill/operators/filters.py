"""Filters, access, paging and mutation jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.windows import lagged, moment

MAX_PAGE = 1000


def list_traces(tr: DataFrame, **filters: object) -> DataFrame:
    """Rows that meet every given condition: a column's value, or ``min_``/``max_`` bounds, or ``since``/``until``."""
    made: list[Column] = []
    for name, value in filters.items():
        if value is None:
            continue
        if name in ("since", "until"):
            made.append(F.col("ts") >= moment(str(value)) if name == "since" else F.col("ts") <= moment(str(value)))
        elif name.startswith(("min_", "max_")):
            column = F.col(name[4:])
            made.append(column >= value if name.startswith("min_") else column <= value)
        else:
            made.append(F.col(name) == value)
    return tr.where(reduce(lambda a, b: a & b, made, F.lit(True)))


def scope(tr: DataFrame, level: str, agents: list[str], partner: str | None = None) -> DataFrame:
    """What a reader may see: all, own and sample and shared rows, or sample rows."""
    if level == "full":
        return tr
    open_ = F.coalesce(F.col("public_sample"), F.lit(False))
    if level != "partner":
        return tr.where(open_)
    shared = F.array_contains("partner_access", partner) if partner and "partner_access" in tr.columns else F.lit(False)
    return tr.where(F.col("agent_id_hash").isin(agents) | open_ | F.coalesce(shared, F.lit(False)))


#: fixed values: what partners may not see
PARTNER_HIDDEN, PROMPT = ("audit_signature", "scrub_signature", "scrub_key_id"), "prompt_used"


def without_prompts(results: Column, kind: T.DataType) -> Column:
    """Decision results without the prompt inside each: of typed structs, or of JSON text of an object of objects."""
    if isinstance(kind, T.StructType):
        inner = [results[f.name].dropFields(PROMPT) if isinstance(f.dataType, T.StructType) and PROMPT in f.dataType.names else results[f.name] for f in kind.fields]
        return F.when(results.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(inner, kind.fields, strict=True)]))
    held = F.from_json(results, "map<string,string>")
    return F.coalesce(F.to_json(F.transform_values(held, lambda _, v: _without_key(v))), results)


def _without_key(value: Column) -> Column:
    """A nested object (as text) without the prompt; other values as they are."""
    inner = F.from_json(value, "map<string,string>")
    return F.when(inner.isNotNull() & F.ltrim(value).startswith("{"), F.to_json(F.map_filter(inner, lambda k, _: k != PROMPT))).otherwise(value)


def mask_fields(tr: DataFrame, level: str, results: str = "dma_results") -> DataFrame:
    """What a level may see: a partner neither signatures of audit and scrub nor prompts; full readers, and the public of sample rows, all."""
    if level != "partner":
        return tr
    seen = tr.drop(*PARTNER_HIDDEN)
    return seen.withColumn(results, without_prompts(F.col(results), seen.schema[results].dataType)) if results in seen.columns else seen


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in a unique order with the total of what was filtered, and whether more follows."""
    limit = min(limit, MAX_PAGE)
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(total, how="cross").withColumn("has_more", F.col("total") > offset + limit)


def keyset_page(df: DataFrame, cursor: tuple[str, str] | None, limit: int) -> DataFrame:
    """The page after a cursor of (time, trace id), newest first."""
    if cursor:
        at, key = moment(cursor[0]), F.lit(cursor[1])
        df = df.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("trace_id") < key)))
    return df.orderBy(F.desc("ts"), F.desc("trace_id")).limit(min(limit, MAX_PAGE))


def task_of(tr: DataFrame) -> Column:
    """A trace's task; one without a task, or with an empty one, stands alone."""
    return F.coalesce(F.nullif("task_id", F.lit("")), F.concat(F.lit("standalone-"), F.col("trace_id")))


def group_by_task(tr: DataFrame) -> DataFrame:
    """Each task with its seed, the first trace at depth 0 (agent, time, what was first observed), newest seed first.

    A task without a seed has none of these and stands last.  Its traces are
    ``task_traces``: a row each, as a task may have any number.
    """
    parts = ["trace_id", "agent_id_hash", "agent_name", "ts", *[c for c in ("snapshot_and_context", "action_rationale") if c in tr.columns]]
    seed = F.min_by(F.struct(*parts), F.when(F.col("thought_depth") == 0, F.struct("ts", "event_id")))
    tasks = tr.groupBy(task_of(tr).alias("task")).agg(F.count("*").alias("n"), seed.alias("s"))
    text = F.get_json_object("s.snapshot_and_context", "$.system_snapshot.current_thought_summary.content") if "snapshot_and_context" in parts else F.lit(None).cast("string")
    rationale = F.col("s.action_rationale") if "action_rationale" in parts else None
    done = tasks.select("task", "n", F.col("s.trace_id").alias("seed"), F.col("s.agent_name").alias("agent"), F.col("s.ts").alias("started_at"), initial_observation(text, rationale).alias("observation"))
    return done.orderBy(F.desc_nulls_last("started_at"), "task")


def task_traces(tr: DataFrame) -> DataFrame:
    """The traces of every task, a row each, with the columns of a list; order by task and time to read them in turn."""
    return tr.select(task_of(tr).alias("task"), "ts", "trace_id", "thought_depth", "agent_id_hash", "selected_action")


def initial_observation(text: Column, rationale: Column | None = None) -> Column:
    """What stands behind "said:" in its line, else the first line cut at 500 characters, else the rationale."""
    said = F.trim(F.regexp_extract(text, r"said:([^\n]*)", 1))
    found = (F.nullif(said, F.lit("")), F.nullif(F.substring(F.substring_index(text, "\n", 1), 1, 500), F.lit("")))
    return F.coalesce(*found, *([] if rationale is None else [F.nullif(rationale, F.lit(""))]))


def conversations_by_task(turns: DataFrame) -> DataFrame:
    """Each conversation as a task: turns, the first observation (the last role where there is no text) and the last role."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), initial_observation(F.min_by("text", "turn"), F.max_by("role", "turn")).alias("observation"), F.max_by("role", "turn").alias("last_role"))


def apply_updates(store: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None, cleared: str | None = None) -> DataFrame:
    """The store with newer values where an update has one; new keys are added.

    Of several updates of a key the last by ``order`` counts for each column that it
    sets.  ``cleared`` names a column with an array of the columns that an update sets
    to null.  Repeated updates therefore never multiply rows.
    """
    values = [c for c in updates.columns if c not in (*keys, order, cleared)]
    by = F.col(order) if order else F.xxhash64(*[F.col(c) for c in values])
    gone = lambda c: F.coalesce(F.array_contains(cleared, c), F.lit(False)) if cleared else F.lit(False)
    # the newest that sets or clears the column, null where none does
    newest = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull() | gone(c), by)).alias(f"new {c}") for c in values]
    fresh = updates.groupBy(*keys).agg(*newest)
    merged = store.join(fresh, keys, "full_outer" if set(store.columns) == {*keys, *values} else "left")
    changed = lambda c: F.when(F.col(f"`new {c}`").isNotNull(), F.col(f"`new {c}`.v")).otherwise(F.col(c)).alias(c)
    return merged.select(*[changed(c) if c in values else F.col(c) for c in store.columns])


def change_access(store: DataFrame, requests: DataFrame, key: str = "trace_id", column: str = "partner_access") -> DataFrame:
    """The store with partners added, removed or set by requests (key, action, partner_ids, at), each on what the one before left."""
    steps = requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "action", "partner_ids"))).alias("steps"))
    start = F.coalesce(F.col(column), F.array().cast("array<string>"))
    step = lambda held, s: F.when(s["action"] == "add", F.array_union(held, s["partner_ids"])).when(s["action"] == "remove", F.array_except(held, s["partner_ids"])).when(s["action"] == "set", s["partner_ids"]).otherwise(held)
    joined = store.join(steps, key, "left")
    return joined.withColumn(column, F.when(F.col("steps").isNull(), F.col(column)).otherwise(F.aggregate("steps", start, step))).drop("steps").select(*store.columns)


def settle_alerts(alerts: DataFrame, events: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts acknowledged or resolved by events (key, action, by, at, notes); of several of a kind the last counts."""
    last = lambda action, what: F.max_by(what, F.when(F.col("action") == action, F.col("at")))
    made = events.groupBy(key).agg(
        F.bool_or(F.col("action") == "acknowledge").alias("a"), last("acknowledge", "by").alias("a_by"), F.max(F.when(F.col("action") == "acknowledge", F.col("at"))).alias("a_at"),
        F.bool_or(F.col("action") == "resolve").alias("r"), last("resolve", "by").alias("r_by"), F.max(F.when(F.col("action") == "resolve", F.col("at"))).alias("r_at"), last("resolve", "notes").alias("r_notes"),
    )
    new = {"acknowledged": "a", "acknowledged_by": "a_by", "acknowledged_at": "a_at", "resolved": "r", "resolved_by": "r_by", "resolved_at": "r_at", "resolution_notes": "r_notes"}
    joined = alerts.join(made, key, "left")
    flags = ("acknowledged", "resolved")
    pick = lambda c: (F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(new[c]), F.lit(False))) if c in flags else F.when(F.coalesce(F.col(new[c][0]), F.lit(False)), F.col(new[c])).otherwise(F.col(c))
    return joined.select(*[pick(c).alias(c) if c in new else F.col(c) for c in alerts.columns])


def erase(stores: dict[str, DataFrame], requests: DataFrame, keys: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each store without the requested keys, and how many rows go from each."""
    wanted = requests.select(*keys).distinct()
    kept = {name: df.join(wanted, keys, "left_anti") for name, df in stores.items()}
    counts = [df.join(wanted, keys, "left_semi").agg(F.lit(name).alias("store"), F.count("*").alias("erased")) for name, df in stores.items()]
    return kept, reduce(DataFrame.unionByName, counts)


def window_filter(df: DataFrame, window: str, as_of: str) -> DataFrame:
    """Rows of a trailing window such as "10m", "24h" or "7d"."""
    seconds = int(window[:-1]) * {"m": 60, "h": 3600, "d": 86400}[window[-1]]
    return df.where((F.col("ts") > moment(as_of) - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= moment(as_of)))


def exclude_benchmark(df: DataFrame, text: str = "idma_result") -> DataFrame:
    """Without rows whose text names a benchmark; a null text stays."""
    return df.where(F.coalesce(~F.contains(F.lower(text), F.lit("benchmark")), F.lit(True)))


def ledger_chain(ledger: DataFrame, by: str, order: list[str], entry: list[str], stored: tuple[str, str] | None = None) -> DataFrame:
    """Each entry's hash over its fields and the hash before it in its chain, and whether the stored (previous, own) hashes fit.

    An entry's hash covers the stored hash of the entry before, so a change of any
    field breaks its own check, and one of a stored hash the check of the next.
    Without stored hashes the fields alone are hashed, and every entry is intact.
    """

    def linked(df: DataFrame, name: str, column: str) -> DataFrame:
        """``df`` with the entry before's ``column``; a ledger of any size is walked in slices of its first order column."""
        done = lagged(df, by, F.col(order[0]), order[1:], [column])
        return done.withColumn(name, F.coalesce(F.col(f"before.{column}"), F.lit("genesis"))).drop("before")

    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in entry]
    if stored is None:
        hashed = ledger.withColumn("entry_hash", F.sha2(F.concat_ws("|", *fields), 256))
        return linked(hashed, "prev_hash", "entry_hash").withColumn("is_intact", F.lit(True))
    previous, own = stored
    found = linked(ledger, "expected_prev", own)
    intact = (F.col(previous) == F.col("expected_prev")) & (F.col(own) == F.sha2(F.concat_ws("|", previous, *fields), 256))
    return found.withColumn("is_intact", F.coalesce(intact, F.lit(False)))


def seal(entry: list[str], previous: Column) -> Column:
    """The hash of an entry behind ``previous``, as ``ledger_chain`` checks it."""
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in entry]), 256)


def cohorts(tr: DataFrame) -> DataFrame:
    return tr.select("deployment_domain", "dsdma_domain").distinct().orderBy("deployment_domain", "dsdma_domain")


def append_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those rows of the batch whose key it does not have, each key once."""
    return target.unionByName(batch.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def upsert_last(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of both; of equally new ones the batch's, then the largest."""
    others = [c for c in target.columns if c not in keys]
    both = target.withColumn("late", F.lit(0)).unionByName(batch.select(*target.columns).withColumn("late", F.lit(1)))
    row = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(order, "late", *[F.col(c) for c in others]))
    return both.groupBy(*keys).agg(row.alias("row")).select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in target.columns])


def apply_retention(df: DataFrame, as_of: str, days: int, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= moment(as_of) - F.make_dt_interval(days=F.lit(days)))


def qa_traces(events: DataFrame, version: str, prefix: str, levels: Sequence[str] = ("detailed", "full_traces"), since: str | None = None, until: str | None = None) -> DataFrame:
    """Ids of the traces whose first event qualifies: its version, its channel's beginning, its level and its time."""
    first = events.where((F.col("schema_version") == version) & (F.col("event_type") == "THOUGHT_START") & F.col("trace_level").isin(*levels))
    if since is not None:
        first = first.where(F.col("ts") >= moment(since))
    if until is not None:
        first = first.where(F.col("ts") <= moment(until))
    return first.where(F.startswith(F.get_json_object("payload", "$.channel_id"), F.lit(prefix))).select("trace_id").distinct()


def qa_export(events: DataFrame, calls: DataFrame, version: str, prefix: str = "model_eval_", **window: str | None) -> tuple[DataFrame, DataFrame]:
    """(events, model calls) of the traces that qualify, each ordered by trace, time and id."""
    wanted = qa_traces(events, version, prefix, **window)
    kept = lambda df, key: df.join(wanted, "trace_id", "left_semi").orderBy("trace_id", "ts", key)
    return kept(events, "event_id"), kept(calls, "call_id")


def release_filter(tr: DataFrame, batches: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept traces, kept batches, counters of both) of a release.

    A trace before the cutoff is old, then one that is known not to be verified is dropped.
    A batch of four traces at most of which none was accepted and some rejected is a
    retry loop; an old batch is left out without being counted.
    """
    old, bad = F.col("ts") < moment(cutoff), F.coalesce(F.col("signature_verified") == F.lit(False), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    loop = (zero("accepted") == 0) & (zero("received") <= 4) & (zero("rejected") > 0)
    late = F.col("batch_ts") < moment(cutoff)
    counted = tr.agg(F.count_if(~old & ~bad).alias("kept"), F.count_if(~old & bad).alias("dropped_unverified"), F.count_if(old).alias("dropped_pre_cutoff"))
    looped = batches.agg(F.count_if(~loop & ~late).alias("kept_batches"), F.count_if(loop).alias("dropped_retry_loop"))
    return tr.where(~old & ~bad), batches.where(~loop & ~late), counted.join(looped, how="cross")  # of one row each


def manifest(named: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free checksum of each table: the sum of row hashes, to which repeated rows add each time."""
    total = lambda df: F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(total(df), F.lit(0)).cast("string").alias("checksum")) for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def file_manifest(spark: SparkSession, folders: dict[str, str], parameters: dict[str, str]) -> DataFrame:
    """Files, bytes, sha256 over the files' own in the order of their names, and filter parameters of each written output.

    Files are hashed where they are read; only one digest for each comes together.
    """
    parts = []
    for name, folder in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("digest"))
        digests = F.transform(F.sort_array(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("file"), "digest"))), lambda x: x["digest"])
        parts.append(files.agg(F.lit(name).alias("name"), F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(digests, ""), 256).alias("sha256")))
    said = F.create_map(*[F.lit(x) for pair in sorted(parameters.items()) for x in pair]) if parameters else F.create_map().cast("map<string,string>")
    return reduce(DataFrame.unionByName, parts).withColumn("parameters", said)
