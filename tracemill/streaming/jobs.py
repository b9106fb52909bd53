"""Streaming forms of the batch operators.

The rollups are the batch functions over a stream with a watermark; late rows that
the watermark drops are repaired by a batch run over the affected days.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tracemill.operators import ingest, telemetry
from tracemill.streaming.state import PART, assemble, chain_gaps, newest_status


def stream_rollup(stream: DataFrame, rollup: Callable[[DataFrame], DataFrame], watermark: str, ts: str = "ts") -> DataFrame:
    """A windowed batch rollup over a stream; a window is final once the watermark has passed it."""
    return rollup(stream.withWatermark(ts, watermark))


def stream_error_alerts(logs: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Alert rules of sliding five-minute windows."""
    return telemetry.alert_rules(logs.withWatermark("ts", watermark))


def stream_dedup(stream: DataFrame, keys: list[str], watermark: str, ts: str = "ts") -> DataFrame:
    """Each key once within the watermark; state is dropped with it."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def assembled(components: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Components of whole traces, handed on together, whatever batches they came in.

    ``components`` has trace_id, i, event_type, data and ts (event time), and any other
    column of ``state.PART``.  A trace is whole when n_components of it have come; without
    that number, or if some never come, it ends ``wait`` of event time after its last one.
    """
    columns = [c for c in PART if c in components.columns or c in ("n_components", "at")]
    made = components if "n_components" in components.columns else components.withColumn("n_components", F.lit(None).cast("int"))
    timed = made.withColumn("at", F.unix_micros("ts")).select("trace_id", "ts", *columns).withWatermark("ts", wait)
    schema = ", ".join(["trace_id string", *[f"{c} {PART[c]}" for c in columns]])
    whole = timed.groupBy("trace_id").applyInPandasWithState(assemble(columns, _ms(wait)), schema, "parts string, until long", "append", GroupStateTimeout.EventTimeTimeout)
    return whole.withColumn("ts", F.timestamp_micros("at")).drop("at")


def _ms(length: str) -> int:
    """Milliseconds of a length of time such as "10 minutes"."""
    return int(pd.Timedelta(length) / pd.Timedelta(milliseconds=1))


def stream_ingest(components: DataFrame, folder: str, checkpoint: str, keys: DataFrame | None = None, wait: str = "10 minutes", once: bool = True) -> StreamingQuery:
    """``ingest`` over a stream of components: whole traces, scrubbed, sanitised and typed, to a folder for each destination.

    Traces are put together in keyed state first, so one may be cut over any batches; the
    state holds components as they came, no sink does.  ``results`` beside the four
    destinations says where each trace went and why, and ``accounting`` sums a batch up.
    A batch's rows lie in a folder of its number, so one that runs again replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty():
                return
            done = ingest.ingest(batch.drop("n_components"), keys)
            done["accounting"] = ingest.batch_accounting(done["results"])
            for name, rows in done.items():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = assembled(components, wait).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_latest(checks: DataFrame, keep: str = "30 days") -> DataFrame:
    """Changes of the newest status of each service: a row whenever a newer check has come.

    The state is one row for each service that has been checked within ``keep``.  The
    newest row of each service in what was written is the current status.
    """
    timed = checks.withWatermark("ts", keep).select("region", "service", "provider", "status", "latency_ms", "ts", F.unix_micros("ts").alias("at"), "event_id")
    schema = "region string, service string, provider string, status string, latency_ms double, at long, event_id long"
    newest = timed.groupBy("region", "service", "provider").applyInPandasWithState(newest_status(_ms(keep)), schema, "at long, event_id long", "update", GroupStateTimeout.EventTimeTimeout)
    return newest.withColumn("ts", F.timestamp_micros("at")).drop("at")


def stream_chain_gaps(traces: DataFrame, watermark: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """Breaks of the audit chain, each when the watermark has passed it; rows may come in any order within the watermark."""
    schema = "agent_id_hash string, trace_id string, prev_seq long, seq long, gap long"
    numbered = traces.where("audit_sequence_number is not null").withWatermark("ts", watermark)
    picked = numbered.select("agent_id_hash", "trace_id", "ts", F.col("audit_sequence_number").cast("long").alias("seq"), F.unix_micros("ts").alias("at"))
    return picked.groupBy("agent_id_hash").applyInPandasWithState(chain_gaps(_ms(idle)), schema, "last long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def repair_rollup(store: DataFrame, rows: DataFrame, rollup: Callable[[DataFrame], DataFrame], since: Any, bucket: str) -> DataFrame:
    """The stored rollup with every bucket from ``since`` on computed again from all rows."""
    start = F.lit(since).cast("timestamp")
    fresh = rollup(rows.where(F.col("ts") >= start))
    return store.where(F.col(bucket) < start).unionByName(fresh)
