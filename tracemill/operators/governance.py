"""Compliance views, fleet views and lists of the governance ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.filters import MAX_PAGE
from tracemill.operators.windows import moment, trailing


def compliance_status(agents: DataFrame, pdma: DataFrame, wbd: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Decisions and deferrals of the last days for each agent, and what follows from them.

    More than five pending deferrals need attention, a mean risk above three is elevated, a
    score below 0.7 is not compliant; the first rule that fits decides.
    """
    since = lambda df: df.where((F.col("ts") > moment(as_of) - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= moment(as_of)))
    p = since(pdma).groupBy("agent").agg(F.count("*").alias("recent_pdma_events"), F.avg("risk_magnitude").alias("avg_risk_magnitude"))
    w = since(wbd).groupBy("agent").agg(F.count("*").alias("recent_wbd_deferrals"), F.count_if(F.col("status") == "PENDING").alias("pending_deferrals"))
    whole = agents.join(p, "agent", "left").join(w, "agent", "left").na.fill(0, ["recent_pdma_events", "avg_risk_magnitude", "recent_wbd_deferrals", "pending_deferrals"])
    status = (
        F.when(F.col("wbd_enabled") & (F.col("pending_deferrals") > 5), "NEEDS_ATTENTION")
        .when(F.col("pdma_enabled") & (F.col("avg_risk_magnitude") > 3), "ELEVATED_RISK")
        .when(F.col("compliance_score") < 0.7, "NON_COMPLIANT")
        .otherwise("COMPLIANT")
    )
    return whole.withColumn("compliance_status", status)


def compliance_summary(status: DataFrame, pdma: DataFrame, wbd: DataFrame, sunsets: DataFrame, as_of: str) -> DataFrame:
    """Agents by status, decisions of high risk in the last day, deferrals that are pending and sunsets under way."""
    is_ = lambda x: F.count_if(F.col("compliance_status") == x)
    risky = (F.col("risk_magnitude") >= 4) & (F.col("ts") > moment(as_of) - F.make_dt_interval(days=F.lit(1))) & (F.col("ts") <= moment(as_of))
    parts = [
        status.agg(*[is_(s).alias(s.lower()) for s in ("COMPLIANT", "NON_COMPLIANT", "ELEVATED_RISK", "NEEDS_ATTENTION")]),
        pdma.agg(F.count_if(risky).alias("high_risk_pdma_24h")),
        wbd.agg(F.count_if(F.col("status") == "PENDING").alias("pending_wbd_deferrals")),
        sunsets.agg(F.count_if(F.col("status").isin("INITIATED", "IN_PROGRESS")).alias("active_sunset_protocols")),
    ]
    return reduce(lambda a, b: a.join(b, how="cross"), parts)  # of one row each


def fleet_view(agents: DataFrame, managers: DataFrame, telemetry: DataFrame, visibility: DataFrame) -> DataFrame:
    """Agents with their manager's, telemetry's and visibility's settings; what is not set stays null."""
    return agents.join(managers, "manager_id", "left").join(telemetry, "agent", "left").join(visibility, "agent", "left")


def live_agents(discovered: DataFrame, managers: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Agents of enabled managers that were seen in the last minutes; what went wrong with a manager is none of theirs."""
    seen = trailing(discovered, as_of, hours=minutes / 60, ts="seen")
    return seen.join(managers.where("enabled").select("manager_id", "enabled"), "manager_id")


def fleet_stats(discovered: DataFrame, managers: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """Enabled managers, agents that any manager has seen in the last minutes, and enabled managers whose last visit failed."""
    seen = discovered.where((F.col("seen") > moment(as_of) - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("seen") <= moment(as_of)))
    enabled = managers.where("enabled").agg(F.count("*").alias("total_managers"), F.count("last_error").alias("managers_with_errors"))
    return enabled.join(seen.agg(F.countDistinct("agent").alias("total_agents")), how="cross")  # of one row each


def listed(df: DataFrame, order: str, key: str, limit: int, **filters: object) -> DataFrame:
    """The newest rows that meet the given values; ties by key."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(F.desc(order), F.desc(key)).limit(min(limit, MAX_PAGE))


def list_alerts(alerts: DataFrame, as_of: str, hours: int = 24, severity: str | None = None, mechanism: str | None = None, unacknowledged: bool = False, limit: int = 100) -> DataFrame:
    """The newest alerts of a trailing window."""
    recent = alerts.where((F.col("ts") > moment(as_of) - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= moment(as_of)))
    if unacknowledged:
        recent = recent.where(~F.col("acknowledged"))
    return listed(recent, "ts", "alert_id", limit, severity=severity, mechanism=mechanism)


def keyset(df: DataFrame, key: str, cursor: tuple[str, object] | None, limit: int = 100, **filters: object) -> DataFrame:
    """The page of ``df`` after a cursor of (time, key), newest first, of rows that meet the given values."""
    if cursor:
        at, last = moment(cursor[0]), F.lit(cursor[1])
        df = df.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col(key) < last)))
    return listed(df, "ts", key, limit, **filters)


def list_llm_calls(calls: DataFrame, cursor: tuple[str, object] | None = None, limit: int = 100, as_of: str | None = None, hours: float | None = None, **filters: object) -> DataFrame:
    """Model calls by agent, model, status, trace or thought, in a trailing window if one is given."""
    return keyset(trailing(calls, as_of, hours=hours) if as_of and hours else calls, "call_id", cursor, limit, **filters)


def calls_of_events(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Each model call beside the event that made it: same trace, event type and attempt; a call without one stays."""
    parent = events.select("trace_id", F.col("event_type").alias("parent_event_type"), F.col("attempt_index").alias("parent_attempt_index"), F.col("i").alias("event_index"), F.col("data").alias("event_data"))
    return calls.join(parent, ["trace_id", "parent_event_type", "parent_attempt_index"], "left")


def trace_detail(traces: DataFrame, components: DataFrame, calls: DataFrame) -> DataFrame:
    """Each trace with its events in order, each event with its data, and its model calls; a trace has few of either."""
    parts = components.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("i", "event_type", "data"))).alias("events"))
    used = calls.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("call_id", "model", "status", "parent_event_type"))).alias("calls"))
    return traces.join(parts, "trace_id", "left").join(used, "trace_id", "left")
