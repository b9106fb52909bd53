"""Anomaly detectors over canonical traces.  Each is one lazy plan over the whole fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.windows import deviation_of, evidence, in_order, lagged, mean_of, moment, trailing

METRICS = ("csdma", "dsdma", "coherence")
#: what agents of one deployment domain are compared by, besides their override rate
COHORT_METRICS = ("csdma", "dsdma", "k_eff", "correlation_risk")
#: sums this near to a limit are taken in the order of time, over groups of so many rows at most
EDGE, ORDERED = 1e-9, 100_000
ALERT = ("alert_id", "severity", "mechanism", "agent_id_hash", "domain", "metric", "value", "baseline", "deviation", "deviation_text", "recommended_action", "evidence")
#: what to do about an alert, by mechanism
ADVICE = {
    "cross_agent_divergence": "Review traces to determine if behavior is legitimate",
    "intra_agent_inconsistency": "Look at the agent's choices for one type of trace",
    "hash_chain": "Check the audit chain at the first gap",
    "temporal_drift": "Look for a change on the day of the jump",
    "conscience_override": "Read the overridden actions",
}
#: how a deviation is said, by mechanism
SAID = {"cross_agent_divergence": "%.1f sigma", "intra_agent_inconsistency": "%.0f different actions", "hash_chain": "%.0f gaps", "temporal_drift": "%.2f change", "conscience_override": "%.1f times"}


def _said(pattern: str, number: Column) -> Column:
    """A number in words, rounded by its exact value; Java's ``%.2f`` rounds its shortest decimals, so 0.185 (a little less) would go up."""
    digits = int(pattern[2])
    return F.concat(F.call_function("format_number", number, F.lit("0." + "0" * digits if digits else "0")), F.lit(pattern[4:]))


def _rate(flag: str) -> Column:
    """Share of true among all rows; null counts as not true."""
    return F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))


def _severity(size: Column, critical: float) -> Column:
    return F.when(size > critical, "critical").otherwise("warning")


def _near(number: Column, *limits: float) -> Column:
    """So near to a limit that the order of a sum may decide."""
    return reduce(Column.__or__, [F.abs(number - x) < EDGE for x in limits])


def _even(number: Column, n: Column) -> Column:
    """What follows from a sum over ``n`` rows; of more than are put in order, equal to a limit up to its rounding is equal."""
    return F.when(n > ORDERED, F.round(number, 12)).otherwise(number)


def cross_agent_divergence(tr: DataFrame, as_of: str, days: int = 7, min_traces: int = 10, min_agents: int = 3, warn: float = 2.0, crit: float = 3.0) -> DataFrame:
    """Agents whose mean metrics lie far from the mean of their domain's agents."""
    rows = trailing(tr, as_of, days).where("signature_verified and csdma is not null")
    per_agent = rows.groupBy("agent_id_hash", "dsdma_domain").agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n")).where(F.col("n") >= min_traces)
    long = per_agent.unpivot(["agent_id_hash", "dsdma_domain"], list(METRICS), "metric", "value")
    domain = long.groupBy("dsdma_domain", "metric").agg(F.avg("value").alias("baseline"), F.stddev_samp("value").alias("sd"), F.count("*").alias("agents")).where((F.col("agents") >= min_agents) & (F.col("sd") > 0))
    found = long.join(domain, ["dsdma_domain", "metric"]).withColumn("z", (F.col("value") - F.col("baseline")) / F.col("sd")).where(F.abs("z") > warn).join(evidence(rows, ["agent_id_hash", "dsdma_domain"]), ["agent_id_hash", "dsdma_domain"])
    return build_alerts(found.select("agent_id_hash", F.col("dsdma_domain").alias("domain"), "metric", "value", "baseline", F.col("z").alias("deviation"), _severity(F.abs("z"), crit).alias("severity"), "evidence"), "cross_agent_divergence")


def build_alerts(findings: DataFrame, mechanism: str) -> DataFrame:
    """Findings as alerts, with the deviation in words and what to do; an alert's id follows from what it is about, so a second run makes the same."""
    about = F.concat_ws("|", F.lit(mechanism), "agent_id_hash", F.coalesce("domain", F.lit("")), "metric", F.col("severity"))
    said = _said(SAID[mechanism], F.col("deviation").cast("double"))
    action = F.concat(F.lit(f"{ADVICE[mechanism]} (agent "), F.col("agent_id_hash"), F.lit(", "), F.col("metric"), F.lit(")"))
    made = {"mechanism": F.lit(mechanism), "alert_id": F.sha2(about, 256), "deviation_text": said, "recommended_action": action}
    return findings.withColumns(made).select(*ALERT)


def cohort_divergence(tr: DataFrame, as_of: str, days: int = 7, min_traces: int = 10) -> DataFrame:
    """Signed z of every agent within its deployment domain: plausibility, alignment, k_eff, correlation risk and override rate."""
    means = [F.avg(m).alias(m) for m in COHORT_METRICS]
    per_agent = trailing(tr, as_of, days).groupBy("deployment_domain", "agent_id_hash").agg(*means, _rate("action_was_overridden").alias("override_rate"), F.count("*").alias("n")).where(F.col("n") >= min_traces)
    long = per_agent.unpivot(["deployment_domain", "agent_id_hash", "n"], [*COHORT_METRICS, "override_rate"], "metric", "value")
    cohort = Window.partitionBy("deployment_domain", "metric")
    sd = F.stddev_samp("value").over(cohort)
    return long.withColumn("z", F.when(sd > 0, (F.col("value") - F.avg("value").over(cohort)) / sd).otherwise(0.0))


def intra_agent_inconsistency(tr: DataFrame, as_of: str, days: int = 30, actions: int = 2, spread: float = 0.15) -> DataFrame:
    """Agents that choose many different actions for one type of trace with uneven plausibility."""
    rows, keys = trailing(tr, as_of, days), ["agent_id_hash", "trace_type"]
    stats = rows.groupBy(*keys).agg(F.countDistinct("selected_action").alias("actions"), F.stddev_samp("csdma").alias("sd"), F.count("*").alias("n")).where(F.col("actions") > actions).withColumn("sd", _even(F.col("sd"), F.col("n")))
    edge = stats.where(_near(F.col("sd"), spread, spread + 0.05) & (F.col("n") <= ORDERED))
    again = in_order(rows, keys, edge, ["csdma"]).select(*keys, deviation_of(F.col("csdma")).alias("again"))
    settled = stats.where(F.col("sd") > spread - EDGE).join(again, keys, "left").withColumn("sd", F.coalesce("again", "sd"))
    found = settled.where(F.col("sd") > spread).join(evidence(rows, keys), keys)
    severity = F.when((F.col("actions") > actions + 1) & (F.col("sd") > spread + 0.05), "critical").otherwise("warning")
    return build_alerts(found.select("agent_id_hash", F.lit(None).cast("string").alias("domain"), F.col("trace_type").alias("metric"), F.col("sd").alias("value"), F.lit(spread).alias("baseline"), F.col("actions").cast("double").alias("deviation"), severity.alias("severity"), "evidence"), "intra_agent_inconsistency")


def hash_chain_gaps(tr: DataFrame) -> DataFrame:
    """Places where an agent's audit sequence does not go up by one; an agent of any size is compared in slices of its sequence."""
    rows = tr.where("audit_sequence_number is not null").select("agent_id_hash", "trace_id", F.col("audit_sequence_number").cast("long").alias("seq"))
    step = lagged(rows, "agent_id_hash", F.col("seq"), ["trace_id"], ["seq"]).withColumn("prev_seq", F.col("before.seq"))
    return step.select("agent_id_hash", "trace_id", "prev_seq", "seq", (F.col("seq") - F.col("prev_seq")).alias("gap")).where("gap <> 1")


def hash_chain_alerts(tr: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One critical alert for each agent with a broken chain."""
    steps = hash_chain_gaps(trailing(tr, as_of, days))
    gaps = steps.groupBy("agent_id_hash").agg(F.count("*").cast("double").alias("value")).join(evidence(steps, ["agent_id_hash"], "seq", newest=False), "agent_id_hash")
    found = gaps.select("agent_id_hash", F.lit(None).cast("string").alias("domain"), F.lit("audit_sequence").alias("metric"), "value", F.lit(0.0).alias("baseline"), F.col("value").alias("deviation"), F.lit("critical").alias("severity"), "evidence")
    return build_alerts(found, "hash_chain")


def daily_drift(tr: DataFrame, as_of: str, days: int = 30, min_traces: int = 5, warn: float = 0.15, crit: float = 0.25) -> DataFrame:
    """Agents whose daily mean jumps between two days with enough traces."""
    rows, keys, both = trailing(tr, as_of, days).withColumn("day", F.to_date("ts")), ["agent_id_hash", "day"], ("csdma", "coherence")
    daily = rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in both], F.count("*").alias("n")).where(F.col("n") >= min_traces)
    order = Window.partitionBy("agent_id_hash").orderBy("day")
    a, b = (_even(F.abs(F.col(m) - F.col(f"{m}_before")), F.greatest("n", "n_before")) for m in both)
    size = F.greatest(a, b)
    jumps = lambda daily: daily.withColumns({f"{c}_before": F.lag(c).over(order) for c in ("day", "n", *both)})
    edge = jumps(daily).where(_near(size, warn, crit) | ((size > warn) & (_near(a - b, 0.0) | _near(size * 100 % 1, 0.5))))  # the last for its text
    days_of = edge.select("agent_id_hash", F.inline(F.array(F.struct("day", "n"), F.struct(F.col("day_before").alias("day"), F.col("n_before").alias("n"))))).where(F.col("n") <= ORDERED)
    again = in_order(rows, keys, days_of, list(both)).select(*keys, *[mean_of(F.col(m)).alias(f"{m}_again") for m in both])
    settled = daily.join(again, keys, "left").select(*keys, "n", *[F.coalesce(f"{m}_again", m).alias(m) for m in both])
    found = jumps(settled).withColumn("size", size).where(F.col("size") > warn).join(evidence(rows, keys), keys)
    first = F.coalesce(a, F.lit(-1.0)) >= F.coalesce(b, F.lit(-1.0))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return build_alerts(found.select("agent_id_hash", F.col("day").cast("string").alias("domain"), F.when(first, "csdma").otherwise("coherence").alias("metric"), pick("csdma", "coherence").alias("value"), pick("csdma_before", "coherence_before").alias("baseline"), F.col("size").alias("deviation"), _severity(F.col("size"), crit).alias("severity"), "evidence"), "temporal_drift")


def welch_drift(tr: DataFrame, as_of: str, baseline_days: int = 30, comparison_days: int = 1, warn: float = 2.0, crit: float = 3.0) -> DataFrame:
    """Welch's z of the newest days against the days before, by agent and metric."""
    rows = trailing(tr, as_of, baseline_days + comparison_days)
    recent = F.col("ts") >= moment(as_of) - F.make_dt_interval(days=F.lit(comparison_days))
    long = rows.select("agent_id_hash", recent.alias("recent"), *METRICS).unpivot(["agent_id_hash", "recent"], list(METRICS), "metric", "x")
    part = lambda f, side: f(F.when(F.col("recent") == side, F.col("x")))
    stats = long.groupBy("agent_id_hash", "metric").agg(*[part(f, side).alias(f"{n}{k}") for k, side in ((1, False), (2, True)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    error = F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    scored = stats.where("n1 > 1 and n2 > 1").withColumn("z", F.when(error > 0, (F.col("m2") - F.col("m1")) / error))
    level = F.when(F.abs("z") > crit, "critical").when(F.abs("z") > warn, "warning").otherwise("ok")
    return scored.select("agent_id_hash", "metric", F.col("m1").alias("baseline_mean"), F.col("m2").alias("recent_mean"), F.col("n1").alias("baseline_n"), F.col("n2").alias("recent_n"), "z", level.alias("level"))


def override_rate_anomalies(tr: DataFrame, as_of: str, days: int = 7, min_traces: int = 20, warn: float = 2.0, crit: float = 3.0) -> DataFrame:
    """Agents overridden more than twice as often as the mean agent of their domain."""
    rows = trailing(tr, as_of, days)
    rates = rows.groupBy("agent_id_hash", "dsdma_domain").agg(F.count("*").alias("n"), F.count_if("action_was_overridden").alias("overrides")).where(F.col("n") >= min_traces).withColumn("value", F.col("overrides") / F.col("n"))
    domain = rates.groupBy("dsdma_domain").agg(F.avg("value").alias("baseline"))
    found = rates.join(domain, "dsdma_domain").where(F.col("value") > warn * F.col("baseline")).join(evidence(rows, ["agent_id_hash", "dsdma_domain"]), ["agent_id_hash", "dsdma_domain"])
    severity = F.when(F.col("value") > crit * F.col("baseline"), "critical").otherwise("warning")
    return build_alerts(found.select("agent_id_hash", F.col("dsdma_domain").alias("domain"), F.lit("override_rate").alias("metric"), "value", "baseline", (F.col("value") / F.col("baseline")).alias("deviation"), severity.alias("severity"), "evidence"), "conscience_override")


def cohort_override_rates(tr: DataFrame, as_of: str, days: int = 7, min_traces: int = 10) -> DataFrame:
    """Override rate of every agent against the pooled rate of its deployment domain."""
    rates = trailing(tr, as_of, days).groupBy("deployment_domain", "agent_id_hash").agg(F.count("*").alias("n"), F.count_if("action_was_overridden").alias("k")).where(F.col("n") >= min_traces)
    cohort = Window.partitionBy("deployment_domain")
    pooled = F.sum("k").over(cohort) / F.sum("n").over(cohort)
    return rates.select("deployment_domain", "agent_id_hash", "n", (F.col("k") / F.col("n")).alias("rate"), pooled.alias("cohort_rate"), F.when(pooled > 0, F.col("k") / F.col("n") / pooled).alias("multiple"))


def run_all_detections(tr: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """Alerts of all five detectors; critical ones first.

    The detectors read one slice: the columns they use, over the longest window.  A caller
    who runs them more than once can persist that slice and release it afterwards.
    """
    span = {} if days is None else {"days": days}
    used = ["trace_id", "agent_id_hash", "dsdma_domain", "trace_type", "ts", "selected_action", *METRICS, "signature_verified", "action_was_overridden", "audit_sequence_number"]
    tr = trailing(tr, as_of, days or 30).select(*used)
    detectors = (cross_agent_divergence, intra_agent_inconsistency, hash_chain_alerts, daily_drift, override_rate_anomalies)
    parts = [f(tr, as_of, **span) for f in detectors]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "mechanism", "agent_id_hash", "metric", "alert_id")


def z_scores(df: DataFrame, column: str, by: str) -> DataFrame:
    """Population z of every value among its group: none for one value alone, zero without spread.

    Groups are summed up before they are joined to their rows, so none is sorted or held.
    """
    stats = df.groupBy(F.col(by).alias("__by")).agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__sd"), F.count(column).alias("__n"))
    z = F.when(F.col("__n") < 2, F.lit(None)).when(F.col("__sd") == 0, 0.0).otherwise((F.col(column) - F.col("__mean")) / F.col("__sd"))
    return df.join(stats, F.col(by).eqNullSafe(F.col("__by"))).withColumn("z", z).drop("__by", "__mean", "__sd", "__n")


def outliers(df: DataFrame, column: str, by: str, threshold: float = 2.0) -> DataFrame:
    return z_scores(df, column, by).where(F.abs("z") > threshold)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts by mechanism, and over all in the row of null; ``alerts`` says which were acknowledged and resolved."""
    is_ = lambda level: F.count_if(F.col("severity") == level)
    return alerts.rollup("mechanism").agg(
        F.count("*").alias("alerts"),
        is_("critical").alias("critical"),
        is_("warning").alias("warnings"),
        F.count_if(F.col("acknowledged") == F.lit(False)).alias("unacknowledged"),
        F.count_if("resolved").alias("resolved"),
        F.countDistinct("agent_id_hash").alias("agents"),
    )


def weekly_rolling(tr: DataFrame) -> DataFrame:
    """Mean of daily mean coherence over the last seven rows of each agent."""
    daily = tr.groupBy("agent_id_hash", F.to_date("ts").alias("day")).agg(F.avg("coherence").alias("m"))
    week = Window.partitionBy("agent_id_hash").orderBy("day").rowsBetween(-6, 0)
    return daily.select("agent_id_hash", "day", F.avg("m").over(week).alias("avg7"))


def override_pct_daily(tr: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return trailing(tr, as_of, days).groupBy("agent_id_hash", F.to_date("ts").alias("day")).agg((100.0 * F.count_if("action_was_overridden") / F.count("*")).alias("override_pct"), F.count("*").alias("n"))


def faculty_pass_rates(tr: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Pass rates of four faculties; a check that was not run counts as not passed."""
    faculties = ("entropy_passed", "coherence_passed", "optimization_veto_passed", "epistemic_humility_passed")
    return trailing(tr, as_of, days).groupBy("agent_id_hash").agg(*[_rate(f).alias(f.replace("_passed", "_rate")) for f in faculties])


def action_distribution(tr: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return trailing(tr, as_of, days).groupBy("agent_id_hash", "trace_type", "selected_action").agg(F.count("*").alias("n"))


def mean_divergence(tr: DataFrame) -> DataFrame:
    """Mean distance of agents' plausibility from their domain's, in its deviations."""
    agent = tr.groupBy("dsdma_domain", "agent_id_hash").agg(F.avg("csdma").alias("m"))
    domain = agent.groupBy("dsdma_domain").agg(F.avg("m").alias("dm"), F.stddev_samp("m").alias("sd"))
    return agent.join(domain, "dsdma_domain").groupBy("dsdma_domain").agg((F.avg(F.abs(F.col("m") - F.col("dm")) / F.nullif("sd", F.lit(0.0)))).alias("avg_z"))
