"""Five-factor scores of agents.

Every factor is additive in traces, so one grouped pass over two windows gives the
inputs of all agents; calibration buckets and the trend are joined to it.
A value of zero counts as missing where the reference's defaults do so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.filters import exclude_benchmark
from tracemill.operators.windows import lagged, moment

AGENT = "agent_name"
#: fixed values: the actions whose checks are run, and the parameters of the factors
NON_EXEMPT = ("SPEAK", "TOOL", "MEMORIZE", "FORGET")
IDENTITY_RATE, CONTRADICTION_RATE = 5.0, 10.0
DECAY, POSITIVE_WEIGHT, FACULTY_WEIGHT = 0.05, 0.15, 0.10
IGNORE_BELOW, FULL_AT, TREND_POINTS, TREND_SIZE = 0.05, 0.15, 5, 0.05
FLOOR = 0.1
FACULTIES = ("entropy_passed", "coherence_passed", "optimization_veto_passed", "epistemic_humility_passed")
COVERED = ("thought_id", "csdma", "dsdma", "k_eff", "conscience_passed", "coherence", "entropy", "selected_action", "action_success", "signature_key_id")


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends count."""
    return df.where((F.col("ts") >= moment(start)) & (F.col("ts") <= moment(end)))


def scored(df: DataFrame, start: str, end: str) -> DataFrame:
    """Traces of a window that count for factors: all but those of benchmarks."""
    return exclude_benchmark(between(df, start, end))


def acting(df: DataFrame) -> DataFrame:
    return df.where(F.substring_index("selected_action", ".", -1).isin(*NON_EXEMPT))


def _or(column: str | Column, default: object) -> Column:
    """The value, or the default for null and zero."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(value, F.lit(0.0)), default if isinstance(default, Column) else F.lit(default))


def _share(condition: str, total: str = "n") -> Column:
    return F.col(condition) / F.greatest(F.col(total), F.lit(1))


def factor_c(tr: DataFrame, start: str, end: str) -> DataFrame:
    """Core identity: drift of names and overridden actions."""
    rows = acting(scored(tr, start, end)).groupBy(AGENT).agg(F.count("*").alias("n"), F.count_if("action_was_overridden").alias("k"), F.countDistinct(AGENT).alias("names"))
    drift = F.greatest(F.lit(0.0), (F.col("names") - 1) / F.greatest("n", F.lit(1)))
    return rows.select(AGENT, "n", (F.exp(-IDENTITY_RATE * drift) * F.exp(-CONTRADICTION_RATE * _share("k"))).alias("score"))


def factor_i_int(tr: DataFrame, start: str, end: str) -> DataFrame:
    """Integrity: verified signatures times the completeness of ten fields."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in COVERED), F.lit(0)) / 10.0
    rows = scored(tr, start, end).groupBy(AGENT).agg(F.count("*").alias("n"), F.count_if("signature_verified").alias("v"), F.avg(filled).alias("coverage"))
    return rows.select(AGENT, "n", (_share("v") * F.col("coverage")).alias("score"))


def trend(tr: DataFrame, start: str, end: str, points: int = TREND_POINTS) -> DataFrame:
    """Whether the newest values go steadily one way by more than the threshold."""
    rows = acting(scored(tr, start, end)).where("csdma is not null")
    newest = Window.partitionBy(AGENT).orderBy(F.desc("ts"), F.desc("event_id"))
    top = rows.select(AGENT, "csdma", F.row_number().over(newest).alias("rn")).where(F.col("rn") <= points)
    series = top.groupBy(AGENT).agg(F.sort_array(F.collect_list(F.struct(-F.col("rn"), "csdma")))["csdma"].alias("x"))
    steps = F.zip_with(F.slice("x", 2, points), F.expr("slice(x, 1, size(x) - 1)"), lambda b, a: b - a)
    size = F.element_at("x", -1) - F.element_at("x", 1)
    enough = (F.size("x") >= 3) & (F.abs(size) > TREND_SIZE)
    down, up = enough & F.forall(steps, lambda d: d <= 0), enough & F.forall(steps, lambda d: d >= 0)
    return series.select(AGENT, F.when(F.size("x") >= 3, size).otherwise(0.0).alias("magnitude"), F.when(down, "declining").when(up, "improving").otherwise("stable").alias("direction"))


def factor_r(tr: DataFrame, start: str, end: str, baseline_start: str) -> DataFrame:
    """Resilience: absolute change against the baseline; a trace at ``start`` counts on both sides."""
    rows = acting(scored(tr, baseline_start, end))
    old, new = F.col("ts") <= moment(start), F.col("ts") >= moment(start)
    stats = rows.groupBy(AGENT).agg(F.avg(F.when(old, F.col("csdma"))).alias("b"), F.count_if(old).alias("bn"), F.avg(F.when(new, F.col("csdma"))).alias("r"), F.count_if(new).alias("n"))
    base = _or("b", 0.9)
    change = F.abs(_or("r", base) - base)
    penalty = F.when(change < IGNORE_BELOW, 0.0).when(change >= FULL_AT, 1.0).otherwise((change - IGNORE_BELOW) / (FULL_AT - IGNORE_BELOW))
    trust = F.when(F.col("bn") < 10, 0.5).when(F.col("bn") < 20, 0.75).otherwise(1.0)
    return stats.where("n > 0").select(AGENT, "n", change.alias("change"), (1.0 - penalty * trust).alias("score"))


def factor_i_inc(tr: DataFrame, start: str, end: str) -> DataFrame:
    """Incompleteness awareness: calibration in ten buckets, and failures under high entropy."""
    rows = acting(scored(tr, start, end))
    known = rows.where("csdma is not null and action_success is not null").groupBy(AGENT, F.floor(F.col("csdma") * 10).alias("bucket"))
    buckets = known.agg(F.avg(F.when(F.col("action_success"), 1.0).otherwise(0.0)).alias("s"), F.avg("csdma").alias("c"), F.count("*").alias("k"))
    ece = buckets.groupBy(AGENT).agg((F.sum(F.col("k") * F.abs(F.col("c") - F.col("s"))) / F.sum("k")).alias("ece"))
    unsafe = rows.groupBy(AGENT).agg(F.count("*").alias("n"), F.count_if((F.col("entropy") > 0.5) & ~F.col("action_success")).alias("u"))
    both = unsafe.join(ece, AGENT, "left")
    return both.select(AGENT, "n", _or("ece", 0.1).alias("ece"), ((1 - _or("ece", 0.1)) * (1 - _share("u"))).alias("score"))


def factor_s(tr: DataFrame, start: str, end: str, decay: float = DECAY) -> DataFrame:
    """Sustained coherence: recent checks weigh more; positive moments and full passes lift it."""
    rows = acting(scored(tr, start, end))
    age = (F.unix_micros(moment(end)) - F.unix_micros("ts")) / 86_400_000_000.0
    weight = F.when(F.col("coherence_passed").isNotNull(), F.exp(-decay * age))
    every = lambda f: F.forall(F.array(*[f(c) for c in FACULTIES]), lambda x: x)
    passed = every(lambda c: F.coalesce(F.col(c), F.lit(False)))
    evaluated = every(lambda c: F.col(c).isNotNull())
    stats = rows.groupBy(AGENT).agg(
        F.count("*").alias("n"), (F.sum(F.when(F.col("coherence_passed"), weight).otherwise(0.0)) / F.sum(weight)).alias("base"),
        F.count_if("has_positive_moment").alias("p"), F.count_if(passed).alias("f"), F.count_if(evaluated).alias("e"),
    )
    lifted = _or("base", 0.5) * (1 + POSITIVE_WEIGHT * _share("p")) * (1 + FACULTY_WEIGHT * _share("f", "e"))
    return stats.select(AGENT, "n", F.least(F.lit(1.0), lifted).alias("score"))


def confidence(n: Column) -> Column:
    return F.when(n < 10, "insufficient").when(n < 30, "low").when(n < 100, "medium").otherwise("high")


def category(score: Column) -> Column:
    return F.when(score < 0.3, "high_fragility").when(score < 0.6, "moderate").when(score < 0.85, "healthy").otherwise("high_capacity")


def factor_sums(tr: DataFrame, start: str, end: str, baseline_start: str) -> DataFrame:
    """The sums that all five factors of every agent are made of, from one scan of both windows.

    Rows are added up by agent and calibration bucket, then by agent; every part is a
    count or a sum, so maps combine them before either shuffle.
    """
    rows = scored(tr, baseline_start, end)
    old, new = F.col("ts") <= moment(start), F.col("ts") >= moment(start)
    act = F.substring_index("selected_action", ".", -1).isin(*NON_EXEMPT)
    now, before = act & new, act & old
    filled = sum((F.col(c).isNotNull().cast("int") for c in COVERED), F.lit(0)) / 10.0
    judged = now & F.col("csdma").isNotNull() & F.col("action_success").isNotNull()
    weight = F.exp(-DECAY * (F.unix_micros(moment(end)) - F.unix_micros("ts")) / 86_400_000_000.0)
    every = lambda f: reduce(lambda a, b: a & b, [f(c) for c in FACULTIES])
    count = lambda c: F.count_if(c)
    total = lambda c, x: F.sum(F.when(c, x))
    parts = {
        "traces": count(new), "verified": count(new & F.col("signature_verified")), "filled": total(new, filled), "n": count(now), "overrides": count(now & F.col("action_was_overridden")),
        "b": total(before, F.col("csdma")), "b_k": count(before & F.col("csdma").isNotNull()), "bn": count(before), "r": total(now, F.col("csdma")), "r_k": count(now & F.col("csdma").isNotNull()),
        "unsafe": count(now & (F.col("entropy") > 0.5) & ~F.col("action_success")), "s": total(now & F.col("coherence_passed"), weight), "s_all": total(now & F.col("coherence_passed").isNotNull(), weight),
        "positive": count(now & F.col("has_positive_moment")), "passed": count(now & every(lambda c: F.coalesce(F.col(c), F.lit(False)))), "evaluated": count(now & every(lambda c: F.col(c).isNotNull())),
    }
    bucket = F.when(judged, F.floor(F.col("csdma") * 10))
    calibration = {"k": count(judged), "sure": total(judged, F.col("csdma")), "right": total(judged, F.when(F.col("action_success"), 1.0).otherwise(0.0))}
    by_bucket = rows.groupBy(AGENT, bucket.alias("bucket")).agg(*[x.alias(name) for name, x in (parts | calibration).items()])
    off = F.abs(F.col("sure") - F.col("right"))  # of a bucket: its size times the distance of its means
    return by_bucket.groupBy(AGENT).agg(*[F.sum(name).alias(name) for name in parts], F.sum("k").alias("k"), F.sum(off).alias("off")).where("traces > 0")


def composite(tr: DataFrame, start: str, end: str, baseline_start: str) -> DataFrame:
    """All factors, their product, fragility and category; an agent without acting traces has the factors' defaults."""
    sums = factor_sums(tr, start, end, baseline_start)
    mean = lambda x, k: F.col(x) / F.nullif(F.col(k), F.lit(0))
    base = _or(mean("b", "b_k"), 0.9)
    change = F.abs(_or(mean("r", "r_k"), base) - base)
    penalty = F.when(change < IGNORE_BELOW, 0.0).when(change >= FULL_AT, 1.0).otherwise((change - IGNORE_BELOW) / (FULL_AT - IGNORE_BELOW))
    trust = F.when(F.col("bn") < 10, 0.5).when(F.col("bn") < 20, 0.75).otherwise(1.0)
    kept = F.when(F.col("s_all") > 0, F.coalesce("s", F.lit(0.0)) / F.col("s_all"))
    lifted = _or(kept, 0.5) * (1 + POSITIVE_WEIGHT * _share("positive")) * (1 + FACULTY_WEIGHT * _share("passed", "evaluated"))
    acted = lambda x, default: F.when(F.col("n") > 0, x).otherwise(F.lit(default))
    whole = sums.select(
        AGENT, "traces", acted(F.exp(-CONTRADICTION_RATE * _share("overrides")), 1.0).alias("c"), (_share("verified", "traces") * F.col("filled") / F.col("traces")).alias("i_int"),
        acted(1.0 - penalty * trust, 1.0).alias("r"), acted((1 - _or(mean("off", "k"), 0.1)) * (1 - _share("unsafe")), 0.9).alias("i_inc"), acted(F.least(F.lit(1.0), lifted), 0.5).alias("s"),
    )
    score = F.col("c") * F.greatest("i_int", F.lit(FLOOR)) * F.col("r") * F.col("i_inc") * F.col("s")
    done = whole.withColumn("composite", score)
    return done.select(AGENT, "traces", "c", "i_int", "r", "i_inc", "s", "composite", (1 / (0.001 + F.col("composite"))).alias("fragility"), category(F.col("composite")).alias("category"), confidence(F.col("traces")).alias("confidence"))


def fleet_scores(tr: DataFrame, start: str, end: str, baseline_start: str) -> DataFrame:
    """Scores from best to worst with the weakest factor of each."""
    factors = F.array(*[F.struct(F.col(c).alias("x"), F.lit(c).alias("name")) for c in ("c", "i_int", "r", "i_inc", "s")])
    return composite(tr, start, end, baseline_start).withColumn("weakest", F.array_min(factors)["name"]).orderBy(F.desc("composite"), AGENT)


def score_alerts(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scores.where(F.col("composite") < threshold)


def fleet_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("category").agg(F.count("*").alias("agents"), F.avg("composite").alias("mean"))


def identity_drift(tr: DataFrame) -> DataFrame:
    """Changes of an agent's name along its traces."""
    rows = tr.select("agent_id_hash", AGENT, "ts", "event_id")
    step = lagged(rows, "agent_id_hash", F.unix_micros("ts"), ["event_id"], [AGENT], bits=36, levels=1)
    changed = F.col(f"before.{AGENT}") != F.col(AGENT)
    return step.groupBy("agent_id_hash").agg(F.count("*").alias("n"), F.count_if(changed).alias("changes"), (F.count_if(changed) / F.count("*")).alias("drift"))


def fragility_mttr(tr: DataFrame) -> DataFrame:
    """Mean hours from a fragile trace to the agent's next one, if that one is not fragile."""
    rows = tr.where("fragility is not null").select("agent_id_hash", "fragility", "ts", "event_id")
    step = lagged(rows, "agent_id_hash", F.unix_micros("ts"), ["event_id"], ["fragility", "ts"], bits=36, levels=1)
    hours = (F.unix_micros("ts") - F.unix_micros("before.ts")) / 3_600_000_000.0
    return step.where("before.fragility and not fragility").groupBy("agent_id_hash").agg(F.avg(hours).alias("mttr_hours"), F.count("*").alias("recoveries"))


def hourly_coherence_divergence(tr: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Spread of agents' mean coherence in every hour of the last days, none where one agent was active."""
    late = tr.where((F.col("ts") > moment(as_of) - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= moment(as_of)))
    hourly = late.groupBy(F.date_trunc("hour", "ts").alias("hour"), AGENT).agg(F.avg("coherence").alias("m"))
    return hourly.groupBy("hour").agg(F.stddev_samp("m").alias("cross_agent_divergence"), F.avg("m").alias("fleet_coherence"))


#: fixed values: where a diagnosis starts to speak
LOW_FACTOR, HIGH_RAW, LOW_BASE, DRIFTED, ENOUGH, COVERAGE = 0.7, 0.9, 0.7, 0.05, 30, 0.8


def diagnose(tr: DataFrame, start: str, end: str, baseline_start: str) -> DataFrame:
    """Each agent's factors, the lowest of them, and what stands in the way of a trusted score.

    Issues: ``<factor>_low``; ``decay`` (age alone pulls coherent traces down, by
    decay_impact); ``drift`` from the baseline (by change); ``few_traces``; and
    ``low_coverage`` (too few of the traces that act have a coherence check).
    """
    rows = between(tr, start, end)
    age = (F.unix_micros(moment(end)) - F.unix_micros("ts")) / 86_400_000_000.0
    checked, passed = F.col("coherence_passed").isNotNull(), F.coalesce(F.col("coherence_passed"), F.lit(False))
    acts = F.substring_index("selected_action", ".", -1).isin(*NON_EXEMPT)
    stats = rows.groupBy(AGENT).agg(F.count("*").alias("total"), F.count_if(acts).alias("non_exempt"), F.avg(age).alias("age_days"), F.count_if(checked).alias("has_coherence"), F.count_if(passed).alias("coherent"))
    weight = F.exp(-DECAY * age)
    share = lambda x: F.sum(F.when(passed, x).otherwise(F.lit(0.0))) / F.sum(F.when(checked, x))
    decayed = acting(scored(tr, start, end)).groupBy(AGENT).agg(share(F.lit(1.0)).alias("raw_rate"), share(weight).alias("s_base"))
    scores = composite(tr, start, end, baseline_start).drop("traces", "fragility", "category", "confidence")
    change = factor_r(tr, start, end, baseline_start).select(AGENT, "change")
    both = stats.join(scores, AGENT).join(decayed, AGENT, "left").join(change, AGENT, "left")
    factors = ("c", "i_int", "r", "i_inc", "s")
    low = [F.when(F.col(f) < LOW_FACTOR, F.lit(f"{f}_low")) for f in factors]
    said = [
        F.when((F.col("raw_rate") > HIGH_RAW) & (F.col("s_base") < LOW_BASE), F.lit("decay")),
        F.when(F.col("change") > DRIFTED, F.lit("drift")),
        F.when(F.col("total") < ENOUGH, F.lit("few_traces")),
        F.when(F.col("coverage") < COVERAGE, F.lit("low_coverage")),
    ]
    lowest = F.array_min(F.array(*[F.struct(F.col(f).alias("x"), F.lit(f).alias("name")) for f in factors]))["name"]
    done = both.withColumn("coverage", F.col("has_coherence") / F.nullif("non_exempt", F.lit(0))).withColumn("decay_impact", F.col("raw_rate") - F.col("s_base"))
    numbers = ["total", "non_exempt", "age_days", "has_coherence", "coherent", *factors, "composite", "change", "coverage", "decay_impact"]
    return done.select(AGENT, *numbers, lowest.alias("lowest"), F.array_compact(F.array(*low, *said)).alias("issues"))


def factor_inputs(tr: DataFrame, start: str, end: str, baseline_start: str) -> DataFrame:
    """One row per agent hash with everything that the composition from inputs needs."""
    recent = between(tr, start, end)
    order = Window.partitionBy("agent_id_hash").orderBy("ts", "event_id")
    seq = F.col("audit_sequence_number")
    rows = recent.select("*", F.coalesce(F.lag(AGENT).over(order) != F.col(AGENT), F.lit(False)).alias("renamed"), F.coalesce(seq - F.lag(seq).over(order) != 1, F.lit(False)).alias("gap"), F.coalesce(F.lag("fragility").over(order) & ~F.col("fragility"), F.lit(False)).alias("recovered"))
    sums = rows.groupBy("agent_id_hash").agg(
        F.count("*").alias("n"), F.count_if("renamed").alias("renames"), F.count_if("action_was_overridden").alias("overrides"), F.count_if("gap").alias("gaps"), F.count_if("signature_verified").alias("signed"), F.count_if("recovered").alias("recoveries"),
        F.avg(F.when(F.col("action_success").isNotNull(), F.abs(F.col("csdma") - F.col("action_success").cast("double")))).alias("calibration_error"),
        F.avg(F.when((F.col("entropy") > 0.5) & (F.col("action_success") == F.lit(False)), 1.0).otherwise(0.0)).alias("unsafe"), F.avg("csdma").alias("mean"),
    )
    old = between(tr, baseline_start, start).groupBy("agent_id_hash").agg(F.avg("csdma").alias("old_mean"), F.stddev_samp("csdma").alias("old_sd"))
    hourly = recent.groupBy("agent_id_hash", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("coherence").alias("c")).groupBy("agent_id_hash").agg(F.avg("c").alias("hourly_coherence"), F.count("*").alias("hours"))
    z = F.when(F.col("old_sd") > 0, (F.col("mean") - F.col("old_mean")) / F.col("old_sd")).otherwise(0.0)
    return sums.join(old, "agent_id_hash", "left").join(hourly, "agent_id_hash").withColumn("drift_z", z).drop("old_mean", "old_sd", "mean")


def composite_from_inputs(inputs: DataFrame) -> DataFrame:
    """Factors and product from the inputs; the drift band is applied to |z|, as the reference does."""
    n, z = F.col("n"), F.abs("drift_z")
    c = F.exp(-IDENTITY_RATE * F.col("renames") / n) * F.exp(-CONTRADICTION_RATE * F.col("overrides") / n)
    i_int = F.greatest(F.lit(FLOOR), (1 - F.col("gaps") / n) * F.col("signed") / n)
    penalty = F.when(z < IGNORE_BELOW, 0.0).when(z >= FULL_AT, 1.0).otherwise((z - IGNORE_BELOW) / (FULL_AT - IGNORE_BELOW))
    i_inc = (1 - F.coalesce("calibration_error", F.lit(0.1))) * (1 - F.col("unsafe"))
    s = F.greatest(F.lit(FLOOR), F.coalesce("hourly_coherence", F.lit(0.5)))
    made = inputs.select("agent_id_hash", "n", c.alias("c"), i_int.alias("i_int"), (1.0 - penalty).alias("r"), i_inc.alias("i_inc"), s.alias("s"))
    return made.withColumn("composite", F.col("c") * F.col("i_int") * F.col("r") * F.col("i_inc") * F.col("s"))


def factors_v1(tr: DataFrame, as_of: str, days: int = 7, baseline_days: int = 30) -> DataFrame:
    """Factors of the earlier score for each agent name.

    A name is the group, so it never changes within one: identity drift is 0, as the
    earlier score has it.  Resilience is a sigmoid of drift and recovery, coherence a
    decayed share of all traces of four windows.
    """
    back = lambda d: moment(as_of) - F.make_dt_interval(days=F.lit(d))
    known = tr.where(F.col(AGENT).isNotNull() & (F.col("ts") <= moment(as_of)))
    recent = known.where(F.col("ts") > back(days))
    filled = sum((F.col(c).isNotNull().cast("int") for c in COVERED), F.lit(0)) / 10.0
    sums = recent.groupBy(AGENT).agg(
        F.count("*").alias("n"), F.count_if("action_was_overridden").alias("overrides"), F.count_if("signature_verified").alias("verified"), F.avg(filled).alias("coverage"),
        F.count_if((F.col("entropy") > 0.5) & (F.col("action_success") == F.lit(False))).alias("unsafe"), F.avg("csdma").alias("csdma"), F.avg("coherence").alias("coherence"),
    )
    before = known.where((F.col("ts") >= back(baseline_days)) & (F.col("ts") <= back(days)))
    old = before.groupBy(AGENT).agg(*[f(c).alias(f"{c}_{name}") for c in ("csdma", "coherence") for name, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    order = Window.partitionBy(AGENT).orderBy("ts", "event_id")
    seen = recent.where("fragility is not null").select(AGENT, "fragility", "ts", F.lead("fragility").over(order).alias("after"), F.lead("ts").over(order).alias("until"))
    mttr = seen.where("fragility and not after").groupBy(AGENT).agg(F.avg((F.unix_micros("until") - F.unix_micros("ts")) / 3_600_000_000.0).alias("mttr"))
    judged = recent.where("csdma is not null and action_success is not null").groupBy(AGENT, F.floor(F.col("csdma") * 10).alias("bucket"))
    buckets = judged.agg(F.avg(F.when(F.col("action_success"), 1.0).otherwise(0.0)).alias("s"), F.avg("csdma").alias("c"), F.count("*").alias("k"))
    ece = buckets.groupBy(AGENT).agg((F.sum(F.col("k") * F.abs(F.col("c") - F.col("s"))) / F.sum("k")).alias("ece"))
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("ts")) / 86_400_000_000.0
    decayed = known.where(F.col("ts") > back(4 * days)).groupBy(AGENT).agg(F.avg(F.when(F.col("coherence_passed"), 1.0).otherwise(0.0) * F.exp(-DECAY * age)).alias("s"))
    whole = sums
    for part in (old, mttr, ece, decayed):
        whole = whole.join(part, AGENT, "left")
    z = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), F.lit(0.0))
    drift, hours = F.greatest(z("csdma"), z("coherence")), F.coalesce("mttr", F.lit(0.0))
    raw = (1 - F.least(drift / 3, F.lit(1.0))) / (1 + hours)
    return whole.select(
        AGENT, "n", F.exp(-CONTRADICTION_RATE * _share("overrides")).alias("c"), (_share("verified") * F.col("coverage")).alias("i_int"), (1 / (1 + F.exp(-5.0 * (raw - 0.5)))).alias("r"),
        ((1 - _or("ece", 0.1)) * (1 - _share("unsafe"))).alias("i_inc"), F.coalesce("s", F.lit(0.0)).alias("s"), drift.alias("drift"), hours.alias("mttr_hours"),
    )


def composite_v1(factors: DataFrame) -> DataFrame:
    """The earlier composite of all five factors, two of them not below a floor, its fragility, and how far the data suffice."""
    enough = F.when(F.col("n") == 0, "no_data").when(F.col("n") < 10, "minimal").when(F.col("n") < 30, "provisional").otherwise("sufficient")
    score = F.col("c") * F.greatest("i_int", F.lit(FLOOR)) * F.col("r") * F.col("i_inc") * F.greatest("s", F.lit(FLOOR))
    made = factors.withColumn("composite", score)
    return made.select(AGENT, "n", "composite", (1 / (0.001 + F.col("composite"))).alias("fragility"), category(F.col("composite")).alias("category"), enough.alias("data"), (F.col("n") < 30).alias("is_provisional"))
