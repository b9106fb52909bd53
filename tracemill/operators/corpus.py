"""Shape and independence of a corpus of traces."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.views import outcome, task_outcome
from tracemill.sources.otlp import written

#: fixed values: the features of the constraint vector and how a null counts: it stays, is 0, or is false; "tri" flags are 1, 0 or null
FEATURES = {
    "csdma": "plain", "dsdma": "plain", "coherence": "plain", "entropy": "plain", "k_eff": "plain", "correlation_risk": "plain",
    "entropy_score": "zero", "coherence_score": "zero", "optimization_veto_entropy_ratio": "zero", "epistemic_humility_certainty": "zero",
    "fragility": "flag", "entropy_passed": "tri", "coherence_passed": "tri", "optimization_veto_passed": "tri", "epistemic_humility_passed": "tri", "conscience_passed": "flag", "action_was_overridden": "flag",
}
ESSENTIAL = ("csdma", "k_eff")
FACETS = ("task_class", "agent_name", "cognitive_state", "trace_level", "primary_model", "qa_language", "qa_question", "deployment_region", "user_timezone")
#: facets that only traces of one class have
_ONLY_QA = ("qa_language", "qa_question")


def corpus_totals(tc: DataFrame) -> DataFrame:
    distinct = [F.countDistinct(c).alias(name) for c, name in (("task_id", "tasks"), ("thought_id", "thoughts"), ("agent_name", "agents"))]
    return tc.agg(F.count("*").alias("traces"), *distinct, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def corpus_facets(tc: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """Counts of every value of every facet, in one pass of grouping sets, and shares of all traces."""
    qa = F.col("task_class") == "qa_eval"
    marked = tc.select(*[F.col(f) for f in facets], qa.alias("__qa"))
    held = [f for f in facets if f in _ONLY_QA]
    sets = [[f, "__qa"] if f in held else [f] for f in facets] + [[]]
    grouped = marked.groupingSets(sets, *facets, "__qa").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # grouping_id has a 0 bit where the column is grouped by; the first column is the highest bit
    width = len(facets) + 1
    ids = {f: ((1 << width) - 1) ^ (1 << (width - 1 - i)) ^ (1 if f in held else 0) for i, f in enumerate(facets)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f, g in ids.items():
        name, value = F.when(F.col("g") == g, f).otherwise(name), F.when(F.col("g") == g, F.col(f).cast("string")).otherwise(value)
    total = F.max(F.when(F.col("g") == (1 << width) - 1, F.col("n"))).over(Window.partitionBy())  # over a row for each value, not for each trace
    named = grouped.withColumn("total", total).select(name.alias("facet"), value.alias("value"), "n", "total", "__qa")
    kept = named.where(F.col("facet").isNotNull() & (~F.col("facet").isin(*held) | F.coalesce("__qa", F.lit(False))))
    return kept.select("facet", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def k_anonymous(df: DataFrame, cell: Sequence[str], entity: str, k: int = 5) -> DataFrame:
    """Cells with at least ``k`` different entities."""
    return df.groupBy(*cell).agg(F.countDistinct(entity).alias("entities"), F.count("*").alias("n")).where(F.col("entities") >= k)


def top_cells(df: DataFrame, cell: Sequence[str], entity: str, n: int = 20, k: int = 5) -> DataFrame:
    return k_anonymous(df, cell, entity, k).orderBy(F.desc("n"), *cell).limit(n)


def signal_health(tr: DataFrame) -> DataFrame:
    """How many traces carry each of nine signals; a check that was not run is no veto."""
    vetoed = lambda check: F.count_if(F.col(check) == F.lit(False))
    return tr.agg(
        F.count_if(F.col("csdma") == 0).alias("csdma_zero"),
        F.count_if(F.col("csdma") >= 0.9).alias("csdma_high"),
        vetoed("coherence_passed").alias("coherence_vetoed"),
        vetoed("entropy_passed").alias("entropy_vetoed"),
        vetoed("optimization_veto_passed").alias("optimization_vetoed"),
        vetoed("epistemic_humility_passed").alias("epistemic_vetoed"),
        F.count_if("fragility").alias("fragile"),
        F.count_if("signature_verified").alias("signature_ok"),
        F.count_if("action_was_overridden").alias("overridden"),
        F.count("*").alias("total"),
    )


def stationarity(tr: DataFrame, metrics: Sequence[str] = ("csdma", "dsdma", "coherence", "entropy"), limit: float = 0.10) -> DataFrame:
    """Means and counts before and after the middle of the time in which a metric has values."""
    at = F.unix_micros("ts")
    middle = lambda m: ((F.min(F.when(F.col(m).isNotNull(), at)) + F.max(F.when(F.col(m).isNotNull(), at))) / 2).alias(f"middle_{m}")
    ends = tr.agg(*[middle(m) for m in metrics])  # one row
    halves = tr.join(F.broadcast(ends), how="cross")
    each = halves.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), (at >= F.col(f"middle_{m}")).alias("late")) for m in metrics])).alias("v")).select("v.*").where("x is not null")
    half = lambda f, late: f(F.when(F.col("late") == late, F.col("x")))
    means = each.groupBy("metric").agg(half(F.avg, False).alias("first"), half(F.avg, True).alias("second"), half(F.count, False).alias("first_n"), half(F.count, True).alias("second_n"))
    return means.withColumn("shifted", F.abs(F.col("first") - F.col("second")) >= limit)


def constraint_vector(tc: DataFrame, keep: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Seventeen features as numbers, nulls as each feature has it."""
    number = {
        "plain": lambda c: F.col(c).cast("double"),
        "zero": lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)),
        "flag": lambda c: F.when(F.col(c), 1.0).otherwise(0.0),
        "tri": lambda c: F.col(c).cast("double"),
    }
    return tc.select(*keep, *[number[kind](c).alias(c) for c, kind in FEATURES.items()])


def newest(tc: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The last ``n`` rows, of each group if there is one; a rank limit that Spark applies before the shuffle."""
    if by is None:
        return tc.orderBy(F.desc("ts"), F.desc("trace_id")).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("trace_id")))
    return tc.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def _sizes(sums: np.ndarray, cross: np.ndarray, n: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Participation ratio and exp-entropy of the spectrum of the correlation matrix, which features vary, and the first component."""
    mean = sums / n
    cov = (cross - n * np.outer(mean, mean)) / max(n - 1, 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    used = sd > 1e-9
    if n < 2 or not used.any():
        return 0.0, 0.0, used, np.zeros(0)
    values, vectors = np.linalg.eigh(cov[np.ix_(used, used)] / np.outer(sd[used], sd[used]))
    values = np.clip(values, 0, None)
    p = values / values.sum()
    first = vectors[:, -1]
    first = first * np.sign(first[np.argmax(np.abs(first))])  # an eigenvector has no sign of its own
    return float(values.sum() ** 2 / (values**2).sum()), float(np.exp(-(p * np.log(p + 1e-30)).sum())), used, first


def n_eff(tc: DataFrame, by: str | None = None, features: Sequence[str] = tuple(FEATURES), top: int = 8) -> DataFrame:
    """Effective number of independent features, of each group if there is one, and the largest loadings of the first component.

    Rows without an essential feature go; other gaps get the group's mean.  The rows are
    made and read once: sums of products, a fixed number for each group, leave a task.
    """
    group = F.lit("all") if by is None else F.col(by).cast("string")
    vector = constraint_vector(tc.withColumn("__g", group), ["__g"]) if set(features) == set(FEATURES) else tc.select(group.alias("__g"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = vector.dropna(subset=[c for c in ESSENTIAL if c in features])
    names = list(features)

    def parts(frames):  # noqa: ANN001, ANN202
        held: dict = {}
        for frame in frames:
            for g, some in frame.groupby("__g", dropna=False):
                g = None if pd.isna(g) else g
                n, sums = held.get(g, (0, 0.0))
                held[g] = n + len(some), sums + _moment_sums(some[names].to_numpy(dtype=float))
            if len(held) > 1000:
                yield _part_rows(held)
                held = {}
        yield _part_rows(held)

    done = rows.select("__g", *names).mapInPandas(parts, "w string, n long, held array<double>").groupBy("w").applyInArrow(_window_sizes(names, top), "w string, n long, participation double, entropy_size double, features long, loadings array<string>")
    return done.withColumnRenamed("w", by or "scope")


def _part_rows(held: dict) -> pd.DataFrame:
    return pd.DataFrame([(g, n, sums.tolist()) for g, (n, sums) in held.items()], columns=["w", "n", "held"])


def _moment_sums(x: np.ndarray) -> np.ndarray:
    """Sums of products, of values by gaps and of gaps, then sums and counts of values: gaps left open, to be filled with means later."""
    gap = np.isnan(x)
    z, open_ = np.where(gap, 0.0, x), gap.astype(float)
    return np.concatenate([np.ravel(p).astype(float) for p in (z.T @ z, z.T @ open_, open_.T @ open_, z.sum(0), (~gap).sum(0))])


def _moments(features: Sequence[str]):
    """Of one pane's rows: what any window that holds it needs, gaps left open."""

    def run(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(c).to_numpy().astype(float) for c in features], 1)
        return pa.table({"pane": table.column("pane").slice(0, 1), "n": pa.array([len(x)], pa.int64()), "held": pa.array([_moment_sums(x).tolist()], pa.list_(pa.float64()))})

    return run


def _window_sizes(features: Sequence[str], top: int):
    """Of one window's panes: their moments added up, gaps filled with the window's means, and the sizes."""
    k = len(features)

    def run(table: pa.Table) -> pa.Table:
        held, n = np.sum(table.column("held").to_pylist(), 0), int(np.sum(table.column("n").to_numpy()))
        both, one, none = held[: 3 * k * k].reshape(3, k, k)
        sums, known = held[3 * k * k :].reshape(2, k)
        mean = np.where(known > 0, sums / np.maximum(known, 1), 0.0)
        cross = both + one * mean + (one * mean).T + none * np.outer(mean, mean)
        ratio, entropy, used, first = _sizes(sums + (n - known) * mean, cross, n)
        labels = np.array(features)[used]
        best = np.argsort(-np.abs(first).round(9), kind="stable")[:top]
        w = table.column("w")[0].as_py()
        row = {"w": None if w is None else str(w), "n": n, "participation": ratio, "entropy_size": entropy, "features": int(used.sum()), "loadings": [f"{labels[i]}={first[i]:.4f}" for i in best]}
        return pa.Table.from_pylist([row], schema=pa.schema([("w", pa.string()), ("n", pa.int64()), ("participation", pa.float64()), ("entropy_size", pa.float64()), ("features", pa.int64()), ("loadings", pa.list_(pa.string()))]))

    return run


def rolling_n_eff(tr: DataFrame, window: int = 500, step: int = 100, features: Sequence[str] = tuple(FEATURES), top: int = 8) -> DataFrame:
    """N_eff of windows of rows in time order.

    Places come from counts of minutes before a row's minute and its rank within the
    minute, so no sort holds more than a minute.  The table of minutes, one small row
    for each that has rows, is in order in one task.  A pane of ``step`` rows becomes one
    matrix of moments; windows are sums of panes, so no row is copied into windows.
    """
    if window % step:
        raise ValueError("a window is a whole number of steps")
    minute = F.date_trunc("minute", "ts")
    counts = tr.groupBy(minute.alias("minute")).agg(F.count("*").alias("c"))
    before = counts.select("minute", (F.sum("c").over(Window.orderBy("minute")) - F.col("c")).alias("before"))
    ranked = tr.withColumn("minute", minute).join(before, "minute").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("minute").orderBy("ts", "trace_id")) - 1)
    total = tr.count()
    placed = ranked.withColumn("pane", F.floor(F.col("at") / step).cast("long"))
    rows = constraint_vector(placed, ["pane"]).dropna(subset=list(ESSENTIAL)).select("pane", *[F.col(c).cast("double").alias(c) for c in features])
    panes = rows.groupBy("pane").applyInArrow(_moments(features), "pane long, n long, held array<double>")
    first = F.greatest(F.lit(0).cast("long"), F.col("pane") - (window // step - 1))
    windows = panes.withColumn("w", F.explode(F.sequence(first, F.col("pane")))).where(F.col("w") * step + window <= total)
    return windows.groupBy("w").applyInArrow(_window_sizes(features, top), "w string, n long, participation double, entropy_size double, features long, loadings array<string>")


def repository_stats(tr: DataFrame, domain: str | None = None) -> DataFrame:
    """Totals, means and rates over all (level ``all``) and in each known domain; of one domain alone if it is named."""
    rate = lambda flag: F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))
    rows = (tr if domain is None else tr.where(F.col("dsdma_domain") == domain)).withColumn("domain_of", F.col("dsdma_domain"))
    sets = [[]] if domain is not None else [[], ["dsdma_domain"]]
    done = rows.groupingSets(sets, "dsdma_domain").agg(
        F.grouping("dsdma_domain").alias("whole"),
        F.count("*").alias("traces"),
        F.countDistinct("agent_id_hash").alias("agents"),
        F.countDistinct("domain_of").alias("domains"),
        *[F.avg(c).alias(c) for c in ("csdma", "dsdma", "k_eff")],
        rate("conscience_passed").alias("conscience_pass_rate"),
        rate("action_was_overridden").alias("override_rate"),
        rate("fragility").alias("fragile_rate"),
    )
    level = F.when(F.col("whole") == 1, "all").otherwise("domain")
    return done.where("whole = 1 or dsdma_domain is not null").withColumn("level", level).drop("whole")


def share_of(tr: DataFrame, column: str | Column) -> DataFrame:
    counted = tr.groupBy(column).agg(F.count("*").alias("n"))
    total = F.broadcast(tr.agg(F.count("*").alias("total")))
    return counted.join(total, how="cross").select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def llm_costs(tr: DataFrame) -> DataFrame:
    """Cost and tokens by model, agent and domain, and in total, in one pass."""
    sets = [["primary_model"], ["agent_name"], ["dsdma_domain"], []]
    return tr.groupingSets(sets, "primary_model", "agent_name", "dsdma_domain").agg(F.grouping_id().alias("level"), F.count("*").alias("calls"), F.sum("tokens_total").alias("tokens"), F.sum("cost_cents").alias("cost_cents"))


def task_flow(tr: DataFrame) -> DataFrame:
    """Thoughts, span, means, last action and outcome of every task."""
    minutes = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60_000_000.0
    flow = tr.where("task_id is not null").groupBy("task_id").agg(F.count("*").alias("thoughts"), minutes.alias("span_minutes"), F.avg("csdma").alias("p"), F.avg("dsdma").alias("a"), F.avg("coherence").alias("c"), F.max_by("selected_action", F.struct("ts", "event_id")).alias("final"))
    return flow.join(task_outcome(tr).select("task_id", "outcome"), "task_id")


def verb_outcomes(tr: DataFrame) -> DataFrame:
    return tr.withColumn("outcome", outcome()).rollup("selected_action", "outcome").agg(F.count("*").alias("n"))


def journey_points(tr: DataFrame) -> DataFrame:
    """Points of traces in three scores with the outcome of their task."""
    points = tr.select("trace_id", "task_id", "csdma", "dsdma", "coherence").dropna()
    return points.join(task_outcome(tr).select("task_id", "outcome"), "task_id")


def task_paths(tr: DataFrame) -> DataFrame:
    """Each task's points in time order; a task has few thoughts, so its path is short."""
    point = F.struct("ts", "event_id", "csdma", "dsdma", "coherence")
    paths = tr.where("task_id is not null").dropna(subset=["csdma", "dsdma", "coherence"]).groupBy("agent_id_hash", "task_id").agg(F.sort_array(F.collect_list(point)).alias("path"))
    return paths.where(F.size("path") >= 2).select("agent_id_hash", "task_id", F.transform("path", lambda p: F.array(p["csdma"], p["dsdma"], p["coherence"])).alias("path"))


def frechets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Fréchet distances of pairs of paths, (pairs x points x 3) each."""
    gap = np.sqrt(((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(3))
    best = gap.copy()
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            ways = [best[:, x, y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            if ways:
                best[:, i, j] = np.maximum(gap[:, i, j], np.minimum.reduce(ways))
    return best[:, -1, -1]


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """The distance of one pair."""
    return float(frechets(a[None], b[None])[0])


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distances of many pairs, those of equal lengths together."""
    sizes = pd.DataFrame({"a": a.map(len), "b": b.map(len)}).reset_index(drop=True)
    out = np.empty(len(a))
    for at in sizes.groupby(["a", "b"]).indices.values():
        out[at] = frechets(*(np.array([np.stack(x) for x in side.iloc[at]], float) for side in (a, b)))
    return pd.Series(out)


def _held() -> Column:
    return F.crc32("task_id") % 5 == 0


def frechet_pairs(paths: DataFrame, pivots: int = 64, levels: int = 8) -> DataFrame:
    """The nearest training path of every path, over all agents and lengths, by exact distance.

    The least distance to a few training paths bounds a path's distance to its nearest.
    No path within the bound starts or ends farther away than it, so a path looks only
    into the cells, of at least twice the bound, that its ends' surroundings touch.
    """

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return _distances(a, b)

    ends = F.concat(F.element_at("path", 1), F.element_at("path", -1))
    named = paths.withColumn("ends", ends).withColumn("id", F.struct("agent_id_hash", "task_id"))
    train = named.where(~_held()).select(F.col("id").alias("other_id"), F.col("path").alias("other_path"), F.col("ends").alias("other_ends"))
    few = train.orderBy(F.xxhash64("other_id"), "other_id").limit(pivots).select("other_id", "other_path")
    met = named.join(F.broadcast(few), F.col("id") != F.col("other_id"))
    bounds = met.groupBy("id").agg(F.min(distance("path", "other_path")).alias("bound"))
    level = F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(-F.log2(2 * F.col("bound") + 1e-9)))).cast("int")
    asked = named.join(bounds, "id").withColumn("level", level)
    cell = lambda x, k: F.floor(x * F.pow(F.lit(2.0), k)).cast("long")
    for i in range(6):
        x = F.col("ends")[i]
        asked = asked.withColumn(f"c{i}", F.explode(F.sequence(cell(x - F.col("bound") - 1e-9, F.col("level")), cell(x + F.col("bound") + 1e-9, F.col("level")))))
    keys = ["level", *[f"c{i}" for i in range(6)]]
    placed = train.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    placed = placed.select("*", *[cell(F.col("other_ends")[i], F.col("level")).alias(f"c{i}") for i in range(6)])
    gap = lambda at: F.sqrt(sum((F.col("ends")[i] - F.col("other_ends")[i]) ** 2 for i in range(at, at + 3)))
    near = asked.join(placed, keys).where((F.col("id") != F.col("other_id")) & (F.greatest(gap(0), gap(3)) <= F.col("bound") + 1e-9))
    done = near.select("id", "other_id", distance("path", "other_path").alias("distance"))
    best = done.groupBy("id").agg(F.min(F.struct("distance", "other_id")).alias("best"))
    return best.select("id.agent_id_hash", "id.task_id", F.col("best.other_id.agent_id_hash").alias("other_agent"), F.col("best.other_id.task_id").alias("other"), "best.distance")


def _least_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links (u, v) reach from each of ``nodes`` (id).

    Rounds after Boruvka: every tree hooks to the smallest label next to it, then labels
    are followed to their ends, so rounds grow with the logarithm of a tree's size.
    """
    labels, seen = nodes.select("id", F.col("id").alias("label")), None
    while True:
        of = lambda name: labels.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))  # noqa: B023, E731
        apart = links.join(of("u"), "u").join(of("v"), "v").where("u_label <> v_label")
        both = apart.select(F.greatest("u_label", "v_label").alias("label"), F.least("u_label", "v_label").alias("to"))
        hooks = both.groupBy("label").agg(F.min("to").alias("to"))
        jump = hooks.join(hooks.select(F.col("label").alias("to"), F.col("to").alias("further")), "to", "left").select("label", F.coalesce("further", "to").alias("to"))
        labels = written(labels.join(jump, "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        now = labels.agg(F.bit_xor(F.xxhash64("id", "label"))).first()
        if now == seen:
            return labels
        seen = now


def route_clusters(paths: DataFrame, reach: float, least: int = 5) -> DataFrame:
    """Clusters of paths by density: (agent_id_hash, task_id, cluster), null for noise.

    A path is dense if ``least`` paths, itself among them, lie within ``reach``; dense
    paths within reach of each other share a cluster, named by its smallest path, and a
    cluster of fewer than ``least`` dense paths is noise.

    Points snap to a grid, and paths that snap to one curve are within half the reach of
    each other: alike paths become one curve, compared once.  Two curves' distance, give or
    take half the reach, settles most pairs; only paths of curves that lie just about at
    the reach are compared themselves.
    """

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return _distances(a, b)

    reach = max(reach, 1e-9)
    side, slack = reach / (2 * 3**0.5), reach / 2  # a point moves a quarter of the reach at most
    cells = F.transform("path", lambda p: F.transform(p, lambda x: F.floor(x / side).cast("long")))
    named = paths.select(F.concat_ws("/", "agent_id_hash", "task_id").alias("id"), "agent_id_hash", "task_id", "path", cells.alias("cells"))
    curve = F.filter("cells", lambda c, i: (i == 0) | (c != F.col("cells")[F.greatest(i - 1, F.lit(0))]))
    members = written(named.withColumn("curve", curve).drop("cells"))
    curves = members.groupBy("curve").agg(F.min("id").alias("key"), F.count("*").alias("m"))
    centre = F.transform("curve", lambda c: F.transform(c, lambda x: (x + 0.5) * side))
    curves = written(curves.withColumn("centre", centre).withColumn("ends", F.concat(F.element_at("centre", 1), F.element_at("centre", -1))))
    members = members.join(curves.select("curve", "key"), "curve").select("id", "key", "agent_id_hash", "task_id", "path")
    far = reach + slack
    cell = lambda x: F.floor(x / (2 * far)).cast("long")
    names = [f"c{i}" for i in range(6)]
    asked = curves.select("key", "centre", "ends")
    for i, n in enumerate(names):
        asked = asked.withColumn(n, F.explode(F.array_distinct(F.array(cell(F.col("ends")[i] - far), cell(F.col("ends")[i] + far)))))
    placed = curves.select(F.col("key").alias("other"), F.col("centre").alias("other_centre"), F.col("ends").alias("other_ends"), *[cell(F.col("ends")[i]).alias(n) for i, n in enumerate(names)])
    gap = lambda at: F.sqrt(sum((F.col("ends")[i] - F.col("other_ends")[i]) ** 2 for i in range(at, at + 3)))
    near = asked.join(placed, names).where((F.col("key") < F.col("other")) & (F.greatest(gap(0), gap(3)) <= far + 1e-9))
    pairs = written(near.select("key", "other", distance("centre", "other_centre").alias("d")).where(F.col("d") <= far + 1e-9))
    sure = F.col("d") + slack <= reach - 1e-9
    settled = pairs.where(sure).select("key", "other")
    side_of = lambda name: members.select(F.col("id").alias(f"{name}_id"), F.col("key").alias(name), F.col("path").alias(f"{name}_path"))
    close = pairs.where(~sure).select("key", "other").join(side_of("key"), "key").join(side_of("other"), "other")
    close = written(close.select(F.col("key_id").alias("u"), F.col("other_id").alias("v"), distance("key_path", "other_path").alias("d")).where(F.col("d") <= reach).select("u", "v"))
    # how many are within reach of each path
    sizes = curves.select("key", "m")
    turned = settled.union(settled.select(F.col("other").alias("key"), F.col("key").alias("other")))
    around = turned.join(sizes.select(F.col("key").alias("other"), "m"), "other").select("key", "m").union(sizes).groupBy("key").agg(F.sum("m").alias("settled"))
    alone = close.select(F.col("u").alias("id")).union(close.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("k"))
    counted = members.join(around, "key").join(alone, "id", "left")
    dense = written(counted.where(F.col("settled") + F.coalesce("k", F.lit(0)) >= least).select("id", "key"))
    firsts = dense.groupBy("key").agg(F.min("id").alias("first"))
    star = dense.join(firsts, "key").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    across = settled.join(firsts, "key").withColumnRenamed("first", "u").join(firsts.select(F.col("key").alias("other"), F.col("first").alias("v")), "other").select("u", "v")
    ids = dense.select("id")
    exact = close.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
    labels = _least_labels(ids, written(star.union(across).union(exact).distinct()))
    large = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    found = labels.join(large, "label").select("id", F.col("label").alias("cluster"))
    return members.join(found, "id", "left").select("agent_id_hash", "task_id", "cluster")


def clustered(paths: DataFrame, pairs: DataFrame, reach: float | None = None, least: int = 5) -> DataFrame:
    """Training paths that are in a cluster, with its name; the others are noise.

    Without a reach it is the 0.9 quantile of the training paths' nearest distances.
    """
    if reach is None:
        reach = pairs.where(~_held()).agg(F.percentile("distance", F.lit(0.9))).first()[0]
    train = paths.where(~_held())
    if reach is None or reach < 0:
        return train.withColumn("cluster", F.lit(None).cast("string")).where(F.lit(False))
    return train.join(route_clusters(train, reach, least).where("cluster is not null"), ["agent_id_hash", "task_id"])


def route_labels(paths: DataFrame, pairs: DataFrame, reach: float | None = None, least: int = 5) -> DataFrame:
    """Held-out paths by how near the nearest clustered training path is, and its cluster, against what is usual within clusters.

    The nearest clustered path of a clustered one is in its own cluster: a dense path has
    a dense one within the reach, or its cluster would be too small.
    """
    known = written(clustered(paths, pairs, reach, least))
    held = paths.where(_held())
    found = frechet_pairs(held.unionByName(known.drop("cluster")))
    nearest = found.select("agent_id_hash", "task_id", "other_agent", "other", F.col("distance").alias("nearest"))
    cuts = nearest.where(~_held()).agg(F.percentile("nearest", F.lit(0.95)).alias("p95"), F.percentile("nearest", F.lit(0.99)).alias("p99"))
    tested = held.select("agent_id_hash", "task_id").join(nearest, ["agent_id_hash", "task_id"], "left").join(F.broadcast(cuts), how="cross")
    of = known.select(F.col("agent_id_hash").alias("other_agent"), F.col("task_id").alias("other"), "cluster")
    label = F.when(F.col("nearest").isNull(), "no_cluster").when(F.col("nearest") <= F.col("p95"), "canonical").when(F.col("nearest") <= F.col("p99"), "variant").otherwise("novel")
    return tested.join(of, ["other_agent", "other"], "left").select("agent_id_hash", "task_id", "nearest", label.alias("label"), "cluster")


def route_rates(labels: DataFrame) -> DataFrame:
    """Each agent's held-out paths and the shares of their labels."""
    share = lambda x: F.avg(F.when(F.col("label") == x, 1.0).otherwise(0.0)).alias(x)
    return labels.groupBy("agent_id_hash").agg(F.count("*").alias("n"), *[share(x) for x in ("canonical", "variant", "novel", "no_cluster")])
