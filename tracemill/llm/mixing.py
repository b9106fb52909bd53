"""Mixes sources to target weights within a token budget.

Weights flow from the root through a tree of levels (domain, language, source).  A
node gets at most what its leaves hold, times the epochs allowed; what a child
cannot take goes to its siblings by their weights, and only what no sibling can
take goes back to the parent's siblings.  A leaf takes whole epochs and then the
token-prefix of one more, in an order drawn from the seed, the epoch and the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: leaves of the tree, which the driver holds; more are an error, not a cut
MAX_LEAVES = 100_000
#: hexadecimal digits of a row's place that make a bucket
BUCKET_DIGITS = 3
Path = tuple[str, ...]


@dataclass
class Node:
    """A subtree: its weight among siblings, what it can hold, and its children."""

    weight: float
    capacity: int
    children: dict[str, Node]


def tree(leaves: dict[Path, int], weights: dict[Path, float], epochs: int) -> Node:
    """The tree of ``leaves`` (path: tokens).  A path without weight weighs 1."""
    root = Node(1.0, 0, {})
    for path, tokens in sorted(leaves.items()):
        node = root
        node.capacity += tokens * epochs
        for depth in range(len(path)):
            node = node.children.setdefault(path[depth], Node(float(weights.get(path[: depth + 1], 1.0)), 0, {}))
            node.capacity += tokens * epochs
    return root


def budgets(node: Node, budget: float, path: Path = ()) -> dict[Path, int]:
    """Whole tokens for each leaf below ``node``."""
    if not node.children:
        return {path: int(min(budget, node.capacity) + 1e-6)}
    open_, given, left = dict(node.children), {}, min(budget, node.capacity)
    while open_:
        total = sum(c.weight for c in open_.values())
        share = {k: left * c.weight / total if total else left / len(open_) for k, c in open_.items()}
        full = [k for k, c in open_.items() if share[k] >= c.capacity]
        if not full:
            given |= share
            break
        for k in full:  # what it cannot take is shared among the siblings still open
            given[k] = open_.pop(k).capacity
            left -= given[k]
    out: dict[Path, int] = {}
    for k, child in node.children.items():
        out |= budgets(child, given[k], (*path, k))
    return out


def word_tokens(text: str = "text") -> Column:
    """Words of a text, the default measure of tokens."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    levels: Sequence[Column],
    weights: dict[Path, float],
    share: float,
    tokens: Column | None = None,
    key: str = "doc_id",
    epochs: int = 1,
    seed: int = 0,
) -> DataFrame:
    """Rows of ``docs`` chosen for a budget of ``share`` of all tokens, with mix_tokens, mix_epoch and mix_budget.

    A row is returned once for each epoch that takes it.  A leaf's last epoch takes
    rows in its seeded order while their tokens fit into what is left of its budget.

    Defined cases: a null level is a branch of its own; a null or empty text has no
    tokens and is taken if its turn comes while the leaf still takes rows; repeated
    rows have one place in the order and rows of one key are told apart by what they
    hold; a leaf without budget gives no rows; an empty table gives an empty
    result.  Columns of the names above are replaced, others pass through.

    Only sums per leaf, at most MAX_LEAVES, reach the driver.  A leaf of any size is
    cut at its budget by sums of buckets; one bucket alone is put in order.
    """
    made = ("mix_tokens", "mix_epoch", "mix_budget")
    passed = [c for c in docs.columns if c not in made]
    names = [f"level{i}" for i in range(len(levels))]
    # the row is one column, so that no name in it can meet one of these
    counted = docs.select(
        F.struct(F.lit(0), *[F.col(f"`{c}`") for c in passed]).alias("row"),
        F.col(f"`{key}`").cast("string").alias("key"),
        *[F.coalesce(x.cast("string"), F.lit("\u0000null")).alias(n) for n, x in zip(names, levels, strict=True)],
        (word_tokens() if tokens is None else tokens).alias("mix_tokens"),
    )
    sums = counted.groupBy(*names).agg(F.sum("mix_tokens").alias("t")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    held = {tuple(r[n] for n in names): int(r.t or 0) for r in sums}
    plan = []
    shares = budgets(tree(held, weights, epochs), share * sum(held.values())) if held else {}
    for path, budget in shares.items():
        whole = budget // held[path] if held[path] else 0
        plan.append((*path, int(budget), int(whole), int(budget - whole * held[path])))
    kinds = T.StructType([*[T.StructField(n, T.StringType()) for n in names], *[T.StructField(n, T.LongType()) for n in ("mix_budget", "whole", "left")]])
    planned = docs.sparkSession.createDataFrame(plan, kinds)
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "key"), 256)
    placed = counted.join(F.broadcast(planned), names).withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    # where each leaf's budget ends: the first bucket that does not fit whole
    by_bucket = placed.where(F.col("left") > 0).groupBy(*names, "bucket", "left").agg(F.sum("mix_tokens").alias("t"))
    so_far = F.sum("t").over(Window.partitionBy(*names).orderBy("bucket"))
    over = by_bucket.withColumn("upto", so_far).where(F.col("upto") > F.col("left"))
    edge = over.groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("s"))
    edge = edge.select(*names, F.col("s.bucket").alias("edge"), F.col("s.before").alias("before"))
    cut = placed.join(F.broadcast(edge), names, "left")
    inside = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    below = (F.col("left") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    running = F.sum("mix_tokens").over(Window.partitionBy(*names).orderBy("order", "key", F.xxhash64(F.to_json("row"))).rowsBetween(Window.unboundedPreceding, 0))
    fits = cut.where(inside).withColumn("run", running + F.col("before")).where(F.col("run") <= F.col("left")).drop("run")
    last = cut.where(below & ~inside).unionByName(fits).withColumn("mix_epoch", F.col("whole"))
    result = [*[F.col(f"row.`{c}`").alias(c) for c in passed], *made]
    if all(p[-2] == 0 for p in plan):
        return last.select(*result)
    full = cut.where(F.col("whole") > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    return last.unionByName(full).select(*result)
