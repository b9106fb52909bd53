"""Document fingerprints by winnowing, in built-in functions only.

Tokens are words, or single characters of scripts that write without spaces.  The
rolling hash of a K-gram of tokens is ``sum h[i] * BASE**(K - 1 - i) mod PRIME``; two
halves of a gram are joined at a time, so K costs log2(K) passes.  A window is WINDOW
consecutive grams; the smallest hash of each window is kept, of equal ones the
rightmost, with its position.  Hash and position share one number whose order is
that choice, so minima of windows also take log2(WINDOW) passes.

Guarantee: two texts with a common run of K + WINDOW - 1 tokens share a fingerprint
there; common runs under K tokens are never seen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, WINDOW = 4, 4
PRIME, BASE = 2147483647, 1000003
#: fixed value: blocks of scripts written without spaces between words
DENSE = r"฀-໿က-႟ក-៿⺀-鿿ꥠ-꥿豈-﫿"
TOKEN = rf"[{DENSE}]|[^\x20\x09-\x0D{DENSE}]+"
#: keys that one sort of neighbours holds at most
SPAN = 4096


def _joined(df: DataFrame, name: str, distance: int, rule: str) -> DataFrame:
    """Array ``name`` with each entry joined with the one ``distance`` later; entries without one go."""
    size = f"greatest(size({name}) - {distance}, 0)"
    return df.withColumn(name, F.expr(f"zip_with(slice({name}, 1, {size}), slice({name}, {distance + 1}, {size}), (a, b) -> {rule})"))


def winnow(df: DataFrame, text: str, out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of a text column: array<struct<position int, hash long>>.

    Positions count tokens and ascend.  A text of fewer than K tokens is one gram; one
    of fewer grams than a window is one window; a text without tokens, or null, has
    an empty fingerprint.  Equal texts have equal fingerprints; an empty table gives
    an empty result.  A column named ``out`` is replaced, others pass through.
    """
    grams = f"__{out}"
    while any(c.startswith(grams) for c in df.columns):
        grams += "_"
    tokens = f"{grams}_tokens"
    df = df.withColumn(tokens, F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(grams, F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(PRIME)))
    reach = 1
    while reach < K:
        power = pow(BASE, reach, PRIME)
        df = _joined(df, grams, reach, f"(a * {power} + b) % {PRIME}")
        reach *= 2
    whole = F.when(F.size(tokens) > 0, F.array(F.xxhash64(F.col(tokens)).bitwiseAND(PRIME))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(grams, F.when(F.size(grams) > 0, F.col(grams)).otherwise(whole)).drop(tokens)
    df = df.withColumn(grams, F.expr(f"transform({grams}, (h, i) -> shiftleft(h, 32) + ({PRIME} - i))"))
    least = f"{grams}_least"
    df = df.withColumn(least, F.array_min(grams))
    reach = 1
    while reach < WINDOW:
        df = _joined(df, grams, reach, "least(a, b)")
        reach *= 2
    chosen = F.when(F.size(grams) > 0, F.array_distinct(grams)).when(F.col(least).isNotNull(), F.array(least)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(grams, chosen).drop(least)
    entry = f"named_struct('position', cast({PRIME} - (k & {PRIME}) as int), 'hash', shiftright(k, 32))"
    return df.withColumn(out, F.expr(f"transform({grams}, k -> {entry})")).drop(grams)


def hashes(fingerprint: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.col(f"{fingerprint}.hash"))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of distinct hashes; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(1.0))


def _next(groups: DataFrame, width: int) -> DataFrame:
    """(g, following) of distinct numbers ``g``; no sort holds more than SPAN of them."""
    if width <= SPAN:
        return groups.select("g", F.lead("g").over(Window.orderBy("g")).alias("following"))
    upper = groups.withColumn("up", F.floor(F.col("g") / SPAN))
    inside = upper.withColumn("inner", F.lead("g").over(Window.partitionBy("up").orderBy("g")))
    firsts = upper.groupBy("up").agg(F.min("g").alias("first"))
    after = _next(firsts.select(F.col("up").alias("g")), -(-width // SPAN) + 1)
    jump = after.join(firsts.withColumnRenamed("up", "following"), "following").select(F.col("g").alias("up"), "first")
    return inside.join(jump, "up", "left").select("g", F.coalesce("inner", "first").alias("following"))


def with_next(docs: DataFrame, key: str, text: str, out: str, carried: Sequence[str] | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with ``out``, a struct of the ``carried`` columns (the text if not said) of the row that follows by key; the first follows the last.

    ``prepare`` adds columns to a table of key and text once rows lie beside their
    neighbours, so what it makes is carried without another shuffle.  Rows are dealt by
    ranges of SPAN keys, so one shuffle brings neighbours together whatever the keys are.

    Defined cases: a null key comes first; rows of equal key stand in the order of their
    texts; a single row follows itself; an empty table gives an empty result.  A column
    named ``out`` is replaced, others pass through, whatever their names.
    """
    names = [c for c in docs.columns if c not in (out, key, text)]
    group = F.coalesce(F.floor(F.col(f"`{key}`") / SPAN), F.lit(-(1 << 52)))
    what = F.struct(*[F.col(f"`{c}`") for c in (carried or [text])])
    packed = docs.select(group.alias("g"), F.col(f"`{key}`"), F.col(f"`{text}`"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in names]).alias("others"))
    low, high = packed.agg(F.min("g"), F.max("g")).first()
    rows = prepare(packed.repartition("g"))
    made = [c for c in rows.columns if c not in ("g", key, text, "others", out)]
    order = Window.partitionBy("g").orderBy(F.asc_nulls_first(f"`{key}`"), F.asc_nulls_first(f"`{text}`"))
    rows = rows.withColumn("inner", F.lead(what).over(order))
    heads = packed.groupBy("g").agg(F.min(F.struct(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))).alias("r"))
    heads = heads.select("g", F.col("r.k").alias(key), F.col("r.t").alias(text))
    following = _next(packed.select("g").distinct(), (high or 0) - (low or 0) + 1).select(F.col("g").alias("before"), F.coalesce("following", F.lit(low)).alias("g"))
    first_after = following.join(prepare(heads), "g").select(F.col("before").alias("g"), what.alias("head"))
    joined = rows.join(first_after, "g", "left").withColumn("found", F.coalesce("inner", "head"))
    passed = [F.col(f"`{c}`") if c in (key, text) else F.col(f"others.`{c}`").alias(c) for c in docs.columns if c != out]
    return joined.select(*passed, *[F.col(f"`{c}`") for c in made if c not in docs.columns], F.col("found").alias(out))
