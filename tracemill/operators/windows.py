"""Trailing time windows against an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def trailing(df: DataFrame, as_of: str, days: float = 0, hours: float = 0, ts: str = "ts") -> DataFrame:
    """Rows from ``days`` and ``hours`` before ``as_of`` up to it; literals, so they reach the scan."""
    seconds = int(days * 86400 + hours * 3600)
    start = moment(as_of) - F.make_dt_interval(secs=F.lit(seconds))
    return df.where((F.col(ts) >= start) & (F.col(ts) <= moment(as_of)))


def evidence(rows: DataFrame, keys: list[str], order: str = "ts", what: str = "trace_id", n: int = 5, newest: bool = True) -> DataFrame:
    """For each group the ``n`` values of ``what`` that come first by ``order``.

    The rank limit is applied before the shuffle, so a group of any size sends a
    few rows from each task.
    """
    by = [F.desc(c) if newest else F.asc(c) for c in (order, what)]
    top = rows.select(*keys, what, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).alias("rn")).where(F.col("rn") <= n)
    ranked = F.sort_array(F.collect_list(F.struct("rn", what)))
    return top.groupBy(*keys).agg(F.transform(ranked, lambda s: s[what]).alias("evidence"))


def in_order(rows: DataFrame, keys: list[str], wanted: DataFrame, columns: list[str], order: tuple[str, ...] = ("ts", "trace_id")) -> DataFrame:
    """For each of the few groups ``wanted``, the values of ``columns`` as arrays in the order of its rows, without nulls.

    The last bits of a sum follow the order in which it is taken, so a group that stands on a limit is
    summed in one order.  Rows of other groups are left out by 65,536 buckets of the keys before the shuffle.
    """
    bucket = F.pmod(F.hash(*keys), F.lit(1 << 16)).alias("__bucket")
    few = F.broadcast(wanted.select(bucket).distinct())
    picked = rows.select(*keys, *order, *columns, bucket).join(few, "__bucket", "left_semi").join(wanted.select(*keys), keys, "left_semi")
    listed = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("__rows"))
    return listed.select(*keys, *[F.array_compact(F.col("__rows")[c]).alias(c) for c in columns])


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles, summed from its first."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def deviation_of(values: Column) -> Column:
    """Sample deviation of an array of doubles by Welford's steps from its first; null for less than two."""
    state = lambda n, mean, squares: F.struct(n.alias("n"), mean.alias("mean"), squares.alias("squares"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return state(s["n"] + 1, mean, s["squares"] + (x - mean) * (x - s["mean"]))

    return F.aggregate(values, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda s: F.when(s["n"] > 1, F.sqrt(s["squares"] / (s["n"] - 1))))


def _lag_of_slices(lasts: DataFrame, level: int) -> DataFrame:
    """(key, slice, carried): what the slice before ended with; slices are few, or are cut into slices themselves."""
    if not level:
        order = Window.partitionBy("__key").orderBy("__slice")
        return lasts.select("__key", "__slice", F.lag("__last").over(order).alias("__carried"))
    done = _lagged(lasts.withColumnRenamed("__slice", "__at"), [], ["__last"], 16, level - 1)
    return done.select("__key", F.col("__at").alias("__slice"), F.col("__before.__last").alias("__carried"))


def _lagged(df: DataFrame, order: list[str], columns: list[str], bits: int, levels: int) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    cut = df.withColumn("__slice", F.shiftright("__at", bits))
    inside = Window.partitionBy("__key", "__slice").orderBy("__at", *order)
    lasts = cut.groupBy("__key", "__slice").agg(F.max_by(row, F.struct("__at", *order)).alias("__last"))
    marked = cut.withColumn("__before", F.lag(row).over(inside))
    carried = _lag_of_slices(lasts, levels)
    both = marked.join(carried, ["__key", "__slice"], "left")
    return both.withColumn("__before", F.coalesce("__before", "__carried")).drop("__slice", "__carried")


def lagged(df: DataFrame, by: str, at: Column, order: list[str], columns: list[str], bits: int = 16, levels: int = 2) -> DataFrame:
    """``df`` with a struct ``before``: ``columns`` of the row before, among the rows of ``by`` in the order of (``at``, ``order``).

    What ``lag`` over a window gives (null in a group's first row), for groups of any size.
    ``at`` is a whole number and no null.  Rows are sorted in slices of 2**bits of it; a
    slice hands its last row to the next.  The last rows of a group's slices are put in
    order the same way, ``levels`` times, so neither many rows in a row nor numbers far
    apart bring a group into one task.  Rows of ``by`` = null are a group.
    """
    key = F.when(F.col(by).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(by).cast("string")))
    made = df.withColumn("__key", key).withColumn("__at", at.cast("long"))
    return _lagged(made, order, columns, bits, levels).withColumnRenamed("__before", "before").drop("__key", "__at")
