"""Stores of dated Parquet (``dt`` partitions) that are changed where they must be, and rollups kept in them.

A change rewrites the date partitions that it touches and no other; their names are
found first and are few.  New rows of a partition are written aside before they
replace it, as they are read from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.filters import apply_updates
from tracemill.operators.windows import moment
from tracemill.sources.otlp import scratch

#: fixed values: days that each kind of table is kept
RETENTION = {"traces": 90, "logs": 14, "service_logs": 90, "metrics": 30, "status_checks": 90, "rollups": 365}


def _dates(df: DataFrame) -> list[str]:
    return sorted(str(r.dt) for r in df.select("dt").distinct().collect())


def _at(df: DataFrame, dates: list[str]) -> DataFrame:
    """Rows of the named partitions; the condition reaches the listing of files."""
    return df.where(F.col("dt").isin([F.lit(d).cast("date") for d in dates]))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("dt", F.col("dt").cast("date"))


def _replace(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` over the partitions that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def _empty(spark: SparkSession, path: str, dates: list[str]) -> None:
    """Leaves nothing but an empty file in the named partitions."""
    none = read_store(spark, path).drop("dt").limit(0)
    for d in dates:
        none.write.mode("overwrite").parquet(f"{path}/dt={d}")


def rewrite(spark: SparkSession, path: str, dates: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """``change`` applied to the rows of the named partitions."""
    if not dates:
        return
    aside = scratch(spark)
    change(_at(read_store(spark, path), dates)).write.partitionBy("dt").parquet(aside)
    done = read_store(spark, aside) if _has_files(spark, aside) else None
    kept = [] if done is None else _dates(done)
    if kept:
        _replace(done, path)
    _empty(spark, path, [d for d in dates if d not in kept])


def _has_files(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path").limit(1).count() > 0


def erase_stored(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str]) -> dict[str, int]:
    """Deletes the rows whose ``keys`` are in ``wanted``; how many of each date are gone."""
    ids = wanted.select(*keys).distinct()
    found = read_store(spark, path).join(ids, keys, "left_semi").groupBy("dt").agg(F.count("*").alias("n")).collect()
    counts = {str(r.dt): r.n for r in found}
    rewrite(spark, path, sorted(counts), lambda rows: rows.join(ids, keys, "left_anti"))
    return counts


def update_stored(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: str | None = None, cleared: str | None = None) -> list[str]:
    """``apply_updates`` on the partitions that hold a key of ``updates``; which these are. Unknown keys are no rows."""
    ids = updates.select(*keys).distinct()
    dates = _dates(read_store(spark, path).join(ids, keys, "left_semi"))

    def change(rows: DataFrame) -> DataFrame:
        own = updates.join(rows.select(*keys).distinct(), keys, "left_semi")
        return apply_updates(rows, own, keys, order, cleared)

    rewrite(spark, path, dates, change)
    return dates


def append_stored(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], ts: str = "ts") -> int:
    """Appends the rows of ``batch`` whose key the store does not have, each once; how many.

    A key holds its row's time, so only the partitions of the batch's own dates are read.
    """
    dated = batch.dropDuplicates(keys).withColumn("dt", F.to_date(ts))
    dates = [d for d in _dates(dated) if d != "None"]
    held = _at(read_store(spark, path), dates).select("dt", *keys)
    same = (dated["dt"] == held["dt"]) & [dated[k].eqNullSafe(held[k]) for k in keys][0]
    for k in keys[1:]:
        same = same & dated[k].eqNullSafe(held[k])
    aside = scratch(spark)
    dated.join(held, same, "left_anti").write.parquet(aside)
    new = spark.read.schema(dated.schema).parquet(aside)
    new.write.mode("append").partitionBy("dt").parquet(path)
    return new.count()


def retain(spark: SparkSession, stores: dict[str, str], as_of: str, policy: dict[str, int] | None = None) -> dict[str, list[str]]:
    """Empties the date partitions that are older than their table's days; which these are.

    ``stores`` has a path for each kind of table of ``policy``.  Whole partitions go, so
    nothing is rewritten and no row is read.
    """
    days = policy or RETENTION
    gone = {}
    for kind, path in stores.items():
        first = F.to_date(moment(as_of)) - F.make_dt_interval(days=F.lit(days[kind]))
        old = _dates(read_store(spark, path).where(F.col("dt") < first.cast("date")))
        _empty(spark, path, old)
        gone[kind] = old
    return gone


@dataclass(frozen=True)
class Rollup:
    """What a rollup keeps of rows by keys and time: counts, sums, extremes and sketches, which all can be merged."""

    keys: tuple[str, ...]
    values: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()
    size: str = "1 hour"

    def states(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        """Partial states of each key and bucket."""
        kept = [F.count("*").alias("n")]
        for v in self.values:
            kept += [F.count(v).alias(f"n_{v}"), F.sum(v).alias(f"sum_{v}"), F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}")]
        kept += [F.count_if(f).alias(f"is_{f}") for f in self.flags]
        kept += [F.hll_sketch_agg(d).alias(f"sketch_{d}") for d in self.distinct]
        return df.groupBy(*self.keys, F.window(ts, self.size)["start"].alias("bucket")).agg(*kept)

    def merged(self, states: DataFrame, size: str) -> DataFrame:
        """States of longer buckets from those of shorter ones."""
        kept = [F.sum("n").alias("n")]
        for v in self.values:
            kept += [F.sum(f"n_{v}").alias(f"n_{v}"), F.sum(f"sum_{v}").alias(f"sum_{v}"), F.min(f"min_{v}").alias(f"min_{v}"), F.max(f"max_{v}").alias(f"max_{v}")]
        kept += [F.sum(f"is_{f}").alias(f"is_{f}") for f in self.flags]
        kept += [F.hll_union_agg(f"sketch_{d}").alias(f"sketch_{d}") for d in self.distinct]
        return states.groupBy(*self.keys, F.window("bucket", size)["start"].alias("longer")).agg(*kept).withColumnRenamed("longer", "bucket")

    def finished(self, states: DataFrame) -> DataFrame:
        """Means, extremes, shares of flags and estimated distinct counts of states."""
        shown: list[Column] = [F.col("n")]
        for v in self.values:
            shown += [(F.col(f"sum_{v}") / F.nullif(f"n_{v}", F.lit(0))).alias(f"avg_{v}"), F.col(f"sum_{v}"), F.col(f"min_{v}"), F.col(f"max_{v}")]
        shown += [(F.col(f"is_{f}") / F.col("n")).alias(f"{f}_rate") for f in self.flags]
        shown += [F.hll_sketch_estimate(f"sketch_{d}").alias(f"distinct_{d}") for d in self.distinct]
        return states.select(*self.keys, "bucket", *shown)

    def refresh(self, path: str, rows: DataFrame, as_of: str, horizon_days: float, lag_hours: float = 0, ts: str = "ts") -> None:
        """Computes the stored states of the horizon again from ``rows`` and writes them over their dates.

        The horizon runs from the start of the day ``horizon_days`` before ``as_of`` to the
        last whole bucket ``lag_hours`` before it.  Rows that came late inside it are
        repaired; older buckets stay as they were.  Both bounds reach the scan of ``rows``.
        """
        back = lambda seconds: moment(as_of) - F.make_dt_interval(secs=F.lit(int(seconds)))
        ends = rows.sparkSession.range(1).select(F.date_trunc("day", back(horizon_days * 86400)).alias("start"), back(lag_hours * 3600).alias("t"))
        start, end = ends.select("start", F.window("t", self.size)["start"].alias("end")).first()
        fresh = self.states(rows.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))), ts)
        _replace(fresh.withColumn("dt", F.to_date("bucket")), path)
