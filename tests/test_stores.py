"""Stores by date: changes touch the partitions they must, rollups are repaired inside their horizon."""

import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import stores, telemetry
from tracemill.sources import adapter, otlp

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    tr = adapter.traces(spark, DATA).select("trace_id", "agent_id_hash", "ts", "csdma", "event_id")
    path = str(tmp_path / "store")
    otlp.write_traces(tr, path)
    return path


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        found |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def touched(before, after):
    day = lambda name: name.split("dt=")[1][:10]
    return {day(n) for n, at in before.items() if after.get(n) != at} | {day(n) for n in after if n not in before}


def test_erasing_rewrites_only_the_dates_it_must(spark, store):
    before, rows = files(store), stores.read_store(spark, store).collect()
    whole_day = min(str(r.dt) for r in rows)
    gone = [(r.trace_id,) for r in rows if str(r.dt) == whole_day] + [next((r.trace_id,) for r in rows if str(r.dt) > whole_day)]
    counts = stores.erase_stored(spark, store, spark.createDataFrame([*gone, ("stranger",)], "trace_id string"), ["trace_id"])
    assert sum(counts.values()) == len(gone) and touched(before, files(store)) == set(counts) and len(counts) == 2
    left = {r.trace_id for r in stores.read_store(spark, store).collect()}
    assert left == {r.trace_id for r in rows} - {g[0] for g in gone}


def test_updates_and_appends_touch_their_dates(spark, store):
    before, rows = files(store), stores.read_store(spark, store).collect()
    one = rows[0]
    dates = stores.update_stored(spark, store, spark.createDataFrame([(one.trace_id, 0.25), ("stranger", 0.5)], "trace_id string, csdma double"), ["trace_id"])
    assert dates == [str(one.dt)] and touched(before, files(store)) == set(dates)
    now = {r.trace_id: r.csdma for r in stores.read_store(spark, store).collect()}
    assert now == {r.trace_id: r.csdma for r in rows} | {one.trace_id: 0.25}
    schema = "trace_id string, agent_id_hash string, ts timestamp, csdma double, event_id long"
    batch = spark.createDataFrame([(one.trace_id, "a", one.ts, 1.0, 0), ("new", "a", one.ts, 1.0, 0), ("new", "a", one.ts, 2.0, 0)], schema)
    assert stores.append_stored(spark, store, batch, ["trace_id", "ts"]) == 1
    assert stores.append_stored(spark, store, batch, ["trace_id", "ts"]) == 0
    assert stores.read_store(spark, store).count() == len(rows) + 1


def test_appends_read_only_the_dates_of_the_batch(spark, store):
    held = stores._at(stores.read_store(spark, store), ["2024-01-05"])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan or "PartitionFilters: [(cast(dt" in plan or "2024-01-05" in plan.split("PartitionFilters")[1][:120]


def test_retention_empties_old_dates_by_table(spark, store):
    before, days = files(store), sorted({str(r.dt) for r in stores.read_store(spark, store).select("dt").collect()})
    gone = stores.retain(spark, {"logs": store}, "2024-01-31 00:00:00")["logs"]
    assert gone == [d for d in days if d < "2024-01-17"] and touched(before, files(store)) == set(gone)
    assert min(str(r.dt) for r in stores.read_store(spark, store).select("dt").collect()) >= "2024-01-17"
    assert stores.retain(spark, {"traces": store}, "2024-01-31 00:00:00") == {"traces": []}


SPEC = stores.Rollup(keys=("agent", "metric"), values=("value",), distinct=("service",))


def test_daily_states_from_hourly_ones_equal_a_direct_rollup(spark):
    points = adapter.derived(spark, DATA, "points")
    daily = SPEC.finished(SPEC.merged(SPEC.states(points), "1 day"))
    got = {(r.agent, r.metric, r.bucket): (round(r.avg_value, 9), r.min_value, r.max_value, r.n) for r in daily.collect()}
    assert got == {(r.agent, r.metric, r.bucket): (round(r.avg, 9), r.min, r.max, r.n) for r in telemetry.metrics_rollup(points, "1 day").collect()}
    exact = points.groupBy("agent", "metric", F.date_trunc("day", "ts").alias("bucket")).agg(F.countDistinct("service").alias("k"))
    assert {(r.agent, r.metric, r.bucket): r.distinct_service for r in daily.collect()} == {(r.agent, r.metric, r.bucket): r.k for r in exact.collect()}


def test_late_rows_are_repaired_inside_the_horizon_alone(spark, tmp_path):
    points, path = adapter.derived(spark, DATA, "points").cache(), str(tmp_path / "rollup")
    early = points.where("event_id % 5 <> 0")
    SPEC.refresh(path, early, "2024-02-02 00:00:00", 60)
    first = files(path)
    SPEC.refresh(path, points, "2024-01-31 00:00:00", 10)  # the late fifth has come
    stored = SPEC.finished(stores.read_store(spark, path).drop("dt"))
    expected = lambda rows, when: {tuple(r) for r in SPEC.finished(SPEC.states(rows)).where(when).collect()}
    inside, outside = "bucket >= '2024-01-21' and bucket < '2024-01-31'", "bucket < '2024-01-21' or bucket >= '2024-01-31'"
    assert {tuple(r) for r in stored.where(inside).collect()} == expected(points, inside)
    assert {tuple(r) for r in stored.where(outside).collect()} == expected(early, outside)
    assert touched(first, files(path)) <= {f"2024-01-{d}" for d in range(21, 31)}
