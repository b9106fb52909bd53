"""Streams against the batch operators: state, late and repeated rows, restarts."""

import json
import random

from pyspark.sql import functions as F

from tracemill.operators import detectors as D
from tracemill.operators import ingest, telemetry
from tracemill.sources import adapter
from tracemill.streaming import jobs

DATA = "/root/testdata/sf0.001"


def stream(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def run(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_rollup_equals_batch(spark, tmp_path):
    points = adapter.derived(spark, "/root/testdata/sf0.001", "points")
    hourly = lambda df: telemetry.metrics_rollup(df, "1 hour")
    got = run(spark, jobs.stream_rollup(stream(spark, points, tmp_path / "in"), hourly, "1 hour"), "hourly", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hourly(points).collect()))


def test_stream_dedup(spark, tmp_path):
    tr = adapter.traces(spark, DATA).select("agent_id_hash", "trace_id", "audit_sequence_number", "ts")
    twice = stream(spark, tr.union(tr), tmp_path / "twice")
    assert run(spark, jobs.stream_dedup(twice, ["trace_id"], "1 day"), "once").count() == tr.count()


def test_shuffled_arrivals_make_no_false_gaps(spark, tmp_path):
    tr = adapter.traces(spark, DATA).select("agent_id_hash", "trace_id", "audit_sequence_number", "ts").orderBy("ts").limit(400).cache()
    held = [r.asDict() for r in tr.collect()]
    random.Random(3).shuffle(held)
    late = max(r["ts"] for r in held).replace(year=2030)
    for k in range(4):  # four batches in no order, then one that lets the watermark pass all
        spark.createDataFrame(held[k::4], tr.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([("flush", "z", 1, late), ("flush", "z", 2, late)], tr.schema)
    source = spark.readStream.schema(tr.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gaps = jobs.stream_chain_gaps(source, watermark="60 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    gaps.trigger(availableNow=True).start().awaitTermination()
    flush.write.mode("append").parquet(str(tmp_path / "in"))
    gaps.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("agent_id_hash string, trace_id string, prev_seq long, seq long, gap long").parquet(str(tmp_path / "out"))
    names = ("agent_id_hash", "trace_id", "prev_seq", "seq", "gap")
    assert rows_of(got.select(*names)) == rows_of(D.hash_chain_gaps(tr).select(*names)) != []


BODY = '{"csdma": {"plausibility_score": 0.5}, "action_rationale": "in 1999 I wrote to some.one@example.org", "models_used": ["real"]}'


def _six(trace, at, body=BODY, level="detailed", n=6):
    return [(trace, i, e, body, f"2024-01-0{at} 00:0{i}:00", level, n, "b1") for i, e in enumerate(ingest.SIX)]


COMPONENTS = "trace_id string, i int, event_type string, data string, ts timestamp, trace_level string, n_components int, batch_id string"


def _components(spark, rows):
    df = spark.createDataFrame([(*r[:4], r[4], *r[5:]) for r in rows], COMPONENTS.replace("timestamp", "string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _sink(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}")


def test_traces_cut_over_batches_equal_batch_ingest(spark, tmp_path):
    cut, odd = _six("cut", 1), [("odd", 0, "WHAT", "{}", "2024-01-01 00:00:00", "generic", 1, "b1")]
    up = [("up", 0, "startup", "{}", "2024-01-01 00:00:00", "generic", 1, "b2")]
    mock = _six("mock", 1, BODY.replace("real", "a mock"))
    lost = _six("lost", 1)[:3]  # three of six never come
    batches = [cut[:2] + odd + lost[:1], cut[2:4] + mock + lost[1:], cut[4:] + up + cut[:1]]
    folder, source = str(tmp_path / "out"), tmp_path / "in"

    def go():
        stream_ = spark.readStream.schema(_components(spark, cut).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        jobs.stream_ingest(stream_, folder, str(tmp_path / "state"), wait="10 minutes").awaitTermination()

    for rows in batches:
        _components(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        go()
    # a later day lets the watermark pass what never came whole, and what ended is sent once more within the wait
    _components(spark, _six("next", 2)).coalesce(1).write.mode("append").parquet(str(source))
    go()
    _components(spark, _six("after", 3)).coalesce(1).write.mode("append").parquet(str(source))
    go()
    whole = [*cut, *odd, *up, *mock, *lost, *_six("next", 2), *_six("after", 3)]
    expected = ingest.ingest(_components(spark, whole).drop("n_components"))
    for name in ("production", "mock", "connectivity", "malformed", "results"):
        got = _sink(spark, folder, name).drop("batch")
        assert rows_of(got.select(*expected[name].columns)) == rows_of(expected[name]), name
    for name in ("production", "mock", "malformed"):
        text = json.dumps([r.asDict() for r in _sink(spark, folder, name).collect()], default=str)
        assert "1999" not in text and "@" not in text
    assert {r.trace_id for r in _sink(spark, folder, "production").collect()} == {"cut", "next", "after"}
    before = rows_of(_sink(spark, folder, "results"))
    go()  # a restart without new files writes nothing twice
    assert rows_of(_sink(spark, folder, "results")) == before
    counts = _sink(spark, folder, "accounting").groupBy("batch_id").agg(F.sum("received").alias("n")).collect()
    assert {r.batch_id: r.n for r in counts} == {"b1": 6, "b2": 1}


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    folder = str(tmp_path / "out")
    for state in ("one", "two"):  # the same first batch twice: what a lost commit brings about
        source = stream(spark, _components(spark, _six("t", 1)), tmp_path / "in")
        jobs.stream_ingest(source, folder, str(tmp_path / state)).awaitTermination()
    assert _sink(spark, folder, "production").count() == 1


def test_latest_status_emits_changes(spark, tmp_path):
    checks = adapter.derived(spark, DATA, "checks").select("region", "service", "provider", "status", "latency_ms", "ts", "event_id").cache()
    for k in range(3):
        checks.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = run(spark, jobs.stream_latest(source), "changes", "update")
    expected = telemetry.latest_status(checks)
    assert rows_of(telemetry.latest_status(changes).select(*expected.columns)) == rows_of(expected)
    assert changes.count() < checks.count()  # only what is newer than what was known
    assert changes.groupBy("region", "service", "provider").agg(F.count("*").alias("n"), F.countDistinct("ts", "event_id").alias("k")).where("n <> k").count() == 0


def test_error_alerts(spark, tmp_path):
    logs = adapter.derived(spark, DATA, "logs")
    assert run(spark, jobs.stream_error_alerts(stream(spark, logs, tmp_path / "logs")), "alerts", "complete").count() == telemetry.alert_rules(logs).count()
