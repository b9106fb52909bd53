"""Thresholds, nulls, sources, streams and privacy rules on small rows."""

import hashlib
import json
import tempfile
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import privacy as P
from tracemill.operators import corpus as C
from tracemill.operators import detectors as D
from tracemill.operators import filters as L
from tracemill.operators import governance as G
from tracemill.operators import ingest, telemetry
from tracemill.operators import views as V
from tracemill.sources import adapter, otlp
from tracemill.streaming import jobs

AS_OF = adapter.AS_OF
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def registry_query(spark):
    from tracemill.plans import registry

    return lambda name: registry.queries()[name](spark, DATA)


def test_chain_gap_is_any_step_but_one(spark):
    rows = [("a", f"t{i}", s) for i, s in enumerate([1, 2, 4, 5, 5])]
    tr = spark.createDataFrame(rows, "agent_id_hash string, trace_id string, audit_sequence_number long")
    assert sorted(r.gap for r in D.hash_chain_gaps(tr).collect()) == [0, 2]


def test_override_threshold_is_strict(spark):
    rows = [(f"a{k}", "d", "2024-01-30 00:00:00", f"t{k}-{i}", i < k) for k in (2, 0, 1) for i in range(20)]
    tr = spark.createDataFrame(rows, "agent_id_hash string, dsdma_domain string, ts string, trace_id string, action_was_overridden boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert D.override_rate_anomalies(tr, AS_OF).count() == 0  # 0.1 is twice the mean of 0.05, not more


def test_z_scores_of_one_value_and_of_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    assert sorted((r.g, r.z) for r in D.z_scores(df, "x", "g").collect() if r.z is not None) == [("b", 0.0), ("b", 0.0)]


def test_detectors_on_no_rows(spark):
    tr = adapter.traces(spark, "/root/testdata/sf0.001").limit(0)
    assert D.run_all_detections(tr, AS_OF).count() == 0
    assert C.n_eff(V.trace_context(tr, adapter.derived(spark, DATA, "batches"))).count() == 0


def test_n_eff_of_independent_and_of_equal_features(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    rows = [("d", float(a), float(b), float(a)) for a, b in x]
    df = spark.createDataFrame(rows, "deployment_domain string, csdma double, dsdma double, coherence double")
    (two,) = C.n_eff(df, features=("csdma", "dsdma", "coherence")).collect()
    assert two.features == 3 and abs(two.participation - 9 / 5) < 0.05


def n_eff_of(rows):
    """The definition on a table of numbers: gaps get the mean, equal columns go, correlation, its spectrum."""
    x = np.array(rows, float)
    x = np.where(np.isnan(x), np.nanmean(np.where(np.isnan(x).all(0), 0, x), 0), x)
    keep = x.std(0, ddof=1) > 1e-9
    z = (x[:, keep] - x[:, keep].mean(0)) / x[:, keep].std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z, rowvar=False))
    p = np.clip(values, 0, None) / np.clip(values, 0, None).sum()
    return 1 / (p**2).sum(), np.exp(-(p * np.log(p + 1e-30)).sum()), keep.sum(), np.sort(np.abs(vectors[:, -1]))[::-1]


def test_n_eff_queries_by_numpy(spark, registry_query):
    tc = V.trace_context(adapter.traces(spark, DATA), adapter.derived(spark, DATA, "batches"))
    names = list(C.FEATURES)
    rows = sorted((r.ts, r.trace_id, r.task_class, [getattr(r, c) for c in names]) for r in C.constraint_vector(tc, ("ts", "trace_id", "task_class")).collect())
    full = lambda some: [[np.nan if v is None else v for v in x[3]] for x in some if x[3][names.index("csdma")] is not None and x[3][names.index("k_eff")] is not None]

    def check(got, some):
        ratio, entropy, used, loadings = n_eff_of(full(some))
        assert (got.n, got.features) == (len(full(some)), used) and got.participation == pytest.approx(ratio, abs=2e-6) and got.entropy_size == pytest.approx(entropy, abs=2e-6)
        assert [abs(float(x.split("=")[1])) for x in got.loadings.split(",")] == pytest.approx(loadings[:8].tolist(), abs=2e-4)

    (one,) = registry_query("n_eff").collect()
    check(one, rows[-2000:])
    by = {r.task_class: r for r in registry_query("n_eff_by_domain").collect()}
    for kind in {x[2] for x in rows}:
        check(by[kind], [x for x in rows if x[2] == kind][-500:])
    windows = {int(r.w): r for r in registry_query("rolling_n_eff").collect()}
    assert set(windows) == set(range((len(rows) - 500) // 100 + 1))
    for w, got in windows.items():
        check(got, rows[100 * w : 100 * w + 500])


def test_n_eff_reads_its_rows_once(spark):
    rows = [("g", 0.1 * i, 1.0 * (i % 3), None if i % 4 == 0 else 0.3 * i) for i in range(12)] + [(None, 0.1 * i, 0.5, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, csdma double, dsdma double, coherence double")
    df.write.mode("overwrite").parquet(folder := tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    done = C.n_eff(spark.read.parquet(folder), by="g", features=("csdma", "dsdma", "coherence"))
    assert done._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert {r.g: (r.n, r.features) for r in done.collect()} == {"g": (12, 3), None: (3, 1)}


def test_frechet_distance():
    import numpy as np

    a = np.array([[0.0, 0, 0], [1, 0, 0]])
    assert C.frechet(a, a + [0, 1, 0]) == pytest.approx(1.0)
    assert C.frechet(a, a) == 0


SCRUBBED = [
    ("minutes_1871_b went out", "[IDENTIFIER] went out"), ("from 1834 until 2024", "from [YEAR] until 2024"), ("1912年の本", "[IDENTIFIER]"), ("write x.y-z@host.example today", "write [EMAIL] today"),
    ("ring +1 212 555 0188 or (212) 555-0188", "ring [PHONE] or [PHONE]"), ("plain 2125550188 stays", "plain 2125550188 stays"), ("from 192.0.2.7 to http://h.example/p?q", "from [IP_ADDRESS] to [URL]"), ("no. 987-65-4321", "no. [SSN]"), ("5555 4444 3333 2222", "[CREDIT_CARD]"), ("20250101123000", "20250101123000"),
]


def test_scrub_rules_and_idempotence(spark):
    df = spark.createDataFrame(SCRUBBED, "text string, expected string")
    rows = df.select("expected", P.scrub_text(F.col("text")).alias("once")).withColumn("twice", P.scrub_text(F.col("once"))).collect()
    assert [(r.once, r.twice) for r in rows] == [(r.expected, r.expected) for r in rows]


def test_residue_gate_splits_all_rows(spark):
    df = spark.createDataFrame([("x 1999",), ("clean",), (None,), ("Secret Place",)], "text string")
    clean, rejected = P.residue_gate(df, "text", ["secret"])
    assert clean.count() == 2 and rejected.count() == 2


def test_sanitize_escapes_only_what_it_changed(spark):
    df = spark.createDataFrame([("a < b",), ("<script>x</script> & more",), ("../etc",)], "t string")
    out = [r.v for r in df.select(P.sanitize_text(F.col("t"))["value"].alias("v")).collect()]
    assert out == ["a < b", "[XSS_REMOVED:xss_script] &amp; more", "[PATH_REMOVED]etc"]


ODD = ["a < b", "<script>x</script> & more", "../etc", "x" * 100_001, "1; DROP TABLE t -- $(id) `ls`", "", None, "<svg a onload=go> %00", "' OR 1=1"]


def test_columns_and_python_sanitise_alike(spark):
    """The column expressions and the walk over JSON are two ways to one result."""
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for identifier in (False, True):
        for r in df.select("t", P.sanitize_text(F.col("t"), identifier).alias("s")).collect():
            if r.t is not None:
                assert (r.s.value, r.s.detections, r.s.was_modified, r.s.was_truncated) == P.sanitize_python(r.t, identifier)


def test_columns_and_python_scrub_alike(spark, registry_query):
    texts = [t for t, _ in SCRUBBED] + ["a 1999_x ünï1999 on 127.0.0.1:80", "é1999 2023-01-01", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(P.scrub_text(F.col("t")).alias("s")).collect()] == [P.scrub_python(t) for t in texts]
    from tracemill.plans import records

    docs = records._marked(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    done = {r.doc_id: P.scrub_python(r.text) for r in docs}
    assert {r.doc_id: r.scrubbed for r in registry_query("scrub_text").collect()} == {k: sha(t) for k, t in done.items()}
    level = {r.doc_id: ("generic", "detailed", "full_traces")[r.doc_id % 3] for r in docs}
    expected = {r.doc_id: (sha(done[r.doc_id]) if level[r.doc_id] == "detailed" else sha(r.text) if level[r.doc_id] == "generic" else None, level[r.doc_id] == "full_traces") for r in docs}
    assert {r.doc_id: (r.scrubbed, r.rejected) for r in registry_query("scrub_by_level").collect()} == expected
    counts = {r.doc_id: r for r in registry_query("redaction_counts").collect()}
    for r in docs:
        text, seen = r.text, {}
        for name, pattern, replacement in P._rules("scrub"):
            text, seen[name] = pattern.subn(replacement, text)
        assert {n: counts[r.doc_id][f"n_{n}"] for n in seen} == seen
    (report,) = registry_query("rescrub_report").collect()
    left = lambda t: bool(P._rules("scrub")[1][1].search(t)) or "password=1" in t.lower()
    assert (report.n, report.changed, report.rejected) == (len(docs), sum(done[r.doc_id] != r.text for r in docs), sum(map(left, done.values())))
    assert (report.kept, report.residue_before, report.residue_after) == (report.n - report.rejected, sum(left(r.text) for r in docs), report.rejected)


def test_json_is_parsed_before_it_is_scrubbed(spark):
    text = json.dumps({"csdma": {"s": 0.5, "reasoning": "born 1955"}, "y": 1999, "trace_id": "x_1999", "flags": ["in 1888", {"task_id": "t_1888", "k": 3}], "free": "in 1777"})
    (r,) = spark.createDataFrame([(text,)], "t string").select(P.scrub_json(F.col("t")).alias("listed"), P.scrub_json(F.col("t"), None).alias("all")).collect()
    assert json.loads(r.listed) == {"csdma": {"s": 0.5, "reasoning": "born [YEAR]"}, "y": 1999, "trace_id": "x_1999", "flags": ["in [YEAR]", {"task_id": "t_1888", "k": 3}], "free": "in 1777"}
    assert json.loads(r.all) == json.loads(r.listed) | {"free": "in [YEAR]"}


def test_nested_sanitising_has_bounds(spark):
    deep = []
    for _ in range(25):
        deep = [deep]
    text = json.dumps({"k" * 300: {"reasoning": "../a"}, "l": [1] * 1500, "d": deep, "trace_id": "y" * 300, "other": "../b"})
    (r,) = spark.createDataFrame([(text,)], "t string").select(P.sanitize_json(F.col("t")).alias("s")).collect()
    value = json.loads(r.s.value)
    assert value["k" * 256] == {"reasoning": "[PATH_REMOVED]a"} and len(value["l"]) == 1000 and value["trace_id"] == "y" * 256 + "[TRUNCATED]" and value["other"] == "../b"
    assert set(r.s.detections) == {"key_truncated", "path_traversal", "array_truncated", "depth_limit_exceeded", "size_limit_exceeded"} and (r.s.modified, r.s.truncated) == (3, 1)


def test_long_json_texts_reach_python_in_small_batches(spark):
    """Arrow batches hold 10,000 rows however long; pickled ones a hundred."""
    df = spark.createDataFrame([('{"reasoning": "in 1888 ../a"}',), ("no json of 1888",), (None,)], "t string")
    done = df.select(P.scrub_json(F.col("t")).alias("scrubbed"), P.sanitize_json(F.col("t")).alias("s"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = [(r.scrubbed, r.s.value, r.s.detections, r.s.modified, r.s.truncated) for r in done.collect()]
    assert rows[0] == ('{"reasoning":"in [YEAR] ../a"}', '{"reasoning":"in 1888 [PATH_REMOVED]a"}', ["path_traversal"], 1, 0)
    assert rows[1:] == [("no json of 1888", "no json of 1888", [], 0, 0), (None, None, [], 0, 0)]


def test_few_batches_go_to_the_traces(spark):
    """Whatever Spark guesses of their size; many batches are joined by a shuffle, to the same rows."""
    from tracemill.operators import views

    tr = spark.createDataFrame([("t1", "b1"), ("t2", "b2"), ("t3", None), ("t4", "b9")], "trace_id string, batch_id string")
    batches = spark.createDataFrame([("b1", '{"agent_role": "x", "user_latitude": "1.5"}'), ("b2", "{}")], "batch_id string, correlation_metadata string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = views.batch_context(tr, batches), views.batch_context(tr, batches, most=1)
        assert ["BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString() for x in (few, many)] == [True, False]
        assert few.orderBy("trace_id").collect() == many.orderBy("trace_id").collect() and {r.trace_id: r.agent_role for r in few.collect()} == {"t1": "x", "t2": None, "t3": None, "t4": None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_typed_columns_are_sanitised(spark):
    df = spark.createDataFrame([((("../a", 1), ["b", "%00"]), ["x"] * 1200)], "s struct<t: struct<v: string, n: int>, l: array<string>>, a array<string>")
    (row,) = P.sanitize_nested(df, ["s", "a"]).collect()
    assert (row.s.t.v, row.s.t.n, row.s.l) == ("[PATH_REMOVED]a", 1, ["b", "[NULL_BYTE_REMOVED]"]) and len(row.a) == 1000


def test_identifiers_lose_what_is_dangerous(spark):
    df = spark.createDataFrame([("z" * 300,), ("a../b",), (None,), ("fine",)], "t string")
    out = [(r.v.value, r.v.issues) for r in df.select(P.validate_identifier(F.col("t"), "id").alias("v")).collect()]
    assert out == [("z" * 256, ["id_truncated"]), ("ab", ["path_traversal"]), (None, []), ("fine", [])]


def test_manifest_counts_repeated_rows(spark):
    one, two = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "a"), (1, "a")], "k long, v string")
    rows = {r.name: r for r in L.manifest({"one": one, "two": two, "none": one.limit(0), "turned": two.repartition(3)}).collect()}
    assert int(rows["two"].checksum) == 2 * int(rows["one"].checksum) != 0 and rows["none"].checksum == "0" and rows["turned"].checksum == rows["two"].checksum


def test_updates_of_one_key(spark):
    store = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    updates = spark.createDataFrame([(1, "c", None, 1, None), (1, None, "z", 2, None), (2, None, None, 3, ["v"]), (3, "n", None, 1, None)], "k long, v string, w string, at int, clear array<string>")
    assert sorted(map(tuple, L.apply_updates(store, updates, ["k"], "at", "clear").collect())) == [(1, "c", "z"), (2, None, "y"), (3, "n", None)]


def test_a_broken_ledger(spark):
    entry = ["n"]
    seal = lambda prev, n: hashlib.sha256(f"{prev}|{n}".encode()).hexdigest()
    a = seal("genesis", 1)
    b = seal(a, 2)
    c = seal(b, 3)
    rows = [("l", 1, "genesis", a), ("l", 20, a, b), ("l", 30, b, seal(b, 30)), ("m", 1, "genesis", a), ("m", 2, "wrong", b), ("m", 3, b, c)]
    done = L.ledger_chain(spark.createDataFrame(rows, "who string, n long, prev string, own string"), "who", ["n"], entry, ("prev", "own"))
    assert [(r.who, r.n, r.is_intact) for r in done.orderBy("who", "n").collect()] == [("l", 1, True), ("l", 20, False), ("l", 30, True), ("m", 1, True), ("m", 2, False), ("m", 3, True)]


COLOURS = [
    ("REJECT", False, True, True, "red"), ("SPEAK", True, True, True, "red"), ("PONDER", None, True, None, "green"), ("TASK_COMPLETE", False, None, False, "yellow"),
    ("FORGET", None, False, True, "yellow"), ("FORGET", None, None, None, "red"), (None, None, None, None, "red"), ("DEFER", None, None, False, "yellow"),
]


def test_outcome_colours(spark):
    df = spark.createDataFrame(COLOURS, "selected_action string, action_was_overridden boolean, has_positive_moment boolean, action_success boolean, expected string")
    assert [r.o for r in df.select(V.outcome().alias("o")).collect()] == [c[-1] for c in COLOURS]
    one = lambda *rows: V.task_outcome(spark.createDataFrame([("t", *r) for r in rows], "task_id string, selected_action string, action_was_overridden boolean, has_positive_moment boolean, action_success boolean")).first().outcome
    assert one(("TASK_COMPLETE", None, True, None), ("REJECT", True, None, None)) == "green" and one(("TASK_COMPLETE", None, False, None)) == "yellow"
    assert one(("REJECT", None, None, True)) == "red" and one(("SPEAK", True, None, True)) == "red" and one(("SPEAK", None, True, True)) == "yellow" and one(("SPEAK", None, None, None)) == "red"


def test_initial_observations(spark):
    rows = [("x said: hello there\nmore", "why", "hello there"), ("first line\nsecond", "why", "first line"), ("y" * 600, "why", "y" * 500), ("said:\nrest", "why", "said:"), ("", "why", "why"), (None, "why", "why"), (None, "", None)]
    df = spark.createDataFrame(rows, "t string, r string, expected string")
    assert [r.o for r in df.select(L.initial_observation(F.col("t"), F.col("r")).alias("o")).collect()] == [x[-1] for x in rows]


def test_task_classes(spark):
    rows = [
        ("model_eval_en_1", "wakeup", None, "qa_eval"), ("api_google_1", None, None, "real_user_web"), ("api_other", None, None, "other"), ("discord", None, None, "discord"), ("websocket:1", None, None, "real_user_ws"), ("https://x", None, None, "real_user_http"),
        (None, "wakeup", None, "wakeup_ritual"), ("c", "work", "EXPRESS_GRATITUDE_1", "wakeup_ritual"), (None, "work", "task", "unknown"), ("c", None, "x_VERIFY_IDENTITY", "other"),
    ]
    df = spark.createDataFrame(rows, "c string, s string, t string, expected string")
    assert [r.k for r in df.select(V.task_class(F.col("c"), F.col("s"), F.col("t")).alias("k")).collect()] == [x[-1] for x in rows]


def test_a_key_at_any_depth_but_not_in_text(spark):
    texts = ['{"a": {"b": [{"channel_id": "x"}]}}', '{"a": {"channel_id": "deep"}, "channel_id": "top"}', json.dumps({"note": '{"channel_id": "no"}', "n": {"channel_id": 7}}), '{"channel_id": null}', json.dumps({"z": {"channel_id": 'q"uote'}}), None, "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(V.anywhere(F.col("t"), "channel_id").alias("v")).collect()] == ["x", "top", "7", None, 'q"uote', None, None]


def test_regions(spark):
    rows = [
        ("all out", "proxy", "groq", "outage"), ("all out", "proxy", "openai", "outage"), ("one up", "proxy", "groq", "outage"), ("one up", "proxy", "openai", "operational"), ("slow", "proxy", "groq", "outage"), ("slow", "proxy", "openai", "degraded"),
        ("service", "billing", "internal", "outage"), ("service", "proxy", "groq", "operational"), ("stranger", "proxy", "exa", "outage"),
    ]
    df = spark.createDataFrame(rows, "region string, service string, provider string, status string")
    assert {r.region: r.status for r in telemetry.region_status(df).collect()} == {"all out": "outage", "one up": "operational", "slow": "degraded", "service": "outage", "stranger": "operational"}


def test_rewrite_strings_keeps_protected_fields(spark):
    df = spark.createDataFrame([((("id 1999", "in 1999"), ["1999"]),)], "s struct<a: struct<id: string, x: string>, l: array<string>>")
    (row,) = P.rewrite_strings(df, ["s"], P.scrub_text, ("id",)).collect()
    assert row.s.a.id == "id 1999" and row.s.a.x == "in [YEAR]" and row.s.l == ["[YEAR]"]


def test_apply_updates_adds_and_changes(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = L.apply_updates(store, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_otlp_payloads(spark):
    attributes = [{"key": "svc", "value": {"stringValue": "a"}}, {"key": "n", "value": {"intValue": "3"}}]
    point = {"asInt": "5", "timeUnixNano": "1700000000123456789", "attributes": attributes}
    metric = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "sum": {"dataPoints": [point, {"timeUnixNano": "1"}]}}]}]}]}
    raw = spark.createDataFrame([(json.dumps(metric),)], "value string")
    (row,) = otlp.flatten_otlp_metrics(raw).collect()
    assert (row.name, row.value, row.labels) == ("m", 5.0, {"svc": "a", "n": "3"}) and str(row.ts).endswith("20.123456")
    logs = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1000", "severityNumber": 17, "body": {"stringValue": "x"}}, {"timeUnixNano": "1000", "severityNumber": 3}]}]}]}
    assert [r.level for r in otlp.flatten_otlp_logs(spark.createDataFrame([(json.dumps(logs),)], "value string")).collect()] == ["ERROR", "INFO"]
    spans = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "0", "endTimeUnixNano": "2000000"}]}]}]}
    (span,) = otlp.flatten_otlp_spans(spark.createDataFrame([(json.dumps(spans),)], "value string")).collect()
    assert span.status == "OK"


def test_trace_batches(spark, tmp_path):
    trace = {"trace_id": "t1", "components": [{"event_type": "THOUGHT_START", "data": "{}"}, {"event_type": "ACTION_RESULT", "data": "{}"}]}
    (tmp_path / "b.json").write_text(json.dumps({"events": [{"event_type": "x", "trace": trace}], "trace_level": "generic"}))
    traces = otlp.read_trace_batches(spark, str(tmp_path))
    assert [r.event_type for r in otlp.explode_components(traces).orderBy("i").collect()] == ["THOUGHT_START", "ACTION_RESULT"]
    otlp.export_jsonl({"t": traces.select("trace_id")}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/t")).count() == 1


def test_a_broken_line_loses_nothing_else(spark, tmp_path):
    trace = lambda name: json.dumps({"events": [{"event_type": "x", "trace": {"trace_id": name, "components": []}}]})
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([trace("t1"), '{"events": [', "", trace("t2"), "[1, 2]", json.dumps({"events": "none"}), trace("t3")]))
    (folder / "b.json").write_text(trace("t4") + "\nnot JSON")
    good, bad = otlp.sorted_out(otlp.read_lines(spark, str(folder)), otlp.ENVELOPE)
    assert sorted(r.trace_id for r in otlp.parse_trace_batches(good).collect()) == ["t1", "t2", "t3", "t4"]
    found = sorted((r.file.split("/")[-1], r.reason, r.record[:9]) for r in bad.collect())
    assert found == [("a.json", "no JSON", '{"events"'), ("a.json", "no object", "[1, 2]"), ("a.json", "other types", '{"events"'), ("b.json", "no JSON", "not JSON")]
    parts = otlp.sorted_out(otlp.read_lines(spark, str(folder), stream=True), otlp.ENVELOPE)
    for name, df in (("good_lines", otlp.parse_trace_batches(parts[0]).select("trace_id")), ("bad_lines", parts[1].select("record", "reason"))):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("good_lines").count() == 4 and spark.table("bad_lines").count() == 4
    point = lambda value: json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [{"asDouble": value, "timeUnixNano": "1000"}]}}]}]}]})
    (tmp_path / "m.json").write_text("\n".join([point(1.5), "{", point(2.5)]))
    good, bad = otlp.sorted_out(otlp.read_lines(spark, str(tmp_path / "m.json")), otlp.METRICS)
    assert sorted(r.value for r in otlp.flatten_otlp_metrics(good).collect()) == [1.5, 2.5] and bad.count() == 1


def test_trace_store_prunes_by_date(spark, tmp_path):
    tr = adapter.traces(spark, "/root/testdata/sf0.001")
    otlp.write_traces(tr, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.count() == tr.count()
    assert back.where("dt = date '2024-01-05'").count() == tr.where("to_date(ts) = date '2024-01-05'").count()


def test_repair_overwrites_late_buckets(spark):
    points = adapter.derived(spark, "/root/testdata/sf0.001", "points")
    daily = lambda df: telemetry.metrics_rollup(df, "1 day")
    store = daily(points.where("event_id % 5 <> 0"))
    fixed = jobs.repair_rollup(store, points, daily, "2024-01-10 00:00:00", "bucket")
    late = F.col("bucket") >= "2024-01-10"
    assert sorted(map(tuple, fixed.where(late).collect())) == sorted(map(tuple, daily(points).where(late).collect()))


def test_typed_values(spark):
    df = spark.createDataFrame([("yes",), ("0",), ("7.9",), ("x",)], "v string")
    rows = df.select(*[ingest.to_typed(F.col("v"), k).alias(k) for k in ("bool", "int", "float", "string")]).collect()
    assert [tuple(r) for r in rows] == [(True, None, None, "yes"), (False, 0, 0.0, "0"), (None, 7, 7.9, "7.9"), (None, None, None, "x")]


def test_redaction_counts_follow_the_order_of_rules(spark):
    df = spark.createDataFrame([("foo_1989 in 1989, a@b.org and 10.0.0.1",), (None,)], "text string")
    first, second = P.redaction_counts(df, "text").orderBy(F.col("text").isNull()).collect()
    assert (first.n_identifier, first.n_year, first.n_email, first.n_ip, first.n_url) == (1, 1, 1, 1, 0)
    assert all(second[c] == 0 for c in ("n_identifier", "n_year", "n_email"))


def test_rules_read_only_what_may_match(spark):
    texts = ["no match here, " * 50 + "call 555\n123 - 4567 or 4111 1111\u00a01111 1111. bare foo_1989@x.org https://h/[URL] 1 words", "1989 und é 10.0.0.1", "x\t(555) 123 4567 y\u30001989 z", "only words", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.select(P.matchable(F.col("text"))).first()[0] == "call 555\n123 - 4567 or 4111 1111\u00a01111 1111. foo_1989@x.org https://h/[URL] 1 "
    for r in P.redaction_counts(df.withColumn("done", P.scrub_text(F.col("text"))), "text").collect():
        text, seen = r.text, dict.fromkeys((name for name, _, _ in P.SCRUB_RULES), 0)
        for name, pattern, replacement in P._rules("scrub") if text is not None else ():
            text, seen[name] = pattern.subn(replacement, text)
        assert (r.done, {n: r[f"n_{n}"] for n in seen}) == (text, seen)


def test_key_status_and_page(spark):
    tr = spark.createDataFrame([("t1", "k1", "2024-01-02"), ("t2", "k2", "2024-01-02"), ("t3", "k3", "2024-01-02"), ("t4", None, "2024-01-02")], "trace_id string, signature_key_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    keys = spark.createDataFrame([("k1", False, "2024-01-01"), ("k2", True, None), ("k3", False, None)], "key_id string, revoked boolean, expires string").withColumn("expires", F.col("expires").cast("timestamp"))
    assert {r.trace_id: r.key_status for r in ingest.check_keys(tr, keys).collect()} == {"t1": "expired", "t2": "revoked", "t3": "known", "t4": "unknown"}
    rows = L.page(tr, [F.col("trace_id")], 3, 2).collect()
    assert [(r.trace_id, r.total, r.has_more) for r in rows] == [("t3", 4, False), ("t4", 4, False)]


def test_payload_digest_is_what_agents_sign(spark, registry_query):
    """Sorted keys, no empty values, ASCII escapes; a null inside a list goes, an object emptied by that stays."""
    rows = [("a", 0, "X", '{"p": "é", "q": {"r": null, "s": [2, null]}, "e": [], "n": {"x": ""}}'), ("b", 0, "X", '{"q": {"s": [2]}, "n": {}, "p": "é", "z": ""}'), ("c", 0, "X", '{"p": 2}'), ("d", 0, "X", "no json")]
    df = spark.createDataFrame(rows, "trace_id string, i int, event_type string, data string")
    got = {r.trace_id: r.sha256 for r in ingest.payload_digest(df).collect()}
    signed = '{"components":[{"data":{"n":{},"p":"\\u00e9","q":{"s":[2]}},"event_type":"X"}],"trace_level":"generic"}'
    assert got["a"] == hashlib.sha256(signed.encode()).hexdigest() and len(set(got.values())) == 4
    from tracemill.plans import records

    parts = {}
    for r in records._components(spark, DATA).collect():
        parts.setdefault(r.trace_id, []).append((r.i, r.event_type, json.loads(r.data), r.trace_level))
    for r in registry_query("payload_digest").collect():
        held = sorted(parts[r.trace_id])
        strip = lambda v: {k: strip(x) for k, x in v.items() if x not in (None, "", [], {})} if isinstance(v, dict) else [strip(x) for x in v if x is not None] if isinstance(v, list) else v
        body = {"components": [strip({"event_type": e, "data": d}) for _, e, d, _ in held], "trace_level": held[0][3]}
        assert r.sha256 == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_ingest_turns_away_for_a_reason(spark):
    kinds = {"good": ("k1", "detailed"), "revoked": ("k2", "detailed"), "stranger": ("k9", "generic"), "full": ("k1", "full_traces")}
    body = '{"csdma": {"plausibility_score": 0.5}, "y": 1999, "models_used": ["real"]}'
    six = [(t, i, e, body, k, "2024-01-02", level) for t, (k, level) in kinds.items() for i, e in enumerate(ingest.SIX)]
    rows = [*six, ("up", 0, "startup", "{}", None, "2024-01-02", "generic"), ("odd", 0, "WHAT", "{}", "k1", "2024-01-02", "generic")]
    ev = spark.createDataFrame(rows, "trace_id string, i int, event_type string, data string, signature_key_id string, ts string, trace_level string").withColumn("ts", F.col("ts").cast("timestamp"))
    keys = spark.createDataFrame([("k1", False, None), ("k2", True, None)], "key_id string, revoked boolean, expires timestamp")
    out = ingest.ingest(ev, keys)
    assert {r.trace_id: (r.destination, r.reason) for r in out["results"].collect()} == {
        "good": ("production", None), "revoked": ("malformed", "key: revoked"), "stranger": ("malformed", "key: unknown"), "full": ("malformed", "no recogniser of names"), "up": ("connectivity", None), "odd": ("malformed", "schema: unknown_schema"),
    }
    (row,) = out["production"].collect()
    assert row.trace_id == "good" and row.csdma_plausibility_score == 0.5 and json.loads(row.dma_results)["y"] == 1999  # a year among the numbers costs nothing
    assert {r.trace_id: r.severity for r in out["malformed"].collect()} == {"revoked": "warning", "stranger": "warning", "full": "warning", "odd": "error"}
    assert len(row) > 75


def test_deferrals_once(spark):
    raw = spark.createDataFrame([("a", " why ", "2024-01-02"), ("a", "why", "2024-01-02"), ("a", "why", "soon")], "agent string, reason string, defer_until string")
    assert ingest.deferral_rows(raw).count() == 2


def test_frechet_nearest_is_exact_over_agents_and_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{i % 3}", f"t{i}", rng.uniform(0, 1, (2 + i % 4, 3)).round(2).tolist()) for i in range(90)]
    twin = next(i for i in range(90) if zlib.crc32(f"t{i}".encode()) % 5 == 0)  # held out; one point stays where it is
    rows[twin] = ("a9", f"t{twin}", [*next(r[2] for r in rows if zlib.crc32(r[1].encode()) % 5)])
    rows[twin][2].insert(1, rows[twin][2][0])
    paths = spark.createDataFrame(rows, "agent_id_hash string, task_id string, path array<array<double>>")
    train = [r for r in rows if zlib.crc32(r[1].encode()) % 5]
    pairs = C.frechet_pairs(paths, pivots=3)
    got = {r.task_id: r.distance for r in pairs.collect()}
    for _, task, path in rows:
        assert got[task] == pytest.approx(min(C.frechet(np.array(path), np.array(p)) for _, t, p in train if t != task))
    assert got[f"t{twin}"] == 0
    # labels by the definition: noise has no near neighbour, and only clusters count
    least = lambda path, some, own: min((C.frechet(np.array(path), np.array(p)) for _, t, p in some if t != own), default=None)
    minima = {t: least(p, train, t) for _, t, p in train}
    limit = np.percentile(list(minima.values()), 90)
    inside = [r for r in train if minima[r[1]] <= limit]
    p95, p99 = np.percentile([minima[t] for _, t, _ in inside], [95, 99])
    expected = {t: least(p, inside, t) for _, t, p in rows if zlib.crc32(t.encode()) % 5 == 0}
    labels = C.route_labels(paths, pairs, least=2)  # with two, whoever has a near neighbour is dense
    assert {r.task_id: (pytest.approx(r.nearest), r.label) for r in labels.collect()} == {t: (d, "canonical" if d <= p95 else "variant" if d <= p99 else "novel") for t, d in expected.items()}
    assert {r.label for r in C.route_labels(paths, pairs, reach=-1.0).collect()} == {"no_cluster"}
    assert all(r.canonical + r.variant + r.novel == pytest.approx(1) for r in C.route_rates(labels).collect())


def _clusters(paths, reach, least):
    """Density clusters by the definition: all pairs."""
    n = len(paths)
    near = [[C.frechet(a, b) <= reach for b in paths] for a in paths]
    dense = [i for i in range(n) if sum(near[i]) >= least]
    group = {i: i for i in dense}
    while True:
        new = {i: min(group[j] for j in dense if near[i][j]) for i in dense}
        if new == group:
            break
        group = new
    sizes = Counter(group.values())
    return {frozenset(i for i in dense if group[i] == g) for g, k in sizes.items() if k >= least}


@pytest.mark.parametrize(("reach", "least"), [(0.1, 5), (0.25, 3), (0.02, 2), (0.0, 2)])
def test_route_clusters_equal_all_pairs(spark, reach, least):
    rng = np.random.default_rng(7)
    kinds = [rng.uniform(0, 1, (k, 3)) for k in (2, 3, 5, 4, 2)]
    paths = [np.clip(kinds[i % 5] + rng.normal(0, 0.002 * (1 + i % 23), kinds[i % 5].shape), 0, 1) for i in range(200)]
    paths += [rng.uniform(0, 1, (2 + i % 3, 3)) for i in range(60)]
    paths += [np.repeat(kinds[0], 2, axis=0) for _ in range(20)] + [paths[3]] * 20  # points that stay, and equal paths
    rows = [(f"a{i % 3}", f"t{i:03}", p.tolist()) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "agent_id_hash string, task_id string, path array<array<double>>")
    got = {}
    for r in C.route_clusters(df, reach, least).collect():
        got.setdefault(r.cluster, set()).add(int(r.task_id[1:]))
    assert sum(map(len, got.values())) == len(paths)
    assert {frozenset(v) for k, v in got.items() if k is not None} == _clusters(paths, reach, least)


ATTACKED = [
    "<SCRIPT a>x</script>", "<script>", "</Script>", "onload = 'x'", "onclick=go", "JavaScript :x", "vbscript:x", "data:x;base64", "<iframe></iframe>", "<iframe>", "<object></object>", "<embed>", "<svg onload=", "<img onerror=", "<body onload=", "expression(", "@import x",
    "UNION ALL SELECT", "drop\ttable", "delete from", "insert into", "update x set", "exec(", "XP_cmdshell", "--", "#", "/*", "*/", "' or '1'='1", "; drop", "&sh", "|bash", "`x`", "$(x)", "../", "..\\", "%00", "\x00",
]


def test_guard_of_attacks_holds_for_every_rule(spark):
    met = spark.createDataFrame([(x,) for x in ATTACKED], "text string").select(F.col("text").rlike(P.ATTACK_GUARD).alias("guard"), P.detect_patterns(F.col("text")).alias("names")).collect()
    assert all(r.guard and r.names for r in met) and {n for r in met for n in r.names} == {n for n, _ in P.ATTACKS}


def test_lists_of_many_clean_models_take_no_step_for_each(spark):
    names = lambda n: spark.range(0, n, 1, 1).select(P.validate_models(F.to_json(F.transform(F.sequence(F.lit(1), F.lit(1002)), lambda i: F.concat_ws("-", F.lit("m"), i, "id")))).alias("v"))

    def seconds(n):
        start = time.perf_counter()
        assert names(n).agg(F.sum(F.size("v.value"))).first()[0] == 1000 * n
        return time.perf_counter() - start

    once = seconds(1)
    assert seconds(4000) - once < 15


def test_models_of_odd_lists_are_sanitised_one_by_one(spark):
    texts = ['["ok", "../z", null, "ok"]', '["a,b", "x--y"]', json.dumps(["m" * 257, "n"]), json.dumps(["n"] * 1001 + ["a b", "../"]), " [1, 2]", "[broken", None, "3", '"x"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", P.validate_models(F.col("text")).alias("v")).orderBy("i").collect()
    was = "models_used_was_string"
    assert [(list(r.v.value)[-3:], list(r.v.issues)) for r in rows] == [
        (["ok", "[PATH_REMOVED]z", "ok"], [was, "path_traversal"]), (["a,b", "x[SQL_REMOVED:sql_comment]y"], [was, "sql_comment"]), (["m" * 256 + "[TRUNCATED]", "n"], [was, "size_limit_exceeded"]),
        (["n", "n", "n"], [was, "path_traversal", "models_used_truncated"]), (["1", "2"], [was]), (["[broken"], [was]), ([], []), ([], [was, "models_used_invalid_type"]), ([], [was, "models_used_invalid_type"]),
    ]


def test_live_agents_say_nothing_of_their_manager_but_that_it_is_enabled(spark):
    seen = spark.createDataFrame([("x", "2024-01-30 23:58:00", "m"), ("y", "2024-01-30 23:58:00", "off"), ("z", "2024-01-30 20:00:00", "m")], "agent string, seen string, manager_id string").withColumn("seen", F.col("seen").cast("timestamp"))
    managers = spark.createDataFrame([("m", True, "refused"), ("off", False, None)], "manager_id string, enabled boolean, last_error string")
    live = G.live_agents(seen, managers, AS_OF)
    assert (sorted(live.columns), [r.agent for r in live.collect()]) == (["agent", "enabled", "manager_id", "seen"], ["x"])


def test_deviations_are_said_by_their_exact_value(spark):
    numbers = [("temporal_drift", 0.185, "0.18 change"), ("temporal_drift", 0.235, "0.23 change"), ("temporal_drift", 0.255, "0.26 change"), ("temporal_drift", 0.125, "0.12 change"), ("cross_agent_divergence", -2.25, "-2.2 sigma"), ("cross_agent_divergence", 1234.56, "1234.6 sigma"), ("hash_chain", 3.0, "3 gaps"), ("conscience_override", 2.35, "2.4 times")]
    for mechanism, number, said in numbers:
        assert spark.range(1).select(D._said(D.SAID[mechanism], F.lit(number))).first()[0] == said


def test_residue_gate_query_reads_no_number_but_the_years(spark, tmp_path):
    """Documents whose numbers look like years, and whose own years are out of reach."""
    from tracemill.plans import records

    docs = spark.createDataFrame([(1750, "x", "s"), (1751, "x", "s"), (12, "x", "s"), (1747, None, "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id for r in records.registry.queries["residue_gate"](spark, str(tmp_path)).collect()}
    assert found == {12}  # at 1702; the others stand at 1690, 1691 and 2037


def test_batches_and_malformed_records_read_each_component_once(spark):
    """One scan of the components says of each trace all that its destination, size and batch follow from; rows of a trace are sized without their data."""
    ev = spark.createDataFrame([("t", 0, "startup", "{}", "b", "generic", "k"), ("u", 0, "ODD", '{"a": 1', "b", "generic", "x"), ("v", 0, "ODD", "{}", None, "generic", "k")], "trace_id string, i int, event_type string, data string, batch_id string, trace_level string, signature_key_id string")
    ev = ev.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    keys = spark.createDataFrame([("k", False)], "key_id string, revoked boolean").withColumn("expires", F.lit(None).cast("timestamp"))
    out = ingest.ingest(ev, keys)
    batches = ingest.batch_accounting(out["results"])
    assert sorted((r.batch_id or "", r.received, r.accepted, r.rejected, r.destinations, r.reasons) for r in batches.collect()) == [
        ("", 1, 0, 1, ["malformed"], ["schema: unknown_schema=1"]), ("b", 2, 1, 1, ["connectivity", "malformed"], ["schema: unknown_schema=1"]),
    ]
    assert sorted((r.trace_id, r.bytes, r.component_count, r.event_types, r.severity) for r in out["malformed"].collect()) == [("u", 7, 1, ["ODD"], "error"), ("v", 2, 1, ["ODD"], "error")]
    for df, most in ((batches, 1), (out["malformed"].drop("sha256"), 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") - 1 <= most  # and the keys


def test_each_event_is_parsed_once_and_odd_data_give_nulls(spark):
    def made(data):
        events = [("t", i, kind, x, "2024-01-01 00:00:00") for i, (kind, x) in enumerate(data.items())]
        return ingest.denormalise(spark.createDataFrame(events, "trace_id string, i int, event_type string, data string, timestamp string"))

    plan = made({"THOUGHT_START": "{}"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= len(ingest.STORED) and "get_json_object(" not in plan
    odd = {
        "THOUGHT_START": '{"thought_depth": "3", "thought_type": "a\tb", "task_description": {"x": [1, null]}}', "SNAPSHOT_AND_CONTEXT": '{"cognitive_state": "work"', "ASPDMA_RESULT": '[{"is_recursive": true}]',
        "DMA_RESULTS": '{"csdma": "{\\"plausibility_score\\": 1}", "dsdma": [{"domain": "d"}], "pdma": {"conflicts": null, "stakeholders": ["a", "b"]}, "idma": {"k_eff": 1.50}}',
        "CONSCIENCE_RESULT": '{"entropy_level": 0, "epistemic_data": {"entropy_level": "0.75"}, "entropy_passed": false, "coherence_passed": null, "conscience_passed": "Yes"}', "ACTION_RESULT": '{"tokens_total": "9.9", "cost_cents": 1e2, "models_used": null}',
    }
    got = made(odd).first()
    assert (got.thought_depth, got.thought_type, got.cognitive_state, got.is_recursive, got.csdma_plausibility_score, got.dsdma_domain) == (3, "a\tb", None, None, None, None)
    assert (got.pdma_conflicts, got.pdma_stakeholders, got.idma_k_eff, got.entropy_level, got.entropy_passed, got.coherence_passed, got.conscience_passed) == (None, '["a","b"]', 1.5, 0.75, False, None, True)
    assert (got.tokens_total, got.cost_cents, got.models_used, got.conscience_checks_count, got.snapshot_and_context) == (9, 100.0, None, 1, odd["SNAPSHOT_AND_CONTEXT"])
