"""Published rules of dashboards, corpus and scores: a row made by hand for each branch."""

import json

from pyspark.sql import functions as F

from tracemill.operators import corpus as C
from tracemill.operators import detectors as D
from tracemill.operators import filters as L
from tracemill.operators import governance as G
from tracemill.operators import ingest, scoring, telemetry

AS_OF = "2024-01-31 00:00:00"


def _timed(spark, rows, schema, ts="ts"):
    return spark.createDataFrame(rows, schema).withColumn(ts, F.col(ts).cast("timestamp"))


def test_messages_of_the_billing_service(spark):
    rows = [
        (1, "billing", "GET /v1/billing/credits/check 200"), (2, "billing", "POST /v1/billing/litellm/usage"), (3, "billing", "POST /v1/billing/charges"), (4, "billing", "GET /v1/integrity"), (5, "billing", "oauth done"),
        (6, "billing", "GET /health 200"), (7, "billing", None), (8, "other", "POST /v1/billing/charges"), (9, "billing", "/v1/billing/charges after /v1/billing/credits/check"), (10, "billing", "x" * 300),
    ]
    logs = _timed(spark, [(i, "2024-01-01 00:04:59" if i < 9 else "2024-01-01 00:05:00", s, "INFO", m) for i, s, m in rows], "log_id long, ts string, service string, level string, message string")
    got = {(str(r.time)[11:16], r.metric): r.value for r in telemetry.classify_messages(logs).collect()}
    assert got == {("00:00", "Credit Checks"): 1, ("00:00", "LLM Usage"): 1, ("00:00", "Charges"): 1, ("00:00", "Integrity"): 1, ("00:00", "Other"): 1, ("00:05", "Credit Checks"): 1, ("00:05", "Other"): 1}
    named = {r.log_id: r.operation for r in telemetry.billing_operations(logs).collect()}
    assert named == {1: "Credit Check", 2: "LLM Usage", 3: "Charge", 4: "Integrity", 5: "OAuth", 9: "Credit Check", 10: "Other"}
    assert [len(r.details) for r in telemetry.billing_operations(logs, n=1).collect()] == [150]
    assert telemetry.classify_messages(logs, service="other").count() == 1


def test_trailing_counts_by_panel(spark):
    rows = [
        (1, "2024-01-30 00:00:00", "billing", "ERROR", "m"),  # the start of the window is no part of it
        (2, "2024-01-30 00:00:01", "a", "ERROR", "m"), (3, "2024-01-30 23:30:00", "b", "CRITICAL", "m"), (4, "2024-01-30 23:40:00", "billing", "ERROR", "/v1/billing/charges"),
        (5, "2024-01-30 12:00:00", "c", "WARNING", "/v1/billing/charges"), (6, "2024-01-31 00:00:00", "billing", "INFO", "/v1/billing/credits/check"), (7, "2024-01-31 00:00:01", "d", "ERROR", "late"),
    ]
    (row,) = telemetry.trailing_counts(_timed(spark, rows, "log_id long, ts string, service string, level string, message string"), AS_OF).collect()
    assert row.asDict() == {"logs": 5, "errors": 3, "warnings": 1, "active_services": 2, "recent_errors": 2, "services_with_errors": 3, "credit_checks": 1, "llm_usage": 0, "charges": 1, "billing_errors": 1}


def test_alerts_of_the_billing_service_go_by_its_name(spark):
    logs = _timed(spark, [("2024-01-01 00:00:30", "billing", "ERROR", "x"), ("2024-01-01 01:00:30", "shop", "ERROR", "payment failed")], "ts string, service string, level string, message string")
    assert {(str(r.start)[11:13], r.rule) for r in telemetry.alert_rules(logs).collect() if str(r.start)[14:16] == "00"} == {("00", "errors"), ("00", "billing"), ("01", "errors")}


def test_newest_values_by_series_and_sums_at_the_newest_time(spark):
    rows = [
        ("a", "requests.total", 1, 10.0, None), ("a", "requests.total", 2, 30.4, None), ("b", "requests.total", 2, 5.0, None), ("a", "service.requests", 1, 7.0, "x"), ("a", "service.requests", 2, 9.0, "y"),
        ("a", "service.requests", 1, 99.0, None), ("a", "service.healthy", 1, 1.0, "x"), ("a", "service.error_rate", 1, 0.5, "x"), ("a", "service.errors", 1, 3.0, "x"), ("a", "system.healthy", 1, 1.0, None),
    ]
    points = _timed(spark, [(a, m, f"2024-01-01 00:00:0{t}", v, s, i) for i, (a, m, t, v, s) in enumerate(rows)], "agent string, metric string, ts string, value double, service string, event_id long")
    (row,) = telemetry.value_at_latest(points, "requests.total").collect()
    assert row.value == 35 and str(row.ts).endswith("02")
    first = {r.agent: r for r in telemetry.agent_overview(points).collect()}["a"]
    assert (first.services, first.total_requests, first.total_errors, first.healthy) == (2, 30, None, 1)
    health = {r.service: r for r in telemetry.service_health(points, agent="a").collect()}
    assert set(health) == {"a/x", "a/y"} and tuple(health["a/x"]) == ("a/x", 7, 3, 0.5, None, 1) and tuple(health["a/y"]) == ("a/y", 9, 0, None, None, 0)
    assert [r.metric for r in telemetry.series_by_label(points, "service.requests").collect()] == [None, "a/x", "a/y"]


def test_hours_of_verified_traces(spark):
    schema = "ts string, agent_id_hash string, trace_type string, selected_action string, csdma double, dsdma double, entropy double, coherence double, tokens_total long, cost_cents double, llm_calls long, processing_ms long, signature_verified boolean, action_was_overridden boolean, " + ", ".join(f"{c}_passed boolean" for c in telemetry.CHECKS)
    row = lambda kind, action, csdma, verified: ("2024-01-01 00:10:00", "a", kind, action, csdma, 0.5, 0.1, 0.2, 10, 1.0, 3, 7, verified, True, *[None, True, True, False, True])
    tr = _timed(spark, [row("VERIFY_IDENTITY", "SPEAK", 0.2, True), row("EXPRESS_GRATITUDE", "TASK_COMPLETE", 0.6, True), row("VERIFY_IDENTITY", "SPEAK", 0.0, False), row("VERIFY_IDENTITY", "SPEAK", 0.0, None)], schema)
    (hour,) = telemetry.traces_hourly(tr).collect()
    assert (hour.trace_count, hour.verify_identity_count, hour.express_gratitude_count, hour.min_csdma_plausibility, hour.speak_count, hour.task_complete_count, hour.total_llm_calls) == (2, 1, 1, 0.2, 1, 1, 6)
    assert (hour.conscience_pass_rate, hour.entropy_pass_rate, hour.optimization_veto_pass_rate, hour.overrides_count) == (0.0, 1.0, 0.0, 2)


def test_spans_fail_unless_they_are_ok(spark):
    spans = spark.createDataFrame([("s", f"t{i}", 1000, x) for i, x in enumerate(["OK", "ERROR", "UNSET", None])], "service string, trace_id string, duration_us long, status string")
    assert telemetry.span_stats(spans).first().failures == 2


def test_signals(spark):
    checks = ("coherence_passed", "entropy_passed", "optimization_veto_passed", "epistemic_humility_passed")
    rows = [(0.0, False, None, True, True, True, True, None), (0.9, None, False, False, False, None, False, True), (None, True, True, True, True, False, None, False)]
    tr = spark.createDataFrame(rows, "csdma double, " + ", ".join(f"{c} boolean" for c in (*checks, "fragility", "signature_verified", "action_was_overridden")))
    assert tuple(C.signal_health(tr).first()) == (1, 1, 1, 1, 1, 1, 1, 1, 1, 3)


def test_halves_of_a_metric_are_of_the_time_it_has_values(spark):
    rows = [(f"2024-01-{d:02}", 0.2 if d < 3 else 0.5 if d < 6 else None, 1.0) for d in range(1, 11)]
    tr = _timed(spark, rows, "ts string, csdma double, dsdma double")
    got = {r.metric: r for r in C.stationarity(tr, ("csdma", "dsdma")).collect()}
    assert (got["csdma"].first_n, got["csdma"].second_n, got["csdma"].shifted) == (2, 3, True)
    assert (got["dsdma"].first_n, got["dsdma"].second_n, got["dsdma"].shifted) == (5, 5, False)


def test_cohorts_diverge_in_k_eff_and_correlation(spark):
    rows = [("p", f"a{i}", f"2024-01-30 00:{k:02}:00", 0.5, 0.5, 3.0 if i else 9.0, 0.1, False) for i in range(5) for k in range(10)]
    tr = _timed(spark, rows, "deployment_domain string, agent_id_hash string, ts string, csdma double, dsdma double, k_eff double, correlation_risk double, action_was_overridden boolean")
    got = {(r.agent_id_hash, r.metric): r.z for r in D.cohort_divergence(tr, AS_OF).collect()}
    assert {m for _, m in got} == {"csdma", "dsdma", "k_eff", "correlation_risk", "override_rate"}
    assert got["a0", "k_eff"] > 1.7 and got["a1", "k_eff"] < 0 and got["a0", "csdma"] == 0


def test_alert_totals(spark):
    alerts = spark.createDataFrame([("m", "critical", "a", False, None), ("m", "warning", "b", None, True), ("n", "warning", "a", True, False)], "mechanism string, severity string, agent_id_hash string, acknowledged boolean, resolved boolean")
    assert {r.mechanism: tuple(r)[1:] for r in D.alert_stats(alerts).collect()} == {"m": (2, 1, 1, 1, 1, 2), "n": (1, 0, 1, 0, 0, 1), None: (3, 1, 2, 1, 1, 2)}


def test_manager_totals(spark):
    seen = _timed(spark, [("a", "m1", "2024-01-30 23:56:00"), ("a", "m2", "2024-01-30 23:57:00"), ("b", "m3", "2024-01-30 23:55:00")], "agent string, manager_id string, seen string", "seen")
    managers = spark.createDataFrame([("m1", True, None), ("m2", True, "refused"), ("m3", False, "refused")], "manager_id string, enabled boolean, last_error string")
    assert G.fleet_stats(seen, managers, AS_OF).first().asDict() == {"total_managers": 2, "managers_with_errors": 1, "total_agents": 1}


def test_tasks_and_their_seeds(spark):
    said = json.dumps({"system_snapshot": {"current_thought_summary": {"content": "u said: why? \nrest"}}})
    rows = [("t1", "x", 1, "2024-01-01", "late"), ("t2", "x", 0, "2024-01-03", None), ("t3", "x", 0, "2024-01-02", said), ("t4", None, 0, "2024-01-05", None), ("t5", "", None, "2024-01-06", said)]
    tr = _timed(spark, [(i, t, k, d, at, "h", "name", s, "because") for i, (t, k, d, at, s) in enumerate(rows)], "event_id long, trace_id string, task_id string, thought_depth int, ts string, agent_id_hash string, agent_name string, snapshot_and_context string, action_rationale string")
    got = [(r.task, r.n, r.seed, r.observation) for r in L.group_by_task(tr).collect()]
    assert got == [("standalone-t4", 1, "t4", "because"), ("x", 3, "t3", "why?"), ("standalone-t5", 1, None, None)]


def test_traces_of_a_qa_export(spark):
    row = lambda trace, version="2.7", kind="THOUGHT_START", level="detailed", channel="model_eval_1", day=5: (trace, version, kind, level, json.dumps({"channel_id": channel}), f"2024-01-{day:02}")
    rows = [row("ok"), row("ok", kind="OTHER", day=6), row("full", level="full_traces"), row("old", version="2.6"), row("later", kind="OTHER"), row("generic", level="generic"), row("plain", channel="modelXeval_1"), row("early", day=1), row("end", day=9)]
    events = _timed(spark, [(i, *r) for i, r in enumerate(rows)], "event_id long, trace_id string, schema_version string, event_type string, trace_level string, payload string, ts string")
    calls = _timed(spark, [(i, t, "2024-01-05") for i, t in enumerate(["ok", "old", "ok", "end"])], "call_id long, trace_id string, ts string")
    kept, called = L.qa_export(events, calls, "2.7", since="2024-01-05", until="2024-01-09")
    assert [(r.trace_id, r.event_id) for r in kept.collect()] == [("end", 8), ("full", 2), ("ok", 0), ("ok", 1)]
    assert [(r.trace_id, r.call_id) for r in called.collect()] == [("end", 3), ("ok", 0), ("ok", 2)]


def test_what_stands_in_the_way_of_a_score(spark):
    base = dict.fromkeys(scoring.COVERED, 0.5) | dict.fromkeys(scoring.FACULTIES, True)
    schema = "agent_name string, event_id long, ts string, selected_action string, signature_verified boolean, action_was_overridden boolean, has_positive_moment boolean, action_success boolean, idma_result string, thought_id string, csdma double, dsdma double, k_eff double, conscience_passed boolean, coherence double, entropy double, signature_key_id string, entropy_passed boolean, coherence_passed boolean, optimization_veto_passed boolean, epistemic_humility_passed boolean"

    def row(agent, i, day, action="SPEAK", csdma=0.9, coherent=True, good=True):
        flags = (base["entropy_passed"], coherent, True, True)
        return (agent, i, f"2024-01-{day:02} 00:00:00", action, good, False, False, True, None, "t", csdma, 0.5, 0.5, True, 0.5, 0.1, "k", *flags)

    rows = [row("fine", i, 25) for i in range(40)] + [row("fine", i, 10) for i in range(40)]
    rows += [row("moved", i, 25, csdma=0.7) for i in range(40)] + [row("moved", i, 10) for i in range(40)]
    rows += [row("unchecked", i, 25, coherent=None if i % 2 else True) for i in range(40)]
    rows += [row("few", i, 25, good=False) for i in range(5)]
    rows += [row("idle", i, 25, action="PONDER") for i in range(31)]
    rows += [row("aged", i, 1) for i in range(95)] + [row("aged", 100 + i, 30, coherent=False) for i in range(10)]
    got = {r.agent_name: r for r in scoring.diagnose(_timed(spark, rows, schema), "2024-01-01 00:00:00", AS_OF, "2023-12-01 00:00:00").collect()}
    assert set(got["fine"].issues) & {"drift", "few_traces", "low_coverage", "decay"} == set()
    assert "low_coverage" in got["unchecked"].issues and got["unchecked"].coverage == 0.5
    assert {"few_traces", "i_int_low"} <= set(got["few"].issues) and got["few"].lowest == "i_int"
    assert got["idle"].coverage is None and "low_coverage" not in got["idle"].issues
    assert "decay" in got["aged"].issues and got["aged"].decay_impact > 0.2
    moved = {r.agent_name: r for r in scoring.diagnose(_timed(spark, rows, schema), "2024-01-20 00:00:00", AS_OF, "2024-01-01 00:00:00").collect()}
    assert "drift" in moved["moved"].issues and "drift" not in moved["fine"].issues


def test_no_payload_stops_an_ingest(spark):
    good = '{"csdma": {"plausibility_score": 0.5}}'
    odd = {"surrogate": '{"action_rationale":"\\ud800 x in 1999"}', "deep": "[" * 5000, "nested": '{"a":' * 3000 + "1" + "}" * 3000, "nan": '{"x": NaN}', "broken": '{"a": ', "text": "no JSON at all", "null": None, "fine": good}
    rows = [(t, i, e, body if i == 2 else good) for t, body in odd.items() for i, e in enumerate(ingest.SIX)]
    out = ingest.ingest(spark.createDataFrame(rows, "trace_id string, i int, event_type string, data string"))
    went = {r.trace_id: (r.destination, r.reason) for r in out["results"].collect()}
    unreadable = ("malformed", "payload: unreadable")
    assert went == {"surrogate": ("production", None), "fine": ("production", None), "text": ("production", None), "null": ("production", None)} | dict.fromkeys(("deep", "nested", "nan", "broken"), unreadable)
    stored = {r.trace_id: r.dma_results for r in out["production"].collect()}
    assert "\ud800" not in stored["surrogate"] and "[YEAR]" in stored["surrogate"]
    assert all(len(r.sha256) == 64 for r in out["malformed"].collect()) and out["malformed"].count() == 4


def test_spread_on_its_limit_is_taken_in_the_order_of_time(spark):
    """The rows of one group, whose deviation is a last bit over 0.15 in their order and 0.15 in the other, and of one that is never over."""
    values = [("a", x) for x in (0.38, 0.14, 0.32, 0.05, 0.32, 0.5, 0.32)] + [("b", x) for x in (0.32, 0.5, 0.32, 0.05, 0.32, 0.14, 0.38)]
    rows = [(f"t{i:02}", agent, "kind", f"2024-01-20 00:00:{i:02}", f"act{i % 4}", x) for i, (agent, x) in enumerate(values)]
    for given in (rows, rows[::-1], rows[::2] + rows[1::2]):
        tr = _timed(spark, given, "trace_id string, agent_id_hash string, trace_type string, ts string, selected_action string, csdma double")
        for made in (tr.coalesce(1), tr.repartition(5)):
            assert [(r.agent_id_hash, r.severity, r.value) for r in D.intra_agent_inconsistency(made, AS_OF).collect()] == [("a", "warning", 0.15000000000000002)]


def test_a_jump_on_its_limit_is_taken_in_the_order_of_time(spark, monkeypatch):
    """Two days of ten traces: the mean of the second is a last bit more or less than 0.15 over the first by the order of its sum."""
    values = (0.78, 0.05, 0.02, 0.75, 0.97, 0.92, 0.45, 0.86, 0.23, 0.37)
    days = {"a": [(0.39,) * 10, values], "b": [(0.39,) * 10, values[::-1]]}
    rows = [(f"t{agent}{d}{i}", agent, f"2024-01-{20 + d} 00:00:{i:02}", x, 0.5) for agent, both in days.items() for d, day in enumerate(both) for i, x in enumerate(day)]
    found = lambda tr: [(r.agent_id_hash, r.deviation_text, r.domain) for r in D.daily_drift(tr, AS_OF).collect()]
    for given in (rows, rows[::-1], rows[::2] + rows[1::2]):
        tr = _timed(spark, given, "trace_id string, agent_id_hash string, ts string, csdma double, coherence double")
        assert [found(made) for made in (tr.coalesce(1), tr.repartition(5))] == [[("a", "0.15 change", "2024-01-21")]] * 2
    monkeypatch.setattr(D, "ORDERED", 9)  # more rows than are put in order: equal up to rounding is equal
    assert found(tr) == []
