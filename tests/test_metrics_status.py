"""Metrics, latest state, status sync and history."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import T0, probe, probes, result, results, same, seconds, table
from probelens import schemas
from probelens.operators import evaluate, metrics, status
from probelens.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def event_results(spark):
    return evaluate.check_results(fx.event_cycles(spark, SF), fx.event_probes(spark, SF))


def test_counters_and_gauge(spark):
    log = results(
        spark,
        result("a", True, at=seconds(1), cycle_id="1"),
        result("a", False, at=seconds(2), cycle_id="2"),
        result("a", True, at=seconds(2), cycle_id="3"),
        result("b", False, at=seconds(1), cycle_id="4"),
        result("c", True, to_metrics=False, to_lines=True),
    )
    found = {(r.name, r.result): r.value for r in metrics.checks_total(log).collect()}
    assert found == {("a", "success"): 2, ("a", "failure"): 1, ("b", "failure"): 1}
    assert {r.name: r.value for r in metrics.healthy_gauge(log).collect()} == {"a": 1, "b": 0}


def test_histogram_bounds_are_inclusive(spark):
    log = results(spark, *[result("a", duration_us=d) for d in (5_000, 5_001, 10_000_000, 10_000_001)])
    found = {r.le: (r.value, r.sum_us, r["count"]) for r in metrics.check_duration_histogram(log).collect()}
    assert list(sorted(found)) == sorted([*metrics.BUCKETS, "+Inf"])
    assert {k: v[0] for k, v in found.items() if v[0] > 2 or k == "0.005"} == {"0.005": 1, "10": 3, "+Inf": 4}
    assert {v[1:] for v in found.values()} == {(20_010_002, 4)}


def test_exposition_text(spark):
    log = results(
        spark,
        result('q"\\\n', True, duration_us=2_500_000),
        result('q"\\\n', False, duration_us=500_000, at=seconds(1)),
    )
    lines = [r.line for r in metrics.metric_exposition(log).orderBy("metric", "probe", "rank").collect()]
    label = 'probe="q\\"\\\\\\n"'
    assert lines[0].startswith("# HELP canary_check_duration_seconds ")
    assert lines[1] == "# TYPE canary_check_duration_seconds histogram"
    assert f'canary_check_duration_seconds_bucket{{{label},le="0.5"}} 1' in lines
    assert f"canary_check_duration_seconds_sum{{{label}}} 3" in lines
    assert f'canary_checks_total{{{label},result="failure"}} 1' in lines
    assert lines[-1] == f"canary_healthy{{{label}}} 0" and len(lines) == 6 + 2 + 12 + 2 + 1
    assert metrics.metric_exposition(log.where("name = 'none'")).isEmpty()


def test_a_probe_without_durations_has_valid_lines(spark):
    lines = [r.line for r in metrics.metric_exposition(results(spark, result("a", duration_us=None))).collect()]
    assert not any("null" in line for line in lines)
    assert {'canary_check_duration_seconds_sum{probe="a"} 0', 'canary_check_duration_seconds_count{probe="a"} 0', 'canary_checks_total{probe="a",result="success"} 1'} <= set(lines)


def test_exposition_groups_the_log_once(spark):
    plan = metrics.metric_exposition(event_results(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [name") == 1


def test_counts_agree(spark):
    log = event_results(spark)
    totals = metrics.checks_total(log).groupBy("name").agg(F.sum("value").alias("n"))
    last_bucket = metrics.check_duration_histogram(log).where("le = '+Inf' AND value = count").select("name", F.col("value").alias("n"))
    assert same(totals, last_bucket) and not totals.isEmpty()


def test_latest_result_breaks_ties_by_cycle(spark):
    log = results(
        spark,
        result("a", message="old", at=seconds(1), cycle_id="9"),
        result("a", message="first", at=seconds(2), cycle_id="1"),
        result("a", message="second", at=seconds(2), cycle_id="2"),
    )
    assert [r.message for r in status.latest_results(log).collect()] == ["second"]


def test_reload_keeps_new_results_of_current_probes(spark):
    log = results(
        spark,
        result("a", at=seconds(1), cycle_id="1"),
        result("a", at=seconds(5), cycle_id="2"),
        result("a", at=seconds(6), cycle_id="3"),
        result("gone", at=seconds(7), cycle_id="4"),
        result("b", at=seconds(4), cycle_id="5"),
    )
    current = probes(spark, probe("a"), probe("b"))
    kept = status.results_of_current_probes(log, current, F.lit(seconds(5)))
    assert sorted(r.cycle_id for r in kept.collect()) == ["2", "3"]
    assert [r.cycle_id for r in status.reload_results(log, current, F.lit(seconds(5))).collect()] == ["3"]


def statuses(spark, *rows):
    names = ("name", "phase", "last_check_time", "last_status", "message")
    return table(spark, schemas.STATUSES, *[{"namespace": "d", **dict(zip(names, r))} for r in rows])


def sync_input(spark):
    before = statuses(
        spark,
        ("never", None, None, None, None),
        ("same", "Healthy", T0, 200, "m"),
        ("zero", "Unhealthy", T0, None, "m"),
        ("phase", "Unhealthy", T0, 200, "m"),
        ("code", "Healthy", T0, 204, "m"),
        ("text", "Healthy", T0, 200, "old"),
        ("silent", "Healthy", T0, 200, "m"),
    )
    latest = results(
        spark,
        *[result(f"d/{n}", at=seconds(9)) for n in ("never", "same", "phase", "code", "text", "unknown")],
        result("d/zero", False, 0, at=seconds(9)),
    )
    return before, latest


def test_status_sync(spark):
    before, latest = sync_input(spark)
    assert status.status_candidates(before, latest).count() == 6
    changes = {r.name: r for r in status.status_changes(before, latest).collect()}
    assert set(changes) == {"never", "phase", "code", "text"}
    assert changes["never"].phase == "Healthy" and changes["never"].last_check_time == seconds(9)
    after = status.status_merge(before, latest)
    rows = {r.name: r for r in after.collect()}
    assert rows["same"].last_check_time == T0 and rows["silent"].last_check_time == T0
    assert rows["zero"].last_status is None and rows["text"].message == "m" and len(rows) == 7
    assert status.status_changes(after, latest).isEmpty()
    summary = status.sync_summary(before, latest).collect()[0]
    assert tuple(summary) == (7, 7, 4)
    assert status.sync_summary(before, latest.where("false")).isEmpty()


def test_listing(spark):
    from test_specs_auth import canaries, canary

    rows = canaries(spark, canary("a", namespace="d"), canary("b", namespace="d"))
    listed = status.canary_listing(rows, statuses(spark, ("a", "Healthy", T0, 200, "m")), F.lit(seconds(90)))
    assert sorted(map(tuple, listed.collect())) == [
        ("d", "a", "https://x.test", "Healthy", 90),
        ("d", "b", "https://x.test", "", 90),
    ]


def history_log(spark):
    return results(
        spark,
        result("a", True, at=seconds(1), cycle_id="1"),
        result("a", False, at=seconds(14), cycle_id="2"),  # the last of window 0
        result("a", False, at=seconds(15), cycle_id="3"),
        result("a", True, at=seconds(31), cycle_id="4"),  # a flap inside window 2
        result("a", False, at=seconds(32), cycle_id="5"),
        result("a", True, at=seconds(100), cycle_id="6"),
        result("b", True, at=seconds(50), cycle_id="7"),
    )


@pytest.mark.parametrize("chunk_windows", [1, 2, 3, 4096])
def test_history_keeps_changes_between_polls(spark, chunk_windows):
    found = status.status_history(history_log(spark), chunk_windows=chunk_windows)
    rows = sorted((r.name, (r.window_start - T0).seconds, r.phase) for r in found.collect())
    assert rows == [("a", 0, "Unhealthy"), ("a", 90, "Healthy"), ("b", 45, "Healthy")]


def test_history_continues_from_a_known_state(spark):
    known = spark.createDataFrame([("a", "Unhealthy", 200, "m")], "name string, phase string, last_status int, message string")
    found = status.status_history(history_log(spark), initial=known)
    assert sorted((r.name, r.phase) for r in found.collect()) == [("a", "Healthy"), ("b", "Healthy")]


def test_history_chunks_agree_on_events(spark):
    log = event_results(spark)
    whole = status.status_history(log, seconds=3600)
    assert same(whole, status.status_history(log, seconds=3600, chunk_windows=7)) and whole.count() > 500


def test_history_and_exposition_scan_the_log_once(spark):
    for df in (status.status_history(event_results(spark), seconds=86_400), metrics.metric_exposition(event_results(spark))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scans = [line for line in plan.splitlines() if "Scan parquet" in line and "props" in line]
        assert len(scans) == 1, plan
