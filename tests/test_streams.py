"""Streams give the tables their batch forms give; several small batches, late and repeated rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from helpers import probe, probes, result, results, same, seconds, step, table
from probelens import schemas, session
from probelens.operators import evaluate, metrics, status
from probelens.sources import fixtures as fx
from probelens.sources import readers
from probelens.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return session.run_dir(spark, "stream-test")


def finish(query) -> None:
    query.awaitTermination()
    assert query.exception() is None


def feed(spark, folder, *tables):
    """Files in time order, one per micro-batch."""
    for i, rows in enumerate(tables):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i}")
    return arriving(spark, folder, tables[0].schema)


def arriving(spark, folder, schema):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/in/*")


def event_tables(spark):
    cycles = fx.event_cycles(spark, SF)
    return [cycles.where(F.dayofmonth("finished_at").between(a, b)) for a, b in ((1, 10), (11, 20), (21, 31))]


def test_event_streams_equal_batch(spark, folder):
    ps = fx.event_probes(spark, SF)
    log = evaluate.check_results(fx.event_cycles(spark, SF), ps)
    stream = streams.stream_check_results(feed(spark, folder, *event_tables(spark)), ps)

    finish(streams.start_append(stream, f"{folder}/h1", f"{folder}/c1"))
    assert same(log, spark.read.parquet(f"{folder}/h1"))

    latest = streams.stream_latest_results(stream)
    finish(streams.start_upserts(latest, f"{folder}/h3", f"{folder}/c3"))
    assert same(status.latest_results(log), streams.read_upserts(spark, f"{folder}/h3"))

    finish(streams.start_upserts(streams.stream_metrics(stream), f"{folder}/h4", f"{folder}/c4"))
    assert same(metrics.probe_metrics(log), streams.read_upserts(spark, f"{folder}/h4"))

    finish(streams.start_result_lines(stream, f"{folder}/h6", f"{folder}/c6"))
    assert spark.read.text(f"{folder}/h6").count() == log.where("to_lines").count()


def test_status_history_equals_batch_on_closed_windows(spark, folder):
    log = evaluate.check_results(fx.event_cycles(spark, SF), fx.event_probes(spark, SF)).cache()
    # A closing row far ahead lets the watermark pass every real window.
    closing = log.limit(1).withColumns(
        {"name": F.lit("closing"), "last_check_time": F.lit("2030-01-01 00:00:00").cast("timestamp")}
    )
    days = [log.where(F.dayofmonth("last_check_time").between(a, b)) for a, b in ((1, 10), (11, 20), (21, 31))]
    stream = feed(spark, folder, *days, closing)
    finish(streams.start_status_history(stream, f"{folder}/h5", f"{folder}/c5", "1 hour", seconds=3600))
    assert same(status.status_history(log, seconds=3600), streams.read_status_history(spark, f"{folder}/h5"))
    log.unpersist()


def test_status_history_starts_from_given_states(spark, folder):
    rows = [result("a", True, at=seconds(1), cycle_id="1"), result("a", False, at=seconds(40), cycle_id="2")]
    stream = feed(spark, folder, results(spark, rows[0]), results(spark, rows[1]), results(spark, result("z", at=seconds(4000))))
    known = spark.createDataFrame([("a", "Healthy", 200, "m")], "name string, phase string, last_status int, message string")
    finish(streams.start_status_history(stream, f"{folder}/h", f"{folder}/c", "1 second", initial=known))
    found = streams.read_status_history(spark, f"{folder}/h").collect()
    assert [(r.name, r.phase, r.last_check_time) for r in found] == [("a", "Unhealthy", seconds(40))]


def exchange(cycle_id, seq, at, status=200, probe="default/j") -> dict:
    return {
        "cycle_id": cycle_id, "probe": probe, "cycle_started_at": seconds(at), "seq": seq, "status_code": status,
        "started_at": seconds(at + seq), "finished_at": seconds(at + seq + 1), "body": "",
    }


def test_cycles_wait_for_late_rows_and_take_repeats_once(spark, folder):
    ps = probes(spark, probe("default/j", journey=[step("a"), step("b")]))
    log = [
        [exchange("1", 0, 0), exchange("2", 0, 5), exchange("2", 1, 5)],
        [exchange("1", 1, 0), exchange("1", 1, 0), exchange("2", 2, 5), exchange("3", 0, 20, status=500)],
        [exchange("9", 0, 500)],
    ]
    stream = feed(spark, folder, *[table(spark, schemas.EXCHANGES, *rows) for rows in log])
    cycles = streams.stream_assemble_cycles(stream, ps, "60 seconds")
    finish(streams.start_append(cycles, f"{folder}/h2", f"{folder}/c2"))
    found = spark.read.parquet(f"{folder}/h2")
    assert {r.cycle_id: [x.seq for x in r.responses] for r in found.collect()} == {"1": [0, 1], "2": [0, 1], "3": [0]}

    verdicts = streams.stream_exchange_results(stream, ps, "60 seconds")
    finish(streams.start_append(verdicts, f"{folder}/h2b", f"{folder}/c2b"))
    batch = evaluate.check_results(found.drop("cycle_started_at"), ps)
    assert same(batch, spark.read.parquet(f"{folder}/h2b")) and batch.count() == 3


def test_probe_reload_keeps_the_last_good_set(spark, folder):
    stream = feed(spark, folder, *event_tables(spark))
    good = fx.event_probes(spark, SF)
    strict = good.withColumn("expected_status", F.lit(418))
    loads = iter([lambda: good, lambda: spark.read.parquet(f"{folder}/broken"), lambda: strict])

    finish(streams.start_probe_reload(stream, lambda: next(loads)(), f"{folder}/h7", f"{folder}/c7"))
    found = streams.read_batches(spark, f"{folder}/h7/results")
    one, two, three = event_tables(spark)
    expected = evaluate.check_results(one.unionByName(two), good).unionByName(evaluate.check_results(three, strict))
    assert same(expected, found)


def test_reload_keeps_probes_and_credentials_together(spark, folder):
    """A truncated credentials file leaves the new probe set out too, and a probe without name is no good set."""
    (one, two, three), good = event_tables(spark), fx.event_probes(spark, SF)
    strict = good.withColumn("expected_status", F.lit(418))
    broken, sound = f"{folder}/broken", table(spark, schemas.CREDENTIALS, {"credential_id": "a", "value": "b"})
    spark.createDataFrame([('{"credential_id": "a", "val',)], "value string").write.text(broken)
    nameless = strict.withColumn("name", F.lit(None).cast("string"))
    probe_sets = iter([good, strict, nameless])
    held = iter([sound, readers.read_credentials(spark, broken), sound])
    stream = feed(spark, folder, one, two, three)
    finish(streams.start_probe_reload(stream, lambda: next(probe_sets), f"{folder}/h8", f"{folder}/c8", load_credentials=lambda: next(held)))
    everything = one.unionByName(two).unionByName(three)
    assert same(evaluate.check_results(everything, good), streams.read_batches(spark, f"{folder}/h8/results"))
    held_ids = sound.select("credential_id", F.lit(True).alias("value_present"))  # values are not stored
    assert same(held_ids, spark.read.parquet(f"{folder}/h8/credentials/batch=2"))


def test_compaction_leaves_the_same_table_in_few_folders(spark, folder):
    batches = [results(spark, *[result(f"p{i}", message=f"{k}", at=seconds(k), cycle_id=str(k)) for i in range(k % 3 + 1)]) for k in range(9)]
    for i, rows in enumerate(batches):
        streams_in = rows.coalesce(1)
        streams_in.write.mode("append").parquet(f"{folder}/in/part={i}")
    latest = streams.stream_latest_results(arriving(spark, folder, batches[0].schema))
    finish(streams.start_upserts(latest, f"{folder}/u", f"{folder}/c"))
    before = streams.read_upserts(spark, f"{folder}/u").collect()
    for _ in range(2):
        streams.compact_upserts(spark, f"{folder}/u", keep=1)
        assert sorted(streams.read_upserts(spark, f"{folder}/u").collect()) == sorted(before)
    left = {p for p in os.listdir(f"{folder}/u") if "=" in p}
    assert len(left) == 2 and len(streams.read_upserts(spark, f"{folder}/u").inputFiles()) <= 4
    results(spark, result("p0", message="later", at=seconds(99))).write.mode("append").parquet(f"{folder}/in/part=99")
    finish(streams.start_upserts(streams.stream_latest_results(arriving(spark, folder, batches[0].schema)), f"{folder}/u", f"{folder}/c"))
    now = {r.name: r.message for r in streams.read_upserts(spark, f"{folder}/u").collect()}
    assert now == {r.name: r.message for r in before} | {"p0": "later"}


def test_an_older_late_result_does_not_win(spark, folder):
    newer, older = result("a", message="new", at=seconds(9)), result("a", message="old", at=seconds(1))
    stream = feed(spark, folder, results(spark, newer), results(spark, older))
    finish(streams.start_upserts(streams.stream_latest_results(stream), f"{folder}/o", f"{folder}/c"))
    assert [r.message for r in streams.read_upserts(spark, f"{folder}/o").collect()] == ["new"]
