"""Status sync, change feed, late rows, arrival order, logs in buckets and by day, quarantine, and a reload that keeps secrets out."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import cycle, cycles, probe, probes, response, result, results, same, seconds, step, table
from probelens import schemas, session
from probelens.operators import evaluate, metrics, status
from probelens.operators.joins import SALT
from probelens.sources import fixtures as fx
from probelens.sources import readers, sinks
from probelens.streaming import arrivals, feed, streams, sync
from test_specs_auth import auth_spec, canary, ref

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return session.run_dir(spark, "continuous")


def local(path: str) -> Path:
    return Path(path.removeprefix("file:"))


def batches(spark, folder, *tables):
    for i, rows in enumerate(tables):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i}")
    return arriving(spark, folder, tables[0].schema)


def arriving(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def finish(query) -> None:
    query.awaitTermination()
    assert query.exception() is None


def forget_last_commit(checkpoint: str) -> None:
    """The state of a stream whose last batch was written, but not noted as done: it runs again."""
    commits = local(checkpoint) / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)


# ---- status synchronisation

STATUSES = schemas.STATUSES


def declared(spark, *rows):
    return table(spark, STATUSES, *[dict(zip(("namespace", "name", "phase", "last_status", "message", "last_check_time"), (*r, *[None] * (6 - len(r))))) for r in rows])


def check(name, healthy, at, message="m", code=200):
    return result(f"default/{name}", healthy, code, seconds(at), message, cycle_id=f"{at:06d}")


def test_status_sync_writes_only_what_changes(spark, folder):
    now = declared(spark, ("default", "a", "Healthy", 200, "m", seconds(-99)), ("default", "b"), ("default", "silent", "Unhealthy", 503, "old", seconds(-50)))
    stream = batches(
        spark, folder,
        results(spark, check("a", True, 1), check("b", True, 2), check("stranger", False, 3)),
        results(spark, check("a", True, 20), check("b", False, 21, "down", 500), check("b", True, 29)),
        results(spark, check("a", False, 40, "down", 500), check("b", True, 41, "other")),
        results(spark, check("z", True, 4000)),
    )
    finish(sync.start_status_sync(stream, lambda: now, f"{folder}/o", f"{folder}/c", "1 second"))
    found = {r.name: r for r in sync.status_table(spark, f"{folder}/o", now).collect()}
    assert (found["a"].phase, found["a"].last_check_time) == ("Unhealthy", seconds(40))
    assert (found["b"].phase, found["b"].message, found["b"].last_check_time) == ("Healthy", "other", seconds(41))
    assert (found["silent"].message, found["silent"].last_check_time) == ("old", seconds(-50))
    writes = sorted((r.name, r.window_start, r.message) for r in sync.read_status_writes(spark, f"{folder}/o").collect())
    # a poll sees the last result of its window, so b's short failure leaves no trace and its first equal state none either
    assert writes == [("a", seconds(30), "down"), ("b", seconds(0), "m"), ("b", seconds(30), "other")]


def test_status_sync_equals_history_and_survives_a_second_run(spark, folder):
    log = evaluate.check_results(fx.event_cycles(spark, SF), fx.event_probes(spark, SF))
    name = F.substring_index("name", "/", -1)
    now = log.select(F.lit("default").alias("namespace"), name.alias("name")).distinct().select(
        "namespace", "name", *[F.lit(None).cast(STATUSES[c].dataType).alias(c) for c in ("phase", "last_check_time", "last_status", "message")]
    )
    closing = log.limit(1).withColumns({"name": F.lit("closing"), "last_check_time": F.lit("2030-01-01").cast("timestamp")})
    days = [log.where(F.dayofmonth("last_check_time").between(a, b)) for a, b in ((1, 10), (11, 20), (21, 31))]
    stream, out, checkpoint = batches(spark, folder, *days, closing), f"{folder}/o", f"{folder}/c"

    def run():
        finish(sync.start_status_sync(stream, lambda: now, out, checkpoint, "1 hour", seconds=3600, compact_every=2))

    run()
    history = status.status_history(log, seconds=3600)
    writes = sync.read_status_writes(spark, out)
    assert same(history.select(name.alias("name"), "window_start", *status.STATE), writes)
    written = sorted(map(str, writes.collect()))
    before = sorted(sync.status_table(spark, out, now).collect())
    last = history.groupBy("name").agg(F.max_by("message", "window_start").alias("message"))
    assert {r.name: r.message for r in before} == {r.name.split("/")[1]: r.message for r in last.collect()}
    assert [p for p in local(f"{out}/statuses").iterdir() if p.name.startswith("merged=")]
    forget_last_commit(checkpoint)
    run()
    assert sorted(sync.status_table(spark, out, now).collect()) == before
    assert sorted(map(str, sync.read_status_writes(spark, out).collect())) == written


def test_a_declaration_created_again_begins_anew(spark, folder):
    def at(when):
        return declared(spark, ("default", "a")).withColumn("created_at", F.lit(when).cast("timestamp"))

    sets = iter([at("2024-01-01"), at("2024-02-01"), at("2024-02-01"), at("2024-02-01")])
    stream = batches(spark, folder, results(spark, check("a", True, 1)), results(spark, check("z", True, 500)), results(spark, check("z", True, 600)))
    finish(sync.start_status_sync(stream, lambda: next(sets), f"{folder}/o", f"{folder}/c", "1 second"))
    first, again = (sync.status_table(spark, f"{folder}/o", at(t)).first() for t in ("2024-01-01", "2024-02-01"))
    written = sync.read_status_writes(spark, f"{folder}/o").first()
    shown = first if written.created_at == at("2024-01-01").first().created_at else again
    assert {first.phase, again.phase} == {"Healthy", None} and shown.phase == "Healthy"


def test_a_batch_stores_the_states_it_changes_alone(spark, folder):
    many = [result(f"p{i}", at=seconds(1), cycle_id="1") for i in range(500)]
    one = [result(f"p{i}", i != 7, at=seconds(31), cycle_id="2") for i in range(500)]
    stream = batches(spark, folder, results(spark, *many), results(spark, *one), results(spark, result("z", at=seconds(4000))))
    finish(streams.start_status_history(stream, f"{folder}/h", f"{folder}/c", "1 second"))
    sizes = {p.name: spark.read.parquet(str(p)).count() for p in local(f"{folder}/h/states").iterdir() if p.name.startswith("batch=")}
    assert sorted(n for n in sizes.values() if n) == [1, 500]
    states = {r.name: r.phase for r in streams.read_upserts(spark, f"{folder}/h/states").collect()}
    assert len(states) == 500 and states["p7"] == "Unhealthy" and states["p8"] == "Healthy"


def test_a_sync_counts_while_it_writes(spark, folder):
    now = declared(spark, ("default", "a", "Healthy", 200, "m"), ("default", "b"), ("default", "c"))
    latest = results(spark, check("a", True, 1), check("b", False, 2), check("stranger", True, 3))
    changes, seen = status.observed_sync(now, latest)
    sinks.write_status_changes(changes, folder, 1)
    assert seen.get == status.sync_summary(now, latest).first().asDict() == {"results_received": 3, "canaries_checked": 3, "statuses_updated": 1}
    assert same(status.status_changes(now, latest), spark.read.parquet(f"{folder}/sync=1"))


# ---- change feed


def change(kind, name, op, at, seq=0, data=None, **spec):
    made = canary(name, **spec) if kind == "canary" and op != "delete" else {}
    return {"kind": kind, "namespace": "default", "name": name, "op": op, "at": seconds(at), "seq": seq, "created_at": made.get("created_at"), "spec": made.get("spec"), "data": data}


TOKEN = auth_spec("bearer", bearer={"token_secret_ref": ref("s", "token")})


def feed_tables(spark):
    steps = [
        [change("canary", "a", "create", 1, auth=TOKEN), change("canary", "b", "create", 1), change("secret", "s", "create", 1, data={"token": "topsecret"})],
        [change("canary", "b", "delete", 2), change("secret", "s", "delete", 2), change("canary", "a", "update", 0, auth=TOKEN, url="https://old.test")],
        [change("canary", "b", "update", 1, url="https://late.test"), change("canary", "b", "delete", 2)],
        [change("canary", "b", "create", 3, url="https://again.test"), change("secret", "s", "create", 3, data={"token": "othersecret"}), change("canary", "c", "create", 3, interval=2)],
    ]
    return [table(spark, schemas.DECLARATION_EVENTS, *rows) for rows in steps]


def test_probe_feed_follows_changes_and_forgets_nothing(spark, folder):
    stream, out, checkpoint = batches(spark, folder, *feed_tables(spark)), f"{folder}/o", f"{folder}/c"

    def run():
        finish(feed.start_probe_feed(stream, out, checkpoint))

    run()

    def shown(batch):
        return {r.name: (r.url, r.auth.type if r.auth else None, r.config_error) for r in spark.read.parquet(f"{out}/probes/batch={batch}").collect()}

    assert shown(0) == {"default/a": ("https://x.test", "bearer", None), "default/b": ("https://x.test", None, None)}
    assert shown(1) == {"default/a": ("https://x.test", None, 'Invalid auth config: resolving bearer token: secrets "s" not found')}
    assert not (local(out) / "probes" / "batch=2").exists()  # a late event and a repeated one change nothing
    assert shown(3) == {"default/a": ("https://x.test", "bearer", None), "default/b": ("https://again.test", None, None)}  # c's interval is not valid
    assert {r.credential_id for r in feed.read_probe_feed(spark, out, "credentials").collect()} == {"default__a__bearer-token"}
    before = feed.read_probe_feed(spark, out).collect()
    forget_last_commit(checkpoint)
    run()
    assert sorted(map(str, feed.read_probe_feed(spark, out).collect())) == sorted(map(str, before))


def holds(folder: str, text: str) -> list[str]:
    """Files below a folder in which a text occurs, decoded where they are tables."""
    import pyarrow.parquet as pq

    found = []
    for path in local(folder).rglob("*"):
        if path.is_file() and (text.encode() in path.read_bytes() or (path.suffix == ".parquet" and text in str(pq.ParquetFile(path).read().to_pylist()))):
            found.append(str(path))
    return found


def test_a_feed_stores_no_secret_value(spark, folder):
    stream = batches(spark, folder, *feed_tables(spark))
    finish(feed.start_probe_feed(stream, f"{folder}/o", f"{folder}/c"))
    assert holds(f"{folder}/in", "topsecret") and not [f for top in "oc" for text in ("topsecret", "othersecret") for f in holds(f"{folder}/{top}", text)]


# ---- reload


def test_a_reload_keeps_values_out_and_survives_any_loader(spark, folder):
    auth_of = {"type": "bearer", "token_credential_id": "id"}
    full = {**dict.fromkeys(schemas.PROBES["auth"].dataType.names), **auth_of}
    good = probes(spark, probe("default/a", auth=full), probe("default/b"))
    held = table(spark, schemas.CREDENTIALS, {"credential_id": "id", "value": "topsecret"}, {"credential_id": "empty", "value": None})
    none = held.where("credential_id = 'other'")

    def fail(error):
        raise error

    probe_sets = iter([lambda: good, lambda: fail(OSError("disk")), lambda: good.limit(0), lambda: good])
    stores = iter([lambda: held, lambda: fail(KeyError("gone")), lambda: none])
    rows = [cycles(spark, cycle(f"{k}{n}", f"default/{n}", response())) for k in range(4) for n in "a"]
    rows = [r.unionByName(cycles(spark, cycle(f"{k}b", "default/b", response()))) for k, r in enumerate(rows)]
    stream = batches(spark, folder, *rows)
    finish(streams.start_probe_reload(stream, lambda: next(probe_sets)(), f"{folder}/o", f"{folder}/c", load_credentials=lambda: next(stores)()))
    found = {r.cycle_id: (r.healthy, r.message) for r in streams.read_batches(spark, f"{folder}/o/results").collect()}
    fine, missing = (True, "Got expected status 200"), (False, 'missing credential "id"')
    assert found == {"0a": fine, "0b": fine, "1a": fine, "1b": fine, "2a": fine, "2b": fine, "3a": missing, "3b": fine}
    errors = spark.read.parquet(f"{folder}/o/errors").orderBy("batch").collect()
    assert [(r.loading, r.error.split(":")[0]) for r in errors] == [("probes", "OSError"), ("credentials", "KeyError")]
    assert not holds(f"{folder}/o", "topsecret")
    assert spark.read.parquet(f"{folder}/o/credentials/batch=0").columns == ["credential_id", "value_present"]


def test_missing_credentials_fail_every_kind_of_check(spark):
    failing = spark.createDataFrame([("default/j", "bearer", "missing credential reference")], "name string, auth_type string, error string")
    ps = probes(spark, probe("default/j", journey=[step("one"), step("two")]), probe("default/s"))
    rows = cycles(spark, cycle("1", "default/j", response(0), response(1)), cycle("2", "default/s", response(0)), cycle("3", "default/j"))
    found = {r.cycle_id: (r.healthy, r.message) for r in evaluate.check_results(evaluate.with_auth_errors(rows, failing), ps).collect()}
    text = "Step 1 (one) failed: missing credential reference"
    assert found == {"1": (False, text), "2": (True, "Got expected status 200"), "3": (False, text)}


# ---- late rows and arrival order


def exchange(cycle_id, seq, at, probe="default/j", status=200):
    return {"cycle_id": cycle_id, "probe": probe, "cycle_started_at": seconds(at) if at is not None else None, "seq": seq, "status_code": status,
            "started_at": seconds((at or 0) + seq), "finished_at": seconds((at or 0) + seq + 1), "body": "text"}


def test_every_arriving_row_is_accounted_for(spark, folder):
    ps = probes(spark, probe("default/j", journey=[step("a"), step("b")]))
    log = [
        [exchange("1", 0, 0), exchange("2", 0, 5), exchange("2", 1, 5), exchange("2", 1, 5)],
        [exchange("1", 1, 0), exchange("3", 0, 300), exchange("3", 7, 300), exchange("9", 0, 301, probe="default/none")],
        [exchange("4", 0, 10), exchange("3", 1, 300), exchange("5", 0, None), exchange("6", 0, 241)],
    ]
    stream = batches(spark, folder, *[table(spark, schemas.EXCHANGES, *rows) for rows in log])

    def run():
        finish(arrivals.start_arrivals(stream, ps, f"{folder}/a", f"{folder}/ca", "60 seconds"))

    run()
    forget_last_commit(f"{folder}/ca")
    run()
    finish(streams.start_append(arrivals.stream_arrived_results(spark, f"{folder}/a", "60 seconds", 1), f"{folder}/r", f"{folder}/cr"))
    done = spark.read.parquet(f"{folder}/r")
    assert {r.cycle_id: r.healthy for r in done.collect()} == {"1": True, "2": True}
    rows = {r.probe: r.asDict() for r in arrivals.account(spark, f"{folder}/a", done).collect()}
    assert rows["default/j"] == {"probe": "default/j", "arrived": 11, "late": 2, "unplanned": 1, "emitted": 5, "pending": 3}
    assert rows["default/none"] == {"probe": "default/none", "arrived": 1, "late": 0, "unplanned": 1, "emitted": 0, "pending": 0}
    late = arrivals.late_rows(spark, f"{folder}/a").collect()
    assert {(r.cycle_id, r.body) for r in late} == {("4", "text"), ("5", "text")} and {r.watermark for r in late} == {seconds(241)}
    assert "body" not in spark.read.parquet(f"{folder}/a/ontime").columns


def test_the_last_arrival_wins_whatever_its_time(spark, folder):
    newer = results(spark, result("a", message="new", at=seconds(9)), result("b", message="first", at=seconds(5)), result("b", message="second", at=seconds(2)))
    older = results(spark, result("a", message="old", at=seconds(1)))
    stream = arrivals.with_arrival(batches(spark, folder, newer, older))
    finish(arrivals.start_last_arrivals(stream, f"{folder}/o", f"{folder}/c"))
    found = streams.read_upserts(spark, f"{folder}/o")
    assert {r.name: r.message for r in found.collect()} == {"a": "old", "b": "second"} and "_arrived" not in found.columns


# ---- logs in buckets and by day


def exchanged_columns(df) -> list[list[str]]:
    """Columns of every exchange in the plan as it was executed."""
    found = []

    def visit(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return visit(node.plan())
        if kind in ("ShuffleExchangeExec", "BroadcastExchangeExec"):
            found.append([node.output().apply(i).name() for i in range(node.output().size())])
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return found


def test_bodies_stay_in_their_buckets_beyond_the_broadcast_limit(spark, folder):
    """11 MB of probes, above the default limit of 10 MB: the log is not moved, the probes go to its buckets."""
    n = 11_000
    big = spark.range(n).select(
        F.concat(F.lit("default/p"), "id").alias("name"), F.lit("https://x.test").alias("url"), F.lit(200).alias("expected_status"),
        F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1000)).alias("contains_text"),
    )
    ps = spark.createDataFrame([], schemas.PROBES).unionByName(big, allowMissingColumns=True)
    hot = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % n)  # a probe with a third of all rows
    log = spark.range(30_000).select(
        F.col("id").cast("string").alias("cycle_id"), F.concat(F.lit("default/p"), hot).alias("probe"), F.lit(seconds(0)).alias("cycle_started_at"),
        F.lit(0).alias("seq"), F.lit("request").alias("stage"), F.lit(seconds(0)).alias("started_at"), F.lit(seconds(1)).alias("finished_at"),
        F.lit(200).alias("status_code"), F.concat(hot.cast("string"), F.repeat(F.lit("x"), 1000)).alias("body"),
        F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error"),
    )
    sinks.write_bucketed(log, "bucketed_log", folder, 8)
    stored = readers.read_bucketed(spark, "bucketed_log")
    found = evaluate.exchange_results(stored, ps)
    moved = exchanged_columns(found)
    assert moved and not [c for c in moved if {"body", "r"} & set(c)] and SALT not in found.columns
    assert found.where("healthy").count() == 30_000
    assert same(evaluate.exchange_results(log, ps), found)
    sizes = [r["count"] for r in stored.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 30_000 / 3  # the hot probe is spread
    spark.sql("DROP TABLE bucketed_log")


def test_buckets_are_written_as_rows_come(spark, folder):
    log = fx.conversation_exchanges(spark, SF).repartition(6)
    setting = spark.conf.get(sinks._OPEN_FILES)
    sinks.write_bucketed(log, "bucketed_once", folder, 4)
    files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert len(files) == len({f.split("_")[-1] for f in files}) <= 4  # one task a bucket, so that none sorts what it holds
    assert spark.conf.get(sinks._OPEN_FILES) == setting
    assert same(log, readers.read_bucketed(spark, "bucketed_once").drop(SALT))
    spark.sql("DROP TABLE bucketed_once")


def test_assembled_cycles_from_buckets_equal_the_plain_log(spark, folder):
    log, ps = fx.conversation_exchanges(spark, SF), fx.conversation_probes(spark, SF)
    sinks.write_bucketed(log, "bucketed_turns", folder, 4)
    stored = readers.read_bucketed(spark, "bucketed_turns")
    assert same(evaluate.assemble_cycles(log, ps), evaluate.assemble_cycles(stored, ps))
    assert same(evaluate.unplanned_exchanges(log, ps), evaluate.unplanned_exchanges(stored, ps))
    spark.sql("DROP TABLE bucketed_turns")


def day_log(spark, days=10):
    rows = [result(f"p{i}", at=seconds(86_400 * d + i), message=f"d{d}", cycle_id=f"{d}-{i}") for d in range(days) for i in range(5)]
    return results(spark, *rows, result("rare", at=seconds(86_400 * (days - 2)), cycle_id="r"))


def test_the_latest_results_are_found_from_the_end_of_the_log(spark, folder):
    log = day_log(spark)
    sinks.write_result_days(log, folder)
    known = probes(spark, *[probe(f"p{i}") for i in range(5)], probe("rare"))
    found, read = status.latest_from_days(spark, folder, known)
    assert read == ["2024-01-10", "2024-01-09"] and same(status.latest_results(log), found)
    found, read = status.latest_from_days(spark, folder, known.where("name = 'p1'"))
    assert read == ["2024-01-10"] and [r.message for r in found.collect()] == ["d9"]
    found, read = status.latest_from_days(spark, folder, probes(spark, probe("never")), at_once=4)
    assert len(read) == 10 and found.isEmpty()


def test_metrics_by_day_merge_and_are_replaced_alone(spark, folder):
    log = day_log(spark).withColumn("duration_us", F.dayofmonth("last_check_time").cast("long") * 40_000)
    late = F.to_date("last_check_time") == "2024-01-04"
    sinks.write_metric_days(log.where(~late), folder)
    files = {p: p.stat().st_mtime_ns for p in local(folder).rglob("*.parquet")}
    sinks.write_metric_days(log.where(late), folder)
    sinks.write_metric_days(log.where(late), folder)  # once more, the same
    assert files.items() <= {p: p.stat().st_mtime_ns for p in local(folder).rglob("*.parquet")}.items()  # other days are not touched
    assert same(metrics.probe_metrics(log), metrics.merged_metrics(spark.read.parquet(folder)))


# ---- strict and lenient reading


def write_lines(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_one_bad_line_takes_its_file_out(spark, tmp_path):
    write_lines(tmp_path, "a.json", {"name": "a/1", "url": "u"}, {"name": "a/2", "url": "u"})
    write_lines(tmp_path, "b.json", {"name": "b/1", "url": "u"}, '{"name": "b/2", "ur')
    write_lines(tmp_path, "c.json", {"url": "nameless"}, {"name": "c/1"})
    good, bad = readers.read_with_quarantine(spark, "probes", str(tmp_path))
    assert {(r.name, r.interval) for r in good.collect()} == {("a/1", 0), ("a/2", 0)}
    told = {(r.file.rsplit("/", 1)[1], r.cause, r.line) for r in bad.collect()}
    assert told == {("b.json", "does not decode", '{"name": "b/2", "ur'), ("c.json", "has no name", '{"url":"nameless"}')}
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED|has no name"):
        readers.read_probes(spark, str(tmp_path)).collect()


def test_quarantine_never_shows_secrets(spark, tmp_path):
    write_lines(tmp_path, "s.json", {"namespace": "n", "name": "s", "data": {"k": "topsecret"}}, '{"namespace": "n", "data": {"k": "topsecret"')
    good, bad = readers.read_with_quarantine(spark, "secrets", str(tmp_path))
    assert good.isEmpty() and "topsecret" not in str(bad.collect()) and bad.first().line_chars > 20
    write_lines(tmp_path, "c.json", {"credential_id": None, "value": "topsecret"})
    _, bad = readers.read_with_quarantine(spark, "credentials", str(tmp_path / "c.json"))
    assert [(r.cause, r.line) for r in bad.collect()] == [("has no credential_id", None)]


@pytest.mark.parametrize("text", ['[{"statusCode":200}]', '{"name":"a"}', '[{"name":"a"}] trailing', "", "  ", None, '[{"name":"a"', "[1]", "null", '[{"name":"a"},null]', '[{"name":"a"}] [{"name":"b"}]', '[{"name":"a"}], [{"name":"b"}]'])
def test_a_results_body_that_is_no_array_is_an_error(spark, text):
    body = spark.createDataFrame([(1, '[{"name":"fine"}]'), (2, text)], "k int, body string")
    with pytest.raises(Exception, match="do not parse as one JSON array"):
        readers.results_from_text(body, "body").collect()


def test_results_bodies_that_are_arrays(spark):
    body = spark.createDataFrame([(1, '[{"name":"a","statusCode":200}, {"name":"b"}]'), (2, " [] "), (3, '\n[{"name":"c"}]\n')], "k int, body string")
    assert sorted((r.k, r.name, r.status_code) for r in readers.results_from_text(body, "body").collect()) == [(1, "a", 200), (1, "b", None), (3, "c", None)]


def test_a_row_without_key_is_an_error_whatever_is_read(spark, tmp_path):
    path = write_lines(tmp_path, "p.json", {"name": "a", "url": "u"}, {"url": "nameless"})
    for read in (lambda: readers.read_probes(spark, path).select("url").collect(), lambda: readers.read_probes(spark, path).count()):
        with pytest.raises(Exception, match="a row has no name"):
            read()
