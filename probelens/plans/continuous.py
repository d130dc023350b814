"""Registered queries of what runs continuously: status sync, change feed, late rows, order of arrival, logs that are kept by day or
in buckets, and input with broken files. Each derives its streams and stored tables from the driver's tables; SQL is in
`continuous_sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens import schemas
from probelens.operators import evaluate, metrics, status
from probelens.plans.queries import FAR, _event_results, _results, _run, _step, _sync_input, at, query
from probelens.session import run_dir
from probelens.sources import fixtures as fx
from probelens.sources import readers, sinks
from probelens.streaming import arrivals, feed, streams, sync


def _thirds(time: str, rows: DataFrame) -> Column:
    """0 to 2 by thirds of the time that the rows span."""
    first, last = rows.agg(F.unix_timestamp(F.min(time)), F.unix_timestamp(F.max(time))).first()
    return F.least(F.floor(3 * (F.unix_timestamp(time) - F.lit(first)) / F.lit((last or 0) - (first or 0) + 1)), F.lit(2))


def _in_steps(spark: SparkSession, label: str, rows: DataFrame, step: Column, start: Callable) -> str:
    """Run a stream three times over what has arrived by then, each time as one micro-batch; gives its output folder."""
    folder = run_dir(spark, label)
    schema = rows.schema
    for k in range(3):
        rows.where(step == k).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


@query
def stream_status_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of all customers after three micro-batches of order results, polled once a day, and how often each was written."""
    log, statuses = fx.order_results(spark, sf), fx.customer_statuses(spark, sf)
    closing = log.limit(1).withColumns({"name": F.lit("closing"), "last_check_time": at(FAR)})
    step = F.when(F.col("name") == "closing", 2).otherwise(_thirds("last_check_time", log))
    path = _in_steps(spark, "sync", log.unionByName(closing), step, lambda rows, o, c: sync.start_status_sync(rows, lambda: statuses, o, c, "1 hour", seconds=86_400))
    writes = sync.read_status_writes(spark, path).groupBy(*sync.KEY).agg(F.count(F.lit(1)).alias("writes"))
    now = sync.status_table(spark, path, statuses).join(writes, sync.KEY, "left")
    return now.withColumn("writes", F.coalesce("writes", F.lit(0)))


@query
def stream_probe_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The probe set after three micro-batches of changes: declarations and secrets are created, updated, deleted and created again;
    some events come late and some twice."""
    events = fx.declaration_events(spark, sf)
    path = _in_steps(spark, "feed", events, F.col("step"), lambda rows, o, c: feed.start_probe_feed(rows.drop("step"), o, c))
    return feed.read_probe_feed(spark, path).select("name", "url", F.col("auth.type").alias("auth_type"), "config_error")


@query
def results_from_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Journeys and tool listings judged from one log that is stored in buckets of (probe, salt)."""
    log = fx.conversation_exchanges(spark, sf).unionByName(fx.part_exchanges(spark, sf))
    probes = fx.conversation_probes(spark, sf).unionByName(fx.part_probes(spark, sf), allowMissingColumns=True)
    folder = run_dir(spark, "buckets")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    sinks.write_bucketed(log, name, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _results(evaluate.exchange_results(readers.read_bucketed(spark, name), probes))


def _delayed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as three micro-batches; turns arrive up to four minutes late, every fourth once more with the next batch."""
    rows = fx.conversation_exchanges(spark, sf)
    seen = rows.withColumn("seen", F.timestamp_seconds(F.unix_timestamp("cycle_started_at") + 120 * F.pmod("seq", F.lit(3))))
    first, last = rows.agg(F.unix_timestamp(F.min("cycle_started_at")), F.unix_timestamp(F.max("cycle_started_at"))).first()
    step = F.least(F.floor(3 * (F.unix_timestamp("seen") - F.lit(first)) / F.lit(last - first + 1)), F.lit(2)).alias("step")
    again = seen.where(F.pmod(F.col("cycle_id").cast("long") + F.col("seq"), F.lit(4)) == 0)
    both = seen.select(*rows.columns, step).unionByName(again.select(*rows.columns, F.least(step + 1, F.lit(2)).alias("step")))
    folder = run_dir(spark, "arriving")
    for k in range(3):
        both.where(F.col("step") == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(folder).drop("step")


@query
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """By probe, what became of the rows that arrived: late, unplanned, emitted with their check, or pending."""
    probes, delay = fx.conversation_probes(spark, sf), "130 seconds"
    path = _run(spark, "arrivals", lambda o, c: arrivals.start_arrivals(_delayed_turns(spark, sf), probes, o, c, delay))
    checks = arrivals.stream_arrived_results(spark, path, delay)
    done = spark.read.parquet(_run(spark, "checks", lambda o, c: streams.start_append(checks, o, c)))
    return arrivals.account(spark, path, done)


@query
def stream_last_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The result of each probe that arrived last: every fifth check comes half an hour late, and a batch brings newer ones first."""
    log = _event_results(spark, sf)
    late = F.col("cycle_id").cast("long") % 5 == 0
    folder = run_dir(spark, "arriving")
    for k in range(3):
        rows = log.where(_step("last_check_time", late, 1800) == k).coalesce(1)
        rows.sortWithinPartitions(F.col("cycle_id").cast("long").desc()).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = _run(spark, "last", lambda o, c: arrivals.start_last_arrivals(arrivals.with_arrival(stream), o, c))
    return _results(streams.read_upserts(spark, path))


def _broken_manifests(spark: SparkSession, sf: str) -> str:
    """Manifests in eight files: one file has a line that is cut off, one a line without name."""
    kinds = schemas.MANIFEST
    number = F.substring_index("name", "-", -1).cast("long")
    rows = fx.canaries(spark, sf).select(
        number.alias("k"),
        F.pmod(number, F.lit(8)).alias("shard"),
        F.to_json(
            F.struct(
                F.struct("namespace", F.when(number != 5, F.col("name")).alias("name"), "created_at").cast(kinds["metadata"].dataType).alias("metadata"),
                F.col("spec").cast(kinds["spec"].dataType).alias("spec"),
            )
        ).alias("line"),
    )
    path = run_dir(spark, "manifests")
    cut = F.when(F.col("k") == 3, F.substring("line", 1, 40)).otherwise(F.col("line"))
    rows.select("shard", cut.alias("value")).repartition(8, "shard").sortWithinPartitions("shard").write.partitionBy("shard").text(path)
    return path


@query
def read_with_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations of the sound files."""
    good, _ = readers.read_with_quarantine(spark, "canaries", f"{_broken_manifests(spark, sf)}/*")
    return good.select("namespace", "name", "created_at", F.col("spec.url").alias("url"))


@query
def quarantined_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that take their file out, and why."""
    _, bad = readers.read_with_quarantine(spark, "canaries", f"{_broken_manifests(spark, sf)}/*")
    return bad.select(F.regexp_extract("file", "shard=([0-9]+)", 1).cast("int").alias("shard"), "cause", F.substring("line", 1, 12).alias("line_begins"))


@query
def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Totals from partial metrics by day. A day first lacks half of its results and is then replaced alone."""
    log, path = _event_results(spark, sf), run_dir(spark, "rollup")
    day, late = F.to_date("last_check_time") == "2024-01-10", F.col("cycle_id").cast("long") % 2 == 0
    sinks.write_metric_days(log.where(~(day & late)), path)
    sinks.write_metric_days(log.where(day), path)
    return metrics.merged_metrics(spark.read.parquet(path)).select(
        "name", "success", "failure", F.col("buckets")[4].alias("within_100ms"), "sum_us", "n", "last_healthy"
    )


@query
def latest_from_days(spark: SparkSession, sf: str) -> DataFrame:
    """The last result of every probe, from a log by day that is opened from its end."""
    path = run_dir(spark, "days")
    sinks.write_result_days(_event_results(spark, sf), path)
    return _results(status.latest_from_days(spark, path, fx.event_probes(spark, sf), at_once=7)[0])


@query
def observed_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a sync as they were seen while its changes were written."""
    changes, seen = status.observed_sync(*_sync_input(spark, sf))
    sinks.write_status_changes(changes, run_dir(spark, "changes"), version=1)
    counts = seen.get
    names = ["results_received", "canaries_checked", "statuses_updated"]
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} BIGINT" for n in names)).where("results_received > 0")
