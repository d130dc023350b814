"""Latest state per probe, status synchronisation, status history and the listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from probelens.functions.text import text_or_empty
from probelens.operators.joins import lookup_join
from probelens.operators.specs import probe_key
from probelens.session import run_dir

ORDER = ["last_check_time", "cycle_id"]
POLL_SECONDS = 15
# Poll windows per chunk of the history; bounds what one task orders for one probe.
CHUNK_WINDOWS = 4096
STATE = ["phase", "last_status", "message"]


def latest_results(results: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last result of each probe, by time and then cycle id.

    `max_by` combines inside each map task, so a probe with very many checks sends one row per task.
    """
    order = order or [c for c in ORDER if c in results.columns]
    rest = [c for c in results.columns if c != "name"]
    last = results.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select("name", "_last.*").select(results.columns)


def latest_from_days(spark: SparkSession, path: str, probes: DataFrame, at_once: int = 1) -> tuple[DataFrame, list[str]]:
    """Last result of each probe of the set, from a log stored by day (`sinks.write_result_days`), and the days that were read.

    Days are opened from the newest on, `at_once` together, until every probe of the set is found; a day that
    holds all of them ends the search. A probe that was never checked leads to the first day. Of a day only probes that
    are still missing count, so rows per step are one per probe at most.
    """
    days = sorted((r["day"] for r in spark.read.parquet(path).select("day").distinct().collect()), reverse=True)
    missing, found, read = probes.select("name"), None, []
    for i in range(0, len(days), at_once):
        some = days[i : i + at_once]
        rows = spark.read.parquet(path).where(F.col("day").isin(some)).drop("day").join(missing, ["name"], "left_semi")
        read += [str(d) for d in some]
        # cut here, so that a later step does not search the days before it again
        last = latest_results(rows)
        folder = run_dir(spark, "latest")
        last.write.parquet(folder)
        last = spark.read.schema(last.schema).parquet(folder)
        found = last if found is None else found.unionByName(last)
        missing = missing.join(last.select("name"), ["name"], "left_anti")
        if missing.isEmpty():
            break
    if found is None:
        found = latest_results(spark.read.parquet(path).drop("day")).where(F.lit(False))
    return found, read


def results_of_current_probes(results: DataFrame, probes: DataFrame, reload_time: Column) -> DataFrame:
    """Results from the reload on, of probes in the current set."""
    recent = results.where(F.col("last_check_time") >= reload_time)
    return lookup_join(recent, probes.select("name"), on=["name"], spread_by=["last_check_time"], how="left_semi")


def reload_results(results: DataFrame, probes: DataFrame, reload_time: Column) -> DataFrame:
    """Latest results after a reload. The log is reduced to one row per probe before it meets the probes."""
    recent = results.where(F.col("last_check_time") >= reload_time)
    return latest_results(recent).join(probes.select("name"), ["name"], "left_semi")


def phase_of(healthy: Column) -> Column:
    return F.when(healthy, F.lit("Healthy")).otherwise(F.lit("Unhealthy"))


def _new_status(latest: DataFrame) -> DataFrame:
    return latest.select(
        F.col("name").alias("_key"),
        phase_of(F.col("healthy")).alias("new_phase"),
        F.col("last_check_time").alias("new_last_check_time"),
        F.col("status_code").alias("new_last_status"),
        F.col("message").alias("new_message"),
    )


def _joined(statuses: DataFrame, latest: DataFrame, how: str) -> DataFrame:
    """Both sides hold one row per key, so no key can be hot."""
    keyed = statuses.withColumn("_key", probe_key(F.col("namespace"), F.col("name")))
    return keyed.join(_new_status(latest), ["_key"], how)


def _changed() -> Column:
    """Phase, status or message differ. A field never written reads as its zero value; time is not compared."""
    return F.col("new_phase").isNotNull() & (
        (text_or_empty(F.col("phase")) != F.col("new_phase"))
        | (F.coalesce("last_status", F.lit(0)) != F.coalesce("new_last_status", F.lit(0)))
        | (text_or_empty(F.col("message")) != text_or_empty(F.col("new_message")))
    )


def status_candidates(statuses: DataFrame, latest: DataFrame) -> DataFrame:
    """Declarations (with their current status) that have a latest result."""
    return _joined(statuses, latest, "inner").drop("_key")


def status_changes(statuses: DataFrame, latest: DataFrame) -> DataFrame:
    """The statuses to write: new values of the candidates whose state differs."""
    return status_candidates(statuses, latest).where(_changed()).select(
        "namespace",
        "name",
        F.col("new_phase").alias("phase"),
        F.col("new_last_check_time").alias("last_check_time"),
        F.col("new_last_status").alias("last_status"),
        F.col("new_message").alias("message"),
    )


def status_merge(statuses: DataFrame, latest: DataFrame) -> DataFrame:
    """The whole status table after a sync; an unchanged row stays as it is, its old check time included."""
    merged = _joined(statuses, latest, "left").withColumn("_changed", _changed())
    fields = {c: F.when(F.col("_changed"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*STATE, "last_check_time")}
    return merged.withColumns(fields).select(statuses.columns)


def sync_summary(statuses: DataFrame, latest: DataFrame) -> DataFrame:
    """Counts of one sync: results received, canaries checked, statuses updated. No results, no row."""
    both = _joined(statuses, latest, "full")
    counts = both.agg(
        F.count("new_phase").alias("results_received"),
        F.count("namespace").alias("canaries_checked"),
        F.count_if(_changed() & F.col("namespace").isNotNull()).alias("statuses_updated"),
    )
    return counts.where("results_received > 0")


def observed_sync(statuses: DataFrame, latest: DataFrame) -> tuple[DataFrame, Observation]:
    """The changes of a sync, and its counts as seen in the same pass.

    Once the changes are written, `Observation.get` has results_received, canaries_checked and statuses_updated: both inputs are
    read once for the write and the summary.
    """
    seen = Observation("sync")
    changed = F.coalesce(_changed() & F.col("namespace").isNotNull(), F.lit(False))
    both = _joined(statuses, latest, "full").withColumn("_write", changed).observe(
        seen,
        F.count("new_phase").alias("results_received"),
        F.count("namespace").alias("canaries_checked"),
        F.count_if(F.col("_write")).alias("statuses_updated"),
    )
    fields = {c: f"new_{c}" for c in (*STATE[:1], "last_check_time", *STATE[1:])}
    return both.where("_write").select("namespace", "name", *[F.col(n).alias(c) for c, n in fields.items()]), seen


def canary_listing(canaries: DataFrame, statuses: DataFrame, as_of: Column) -> DataFrame:
    """Name, URL, phase and age of every declaration; the phase is empty until the first sync."""
    phases = statuses.select("namespace", "name", "phase")
    age = F.unix_timestamp(as_of) - F.unix_timestamp("created_at")
    return canaries.join(phases, ["namespace", "name"], "left").select(
        "namespace",
        "name",
        F.col("spec.url").alias("url"),
        text_or_empty(F.col("phase")).alias("phase"),
        age.alias("age_seconds"),
    )


def latest_per_window(results: DataFrame, seconds: int = POLL_SECONDS) -> DataFrame:
    """State each poll would see: per probe and window (aligned to the epoch) the last result in it.

    Takes a table, or a stream with a watermark on `last_check_time`.
    """
    state = F.struct(
        phase_of(F.col("healthy")).alias("phase"),
        F.col("status_code").alias("last_status"),
        "message",
        "last_check_time",
    )
    order = F.struct(*[c for c in ORDER if c in results.columns])
    window = F.window("last_check_time", f"{seconds} seconds").alias("w")
    start = F.col("w.start")
    return (
        results.groupBy("name", window)
        .agg(F.max_by(state, order).alias("s"))
        .select(
            "name",
            F.floor(F.unix_micros(start) / (seconds * 1_000_000)).cast("long").alias("window_index"),
            start.alias("window_start"),
            "s.*",
        )
    )


def changes_over_windows(
    polled: DataFrame, initial: DataFrame | None = None, chunk_windows: int = CHUNK_WINDOWS
) -> DataFrame:
    """Of polled states keep the first and every one that differs from the one before.

    `initial` gives the state before the first window (name, phase, last_status, message). The order is
    needed per probe, and a probe may have most of the rows, so windows are cut into chunks and `lag` looks
    inside a chunk only. The state a chunk starts from is the last one of the chunk before; it is found on
    a table of one row per probe and chunk and put in front of the chunk as a row of its own.
    """
    state = F.struct(*STATE)
    rows = polled.withColumn("_chunk", F.floor(F.col("window_index") / chunk_windows).cast("long"))
    ends = rows.groupBy("name", "_chunk").agg(F.max_by(state, F.col("window_index")).alias("_end"))
    over_chunks = Window.partitionBy("name").orderBy("_chunk")
    before = ends.select("name", "_chunk", F.lag("_end").over(over_chunks).alias("_carried"))
    if initial is not None:
        known = initial.select("name", state.alias("_initial"))
        before = lookup_join(before, known, on=["name"], spread_by=["_chunk"], how="left").select(
            "name", "_chunk", F.coalesce("_carried", "_initial").alias("_carried")
        )
    carried = before.where(F.col("_carried").isNotNull()).select("name", "_chunk", "_carried.*")
    in_chunk = Window.partitionBy("name", "_chunk").orderBy(F.col("window_index").asc_nulls_first())
    lagged = rows.unionByName(carried, allowMissingColumns=True).withColumn("_before", F.lag(state).over(in_chunk))
    previous = F.col("_before")
    different = previous.isNull() | ~(
        F.col("phase").eqNullSafe(previous["phase"])
        & (F.coalesce("last_status", F.lit(0)) == F.coalesce(previous["last_status"], F.lit(0)))
        & (text_or_empty(F.col("message")) == text_or_empty(previous["message"]))
    )
    changes = lagged.where(F.col("window_index").isNotNull() & different)
    return changes.select("name", "window_start", *STATE, "last_check_time")


def status_history(
    results: DataFrame,
    seconds: int = POLL_SECONDS,
    initial: DataFrame | None = None,
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """The status writes a poll every `seconds` would make over the result log.

    Only the last result of a window is seen, so a shorter flap leaves no trace.
    """
    return changes_over_windows(latest_per_window(results, seconds), initial, chunk_windows)
