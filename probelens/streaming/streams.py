"""The operators on streams.

Functions without `start_` turn a streaming table into another one. Functions with `start_` attach a sink
and start the query; they take the folders for output and checkpoint, which must be shared by all
executors. Sinks that write in `foreachBatch` put each batch into a folder of its number and replace it
when the batch runs again, so a retried batch leaves the same tables. An output folder belongs to one
checkpoint: a new checkpoint counts batches from 0 again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probelens.operators import auth, evaluate, metrics, status
from probelens.sources import sinks

Trigger = dict[str, object]
ALL_NOW: Trigger = {"availableNow": True}
STREAM_CYCLE = ["cycle_id", "probe", "cycle_started_at"]


def stream_check_results(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    """Results of arriving cycles: the batch projection, stateless. The probe table is read at start."""
    return evaluate.check_results(cycles, probes)


def stream_assemble_cycles(exchanges: DataFrame, probes: DataFrame, delay: str) -> DataFrame:
    """Cycles from arriving responses, emitted when the watermark passes their start.

    `delay` must exceed the longest check; what comes later is dropped and counted in the query progress.
    Requests outside the plan do not enter the state. Of copies the first arrival counts, as in the batch form, and
    they combine before the shuffle.
    """
    rows = exchanges.withWatermark("cycle_started_at", delay)
    return evaluate.assemble_cycles(rows, probes, keys=STREAM_CYCLE)


def stream_exchange_results(exchanges: DataFrame, probes: DataFrame, delay: str) -> DataFrame:
    """Results from arriving responses. Rows are judged first, so shuffle and state hold no bodies."""
    judged = evaluate.request_verdicts(exchanges.withWatermark("cycle_started_at", delay), probes)
    once = evaluate.first_arrivals(judged, [*STREAM_CYCLE, "seq"], evaluate.VERDICT_ARRIVAL)
    checks = evaluate.combine_verdicts(once, STREAM_CYCLE).where(F.col("healthy").isNotNull())
    return checks.select(evaluate.RESULT_COLUMNS)


def stream_latest_results(results: DataFrame) -> DataFrame:
    """Last result per probe (update mode). State is one row per probe; an older late result never wins."""
    return status.latest_results(results)


def stream_metrics(results: DataFrame) -> DataFrame:
    """Running totals per probe (update mode)."""
    return metrics.probe_metrics(results)


def start_append(rows: DataFrame, path: str, checkpoint: str, trigger: Trigger = ALL_NOW) -> StreamingQuery:
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(**trigger).start()


def start_result_lines(results: DataFrame, path: str, checkpoint: str, trigger: Trigger = ALL_NOW) -> StreamingQuery:
    """JSON lines of arriving results routed to lines."""
    writer = sinks.result_lines(results).writeStream.outputMode("append").format("text")
    return writer.option("checkpointLocation", checkpoint).option("path", path).trigger(**trigger).start()


def start_upserts(rows: DataFrame, path: str, checkpoint: str, trigger: Trigger = ALL_NOW) -> StreamingQuery:
    """Store the changed rows of every batch of an update-mode aggregate; `read_upserts` gives the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders `name=N` below a path, ascending; unfinished ones don't count."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    done = lambda f: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{f}/_SUCCESS"))
    return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}=") and done(f))


def _remove(spark: SparkSession, path: str, name: str, numbers: list[int]) -> None:
    for n in numbers:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={n}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def upsert_tables(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[str, int]]:
    """The folders a reader has to open: the newest merged table and the batches after it. `before`: as it was before that batch."""
    seen = {kind: [n for n in _numbers(spark, path, kind) if before is None or n < before] for kind in ("merged", "batch")}
    merged = seen["merged"][-1:]
    return [("merged", n) for n in merged] + [("batch", n) for n in seen["batch"] if not merged or n > merged[0]]


def read_upserts(spark: SparkSession, path: str, key: str | Sequence[str] = "name", before: int | None = None) -> DataFrame:
    """Current table: of each key the row of the last batch that wrote it. Opens the newest merged table and the
    batches after it. `before` gives the table as it was before that batch."""
    kinds = upsert_tables(spark, path, before)
    if not kinds:
        raise FileNotFoundError(f"no batch below {path}")
    parts = [spark.read.parquet(f"{path}/{kind}={n}").withColumn("batch", F.lit(n)) for kind, n in kinds]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rest = [c for c in rows.columns if c not in (*_keys(key), "batch")]
    last = rows.groupBy(*_keys(key)).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_last"))
    return last.select(*_keys(key), "_last.*")


def compact_upserts(spark: SparkSession, path: str, key: str | Sequence[str] = "name", keep: int = 2) -> None:
    """Merge all batches so far into `path/merged=N`, N the last of them, and remove what only older tables need.

    The newest `keep` merged tables stay, with the batches after the oldest of them, for readers that have begun. May
    run beside the stream: a batch that is written meanwhile belongs to the next merge.
    """
    batches = _numbers(spark, path, "batch")
    if batches and batches[-1] not in _numbers(spark, path, "merged"):
        read_upserts(spark, path, key).write.mode("overwrite").parquet(f"{path}/merged={batches[-1]}")
    merged = _numbers(spark, path, "merged")
    oldest = merged[-keep:][0] if merged else -1
    _remove(spark, path, "merged", [n for n in merged if n < oldest])
    _remove(spark, path, "batch", [n for n in batches if n <= oldest and n != batches[-1]])


def trim_batches(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest `keep` of the tables a stream writes whole for each batch: `probes` and `credentials` of a
    reload or of a feed. The next batch reads the one before it."""
    _remove(spark, path, "batch", _numbers(spark, path, "batch")[: -max(keep, 1)])


def start_status_history(
    results: DataFrame,
    path: str,
    checkpoint: str,
    delay: str,
    seconds: int = status.POLL_SECONDS,
    initial: DataFrame | None = None,
    trigger: Trigger = ALL_NOW,
    compact_every: int = 100,
) -> StreamingQuery:
    """Status writes of closed poll windows, as `path/changes/batch=N`.

    `path/polled/batch=N` holds the windows that batch N closed and `path/states/batch=N` the states it changed; the
    state of every probe is what the batches so far wrote last (`read_upserts`), merged every `compact_every` batches.
    A batch reads the states before it and replaces its own, so running it twice gives the same. `initial` is the
    state before the stream.
    """
    spark = results.sparkSession
    polled = status.latest_per_window(results.withWatermark("last_check_time", delay), seconds)
    state = F.struct(*status.STATE)

    def before(batch_id: int) -> DataFrame | None:
        stored = read_upserts(spark, f"{path}/states", before=batch_id) if upsert_tables(spark, f"{path}/states", batch_id) else None
        if initial is None or stored is None:
            return stored if initial is None else initial.select("name", *status.STATE)
        both = initial.select("name", state.alias("_old")).join(stored.select("name", state.alias("_new")), ["name"], "full")
        return both.select("name", F.coalesce("_new", "_old").alias("_s")).select("name", "_s.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written once, then read by both tables below, so the stateful part runs once per batch.
        batch.write.mode("overwrite").parquet(f"{path}/polled/batch={batch_id}")
        windows, known = spark.read.parquet(f"{path}/polled/batch={batch_id}"), before(batch_id)
        changes = status.changes_over_windows(windows, known)
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        # a probe's state after the batch differs from before only if its last change is one of these
        written = spark.read.schema(changes.schema).parquet(f"{path}/changes/batch={batch_id}")
        ends = written.groupBy("name").agg(F.max_by(state, F.col("window_start")).alias("_end"))
        ends.select("name", "_end.*").write.mode("overwrite").parquet(f"{path}/states/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            compact_upserts(spark, f"{path}/states")

    writer = polled.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def read_status_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/changes").drop("batch")


RELOAD_ERRORS = "batch BIGINT, loading STRING, error STRING"


def start_probe_reload(
    cycles: DataFrame,
    load_probes: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    trigger: Trigger = ALL_NOW,
    load_credentials: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Evaluate each batch against the probe set as it is then; results go to `path/results/batch=N`.

    The set, and which credentials there are, are loaded and stored as `path/probes/batch=N` and
    `path/credentials/batch=N` before use; of credentials only ids and whether they hold a value are stored, never values. If either
    fails to load in any way, does not decode or has a row without its key, both of the batch before are used on,
    and `path/errors/batch=N` says why: a broken file never stops the checks. Without any good set the batch fails.

    With credentials, a probe whose credentials are missing sends nothing: its checks fail with the error that
    `auth.runtime_auth_errors` gives it, whatever responses there are.
    """
    spark = cycles.sparkSession
    loads = {"probes": load_probes} | ({"credentials": load_credentials} if load_credentials else {})

    def kept(kind: str, rows: DataFrame) -> DataFrame:
        key = rows.columns[0]
        if not rows.where(F.col(key).isNull()).isEmpty():
            raise ValueError(f"a row of the {kind} has no {key}")
        if kind == "probes":
            return rows
        held = F.col("value").isNotNull() if "value" in rows.columns else F.lit(True)
        return rows.select("credential_id", held.alias("value_present"))

    def good_set(batch_id: int) -> dict[str, DataFrame]:
        own, previous = ({k: f"{path}/{k}/batch={n}" for k in loads} for n in (batch_id, batch_id - 1))
        errors = []
        for kind, load in loads.items():
            try:
                kept(kind, load()).write.mode("overwrite").parquet(own[kind])
            except Exception as error:  # a loader is the caller's code and may fail in any way
                if batch_id == 0:
                    raise
                errors.append((batch_id, kind, f"{type(error).__name__}: {str(error)[:1000]}"))
                break
        if errors:
            for kind in loads:
                spark.read.parquet(previous[kind]).write.mode("overwrite").parquet(own[kind])
            spark.createDataFrame(errors, RELOAD_ERRORS).write.mode("overwrite").parquet(f"{path}/errors/batch={batch_id}")
        return {kind: spark.read.parquet(folder) for kind, folder in own.items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        good = good_set(batch_id)
        if load_credentials and "auth" in good["probes"].columns:
            batch = evaluate.with_auth_errors(batch, auth.runtime_auth_errors(good["probes"], good["credentials"].where("value_present")))
        results = evaluate.check_results(batch, good["probes"])
        results.write.mode("overwrite").parquet(f"{path}/results/batch={batch_id}")

    writer = cycles.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
