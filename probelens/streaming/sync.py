"""Continuous status synchronisation: each micro-batch writes the statuses that its closed poll windows change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probelens.operators import status
from probelens.operators.joins import lookup_join
from probelens.operators.specs import probe_key
from probelens.streaming.streams import ALL_NOW, Trigger, compact_upserts, read_upserts, upsert_tables

KEY = ["namespace", "name"]


def status_table(spark: SparkSession, path: str, declared: DataFrame, before: int | None = None) -> DataFrame:
    """The status of every declaration in `declared` (rows as `readers.read_statuses` gives them): what the synchronisation below
    `path` wrote last, or else the declaration's own. `before` gives the table as it was before that batch.

    If `declared` has a column created_at, what was written for an earlier declaration of the same name does not count.
    """
    if not upsert_tables(spark, f"{path}/statuses", before):
        return declared
    fields = [c for c in declared.columns if c in (*status.STATE, "last_check_time")]
    last = read_upserts(spark, f"{path}/statuses", KEY, before)
    same = "created_at" not in declared.columns or F.col("d.created_at").eqNullSafe(F.col("_s._of"))
    stored = last.select(*KEY, F.struct(*fields, *[F.col("created_at").alias("_of")] * ("created_at" in declared.columns)).alias("_s"))
    both = declared.alias("d").join(stored, KEY, "left")
    written = F.col("_s").isNotNull() & same
    return both.select(*[F.when(written, F.col(f"_s.{c}")).otherwise(F.col(f"d.{c}")).alias(c) if c in fields else c for c in declared.columns])


def start_status_sync(
    results: DataFrame,
    load_declared: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    delay: str,
    seconds: int = status.POLL_SECONDS,
    compact_every: int = 100,
    trigger: Trigger = ALL_NOW,
) -> StreamingQuery:
    """Keep the statuses of all declarations in step with arriving results; `status_table` reads them.

    A poll every `seconds` sees the last result of each probe; a poll's window closes when the watermark (`delay`) passes it.
    Batch N compares what its closed windows show with the statuses before it, and stores only what differs:
    `path/writes/batch=N` has every write with its window, `path/statuses/batch=N` the last one of each declaration.
    A declaration without a result, or with an equal one, is not written and keeps its old check time; results of probes
    that nobody declares are left out. `load_declared` is called once per batch, so declarations may come and go;
    its rows are statuses (`readers.read_statuses`), with created_at where re-created declarations are to begin anew.

    Batch N reads what the batches before it wrote and replaces its own folders, so running it again gives the same.
    Every `compact_every` batches the statuses are merged; the merge of the batches before the last one stays, for a batch that runs
    again.
    """
    spark = results.sparkSession
    polled = status.latest_per_window(results.withWatermark("last_check_time", delay), seconds)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written once: the stateful part runs once per batch, and so does the comparison below.
        batch.write.mode("overwrite").parquet(f"{path}/polled/batch={batch_id}")
        declared = load_declared()
        known = status_table(spark, path, declared, before=batch_id).withColumn("_key", probe_key(F.col("namespace"), F.col("name")))
        keyed = [*KEY, *[c for c in ("created_at",) if c in declared.columns]]
        windows = lookup_join(
            spark.read.parquet(f"{path}/polled/batch={batch_id}"), known.select(F.col("_key").alias("name")), on=["name"], spread_by=["window_index"], how="left_semi"
        )
        writes = status.changes_over_windows(windows, known.select(F.col("_key").alias("name"), *status.STATE))
        named = lookup_join(writes.withColumnRenamed("name", "_key"), known.select("_key", *keyed), on=["_key"], spread_by=["window_start"])
        named.drop("_key").write.mode("overwrite").parquet(f"{path}/writes/batch={batch_id}")
        rows = spark.read.parquet(f"{path}/writes/batch={batch_id}")
        fields = F.struct(*keyed[2:], *status.STATE, "last_check_time")
        last = rows.groupBy(*KEY).agg(F.max_by(fields, F.col("window_start")).alias("_last")).select(*KEY, "_last.*")
        last.write.mode("overwrite").parquet(f"{path}/statuses/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            compact_upserts(spark, f"{path}/statuses", KEY)

    writer = polled.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def read_status_writes(spark: SparkSession, path: str) -> DataFrame:
    """Every status write so far, with the poll window that made it."""
    return spark.read.parquet(f"{path}/writes").drop("batch")
