"""What arrives late, and what arrived last.

Rows below the watermark are dropped inside a stateful operator without a trace. Here a first stream parts them from the others and
stores both; the stateful stream reads only what is on time, so it drops nothing, and every row is accounted for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probelens.operators import evaluate, status
from probelens.streaming.streams import ALL_NOW, STREAM_CYCLE, Trigger

EVENT_TIME = "cycle_started_at"
_MARK = "seen_until TIMESTAMP"


def _mark_before(spark: SparkSession, path: str, batch_id: int):
    """The latest event time that earlier batches brought; null for none."""
    if batch_id == 0:
        return None
    return spark.read.schema(_MARK).parquet(f"{path}/marks/batch={batch_id - 1}").first()["seen_until"]


def start_arrivals(exchanges: DataFrame, probes: DataFrame, path: str, checkpoint: str, delay: str, trigger: Trigger = ALL_NOW) -> StreamingQuery:
    """Part arriving responses by the watermark, `delay` behind the latest check start of the batches before.

    `path/ontime/batch=N`: planned rows that are on time, judged, without bodies. `path/late/batch=N`: the rows that came too late,
    whole, with the watermark they missed; they can be judged by the batch form. `path/counts/batch=N`: rows by probe
    that arrived, and of those the late and the unplanned ones. A row without a check start is late. Batch N reads the mark
    of the one before and replaces its own folders, so running it again gives the same.
    """
    spark = exchanges.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = _mark_before(spark, path, batch_id)
        limit = (F.lit(mark) - F.expr(f"INTERVAL {delay}")).cast("timestamp") if mark is not None else F.lit(None).cast("timestamp")
        marked = batch.withColumn("watermark", limit)
        on_time = F.col(EVENT_TIME).isNotNull() & (F.col("watermark").isNull() | (F.col(EVENT_TIME) >= F.col("watermark")))
        late = marked.where(~on_time)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        judged = evaluate.request_verdicts(marked.where(on_time).drop("watermark"), probes)
        judged.write.mode("overwrite").parquet(f"{path}/ontime/batch={batch_id}")
        kept = spark.read.parquet(f"{path}/ontime/batch={batch_id}").groupBy("probe").agg(F.count(F.lit(1)).alias("on_time"))
        seen = marked.groupBy("probe").agg(F.count(F.lit(1)).alias("arrived"), F.count_if(~on_time).alias("late"), F.max(EVENT_TIME).alias("until"))
        counts = seen.join(kept, ["probe"], "left").withColumn("on_time", F.coalesce("on_time", F.lit(0)))
        counts = counts.withColumn("unplanned", F.col("arrived") - F.col("late") - F.col("on_time"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        until = spark.read.parquet(f"{path}/counts/batch={batch_id}").agg(F.greatest(F.max("until"), F.lit(mark).cast("timestamp")).alias("seen_until"))
        until.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    writer = exchanges.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def stream_arrived_results(spark: SparkSession, path: str, delay: str, files_per_trigger: int | None = None) -> DataFrame:
    """Results from what `start_arrivals` let through below `path`, as a stream: like `streams.stream_exchange_results`, and nothing is
    dropped. With the same `delay` a check is given out when the watermark of the rows on time passes its start."""
    schema = spark.read.parquet(f"{path}/ontime").drop("batch").schema
    reader = spark.readStream.schema(schema)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(f"{path}/ontime/*").withWatermark(EVENT_TIME, delay)
    once = evaluate.first_arrivals(rows, [*STREAM_CYCLE, "seq"], evaluate.VERDICT_ARRIVAL)
    return evaluate.combine_verdicts(once, STREAM_CYCLE).select(evaluate.RESULT_COLUMNS)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came too late, as they were, with the watermark they missed."""
    return spark.read.parquet(f"{path}/late").drop("batch")


def account(spark: SparkSession, path: str, checks: DataFrame) -> DataFrame:
    """By probe: rows that arrived = late + unplanned + emitted + pending. `checks` holds (cycle_id, name) of the checks given out,
    with a verdict or without; pending rows belong to checks that are still open."""
    counts = spark.read.parquet(f"{path}/counts").groupBy("probe").agg(*[F.sum(c).alias(c) for c in ("arrived", "late", "unplanned")])
    done = checks.select("cycle_id", F.col("name").alias("probe"), F.lit(True).alias("_done"))
    rows = spark.read.parquet(f"{path}/ontime").select("cycle_id", "probe").join(done, ["cycle_id", "probe"], "left")
    open_ = rows.groupBy("probe").agg(F.count("_done").alias("emitted"), F.count_if(F.col("_done").isNull()).alias("pending"))
    both = counts.join(open_, ["probe"], "left")
    return both.select("probe", "arrived", "late", "unplanned", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("emitted", "pending")])


def with_arrival(rows: DataFrame) -> DataFrame:
    """Rows of parquet files with `_arrived`: when their file was written, its name, and the row's place in it."""
    return rows.withColumn("_arrived", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index"))


def last_arrived(results: DataFrame) -> DataFrame:
    """Of each probe the result that arrived last, whatever its time; from rows with `_arrived`."""
    return status.latest_results(results, order=["_arrived"]).drop("_arrived")


def start_last_arrivals(results: DataFrame, path: str, checkpoint: str, trigger: Trigger = ALL_NOW) -> StreamingQuery:
    """Last result of each probe by order of arrival, as the table of `streams.read_upserts`.

    `results` comes from `with_arrival`. An older result that arrives later replaces a newer one. The order is the batch and, within
    it, the file and the row's place; no state is kept, a batch writes one row per probe that it has.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last_arrived(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = results.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()
