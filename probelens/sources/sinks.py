"""Writing results, metrics and statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.text import json_line, rfc3339
from probelens.operators.joins import SALT, salt_of
from probelens.operators.metrics import metric_days, metric_exposition

#: With one file open at a time, which is what a task with one bucket needs, Spark does not sort rows by bucket before it writes.
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def _as_json(results: DataFrame):
    return json_line(
        F.struct(
            "name",
            "healthy",
            F.col("status_code").alias("statusCode"),
            rfc3339(F.col("last_check_time")).alias("lastCheckTime"),
            "message",
            "url",
            F.col("expected_status").alias("expectedStatus"),
        )
    )


def result_lines(results: DataFrame) -> DataFrame:
    """One JSON object per result of a probe routed to lines: column `value`."""
    return results.where("to_lines").select(_as_json(results).alias("value"))


def write_result_lines(results: DataFrame, path: str, mode: str = "error") -> None:
    result_lines(results).write.mode(mode).text(path)


def results_snapshot(latest: DataFrame) -> DataFrame:
    """Latest results as JSON rows, in no order. The array around them is left to the reader."""
    return latest.select("name", _as_json(latest).alias("value"))


def write_exposition(results: DataFrame, path: str, mode: str = "error") -> None:
    """Metric lines as text files; range-partitioned by metric, probe and rank, so the files are in order."""
    lines = metric_exposition(results)
    lines.sort("metric", "probe", "rank").select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_statuses(statuses: DataFrame, path: str, version: int) -> None:
    """Store one version of the status table; writing a version again replaces it."""
    statuses.write.mode("overwrite").parquet(f"{path}/version={version}")


def write_status_changes(changes: DataFrame, path: str, version: int) -> None:
    """Store only the rows a sync changed, under the number of the sync."""
    changes.write.mode("overwrite").parquet(f"{path}/sync={version}")


def write_bucketed(log: DataFrame, table: str, path: str, buckets: int, mode: str = "error") -> None:
    """Store a log of responses or checks in buckets of (probe, salt), as the table `table` with its files below `path`.

    A reader of `readers.read_bucketed` joins it to a probe table of any size without moving its rows. A hot probe
    fills as many buckets as there are salts. Rows move once, to one task a bucket, which writes one file as they come: a task
    that met all buckets would have to sort its rows first, and hold as many of them as its part of the log has.
    """
    spark, spread = log.sparkSession, ["cycle_id", "seq"] if "seq" in log.columns else ["cycle_id"]
    dealt = log.withColumn(SALT, salt_of(spread)).repartition(buckets, "probe", SALT)
    before = spark.conf.get(_OPEN_FILES)
    spark.conf.set(_OPEN_FILES, "1")
    try:
        dealt.write.bucketBy(buckets, "probe", SALT).format("parquet").mode(mode).option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(_OPEN_FILES, before)


def write_metric_days(results: DataFrame, path: str) -> None:
    """Store the partial metrics of the days that `results` has, as partitions `day=...` below `path`.

    A day is replaced as a whole, others stay: give all results of a day, also when one comes late.
    """
    days = metric_days(results).repartition("day")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_result_days(results: DataFrame, path: str, mode: str = "append") -> None:
    """Store a result log by day of the check, for `status.latest_from_days` and `metrics.metric_days`."""
    results.withColumn("day", F.to_date("last_check_time")).write.mode(mode).partitionBy("day").parquet(path)
