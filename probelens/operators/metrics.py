"""Counters, latency histogram and health gauge of the result log.

All three come from one pass and one grouping by probe (`probe_metrics`); each operator only reshapes it.
Sums are kept in integer microseconds, so they do not depend on the order of rows. A check without a duration counts
in the results but not in the histogram, whose sum and count are 0 if no check has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets, in seconds, as written in labels.
BUCKETS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10"]

CHECKS_TOTAL = "canary_checks_total"
DURATION = "canary_check_duration_seconds"
HEALTHY = "canary_healthy"
HELP = {
    CHECKS_TOTAL: ("counter", "Finished checks of each probe, split into successes and failures."),
    DURATION: ("histogram", "Seconds from the first request of a check to its last response."),
    HEALTHY: ("gauge", "1 if the latest check of the probe succeeded, else 0."),
}


def _bound_us(bound: str) -> int:
    return round(float(bound) * 1_000_000)


def _routed(results: DataFrame) -> DataFrame:
    return results.where("to_metrics")


def _counts() -> list[Column]:
    return [F.count_if(F.col("healthy")).alias("success"), F.count_if(~F.col("healthy")).alias("failure")]


def _histogram() -> list[Column]:
    buckets = F.array(*[F.count_if(F.col("duration_us") <= _bound_us(b)) for b in BUCKETS])
    return [buckets.alias("buckets"), F.coalesce(F.sum("duration_us"), F.lit(0)).alias("sum_us"), F.count("duration_us").alias("n")]


def _gauge() -> Column:
    return F.max_by(F.col("healthy"), F.struct("last_check_time", "cycle_id")).cast("int").alias("last_healthy")


def probe_metrics(results: DataFrame) -> DataFrame:
    """Everything the metrics need, per probe routed to metrics: one scan, one shuffle of small rows."""
    return _routed(results).groupBy("name").agg(*_counts(), *_histogram(), _gauge())


def metric_days(results: DataFrame) -> DataFrame:
    """The same per day of the check and probe, in a form that merges: `last` orders the gauge. See `merged_metrics`."""
    last = F.max(F.struct("last_check_time", F.col("cycle_id").cast("string").alias("cycle_id"), F.col("healthy").cast("int").alias("healthy"))).alias("last")
    day = F.to_date("last_check_time").alias("day")
    return _routed(results).groupBy("name", day).agg(*_counts(), *_histogram(), last)


def merged_metrics(days: DataFrame) -> DataFrame:
    """Totals of partial metrics: what `probe_metrics` gives for all their results together."""
    buckets = F.array(*[F.sum(F.col("buckets")[i]) for i in range(len(BUCKETS))])
    sums = [F.sum(c).alias(c) for c in ("success", "failure")]
    rest = [buckets.alias("buckets"), F.sum("sum_us").alias("sum_us"), F.sum("n").alias("n"), F.max("last")["healthy"].alias("last_healthy")]
    return days.groupBy("name").agg(*sums, *rest)


def _counter_rows() -> Column:
    def row(result: str) -> Column:
        return F.struct(F.lit(result).alias("result"), F.col(result).alias("value"))

    return F.filter(F.array(row("success"), row("failure")), lambda r: r["value"] > 0)


def checks_total(results: DataFrame) -> DataFrame:
    """Checks by probe and result (success, failure); a pair that never occurred has no row."""
    counted = _routed(results).groupBy("name").agg(*_counts())
    return counted.select("name", F.explode(_counter_rows()).alias("r")).select("name", "r.result", "r.value")


def _bucket_rows() -> Column:
    finite = [F.struct(F.lit(b).alias("le"), F.col("buckets")[i].alias("value")) for i, b in enumerate(BUCKETS)]
    return F.array(*finite, F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("value")))


def check_duration_histogram(results: DataFrame) -> DataFrame:
    """Cumulative buckets in long form, with sum (microseconds) and count of the probe on every row."""
    counted = _routed(results).groupBy("name").agg(*_histogram())
    return counted.select("name", F.explode(_bucket_rows()).alias("b"), "sum_us", "n").select(
        "name", "b.le", "b.value", "sum_us", F.col("n").alias("count")
    )


def healthy_gauge(results: DataFrame) -> DataFrame:
    """1 or 0 by the last check of each probe."""
    return _routed(results).groupBy("name").agg(_gauge()).select("name", F.col("last_healthy").alias("value"))


def label_text(value: Column) -> Column:
    """Label value with backslash, quote and newline escaped."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def number_text(micros: Column) -> Column:
    """Seconds without trailing zeros, exact to the microsecond."""
    whole = F.floor(micros / 1_000_000).cast("long")
    text = F.format_string("%d.%06d", whole, F.pmod(micros, F.lit(1_000_000)))
    return F.regexp_replace(text, r"\.0+$|(\.\d*[1-9])0+$", "$1")


def metric_exposition(results: DataFrame) -> DataFrame:
    """Text lines of all metrics: columns metric, probe, rank (order inside a probe), line.

    Header lines have an empty probe, so sorting by metric, probe and rank gives the text in order. All
    samples come from one grouping. A log without routed results gives no lines at all.
    """
    metrics = probe_metrics(results)
    probe = F.concat(F.lit('probe="'), label_text(F.col("name")), F.lit('"'))

    def sample(metric: str, suffix: str, labels: Column, value: Column) -> Column:
        line = F.concat(F.lit(metric + suffix + "{"), labels, F.lit("} "), value.cast("string"))
        return F.struct(F.lit(metric).alias("metric"), line.alias("line"))

    counters = F.transform(
        _counter_rows(),
        lambda r: sample(CHECKS_TOTAL, "", F.concat(probe, F.lit(',result="'), r["result"], F.lit('"')), r["value"]),
    )
    buckets = F.transform(
        _bucket_rows(),
        lambda b: sample(DURATION, "_bucket", F.concat(probe, F.lit(',le="'), b["le"], F.lit('"')), b["value"]),
    )
    totals = F.array(
        sample(DURATION, "_sum", probe, number_text(F.col("sum_us"))),
        sample(DURATION, "_count", probe, F.col("n")),
        sample(HEALTHY, "", probe, F.col("last_healthy")),
    )
    headers = [
        F.struct(F.lit(metric).alias("metric"), F.lit("").alias("probe"), F.lit(rank).alias("rank"), F.lit(text).alias("line"))
        for metric, (kind, help_text) in HELP.items()
        for rank, text in ((-2, f"# HELP {metric} {help_text}"), (-1, f"# TYPE {metric} {kind}"))
    ]
    samples = F.transform(
        F.concat(counters, buckets, totals),
        lambda s, i: F.struct(s["metric"].alias("metric"), F.col("name").alias("probe"), (i + 1).alias("rank"), s["line"].alias("line")),
    )
    # Every probe brings the headers; copies combine inside tasks, and the log is read once.
    return metrics.select(F.inline(F.concat(F.array(*headers), samples))).distinct()
