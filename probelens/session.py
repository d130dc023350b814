"""Session settings the operators rely on, and the shared scratch folder of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

REQUIRED_CONF = {
    # These change results, not only speed.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key is legal in a response body; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # The JVM never compiles longer methods; without whole-stage code Spark splits the verdicts of all kinds of probes.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need. Safe to call again."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def run_dir(spark: SparkSession, label: str) -> str:
    """A folder for one run below the shared folder; never reused."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
