"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without the setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corpus-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_dir(spark: SparkSession, label: str) -> str:
    """A folder below the shared one for this run alone."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, readable after executors are lost."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they don't find it on their path."""
    package = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_corpus_code", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="code-")) / "corpus_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._corpus_code = True


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep what a Python worker gets at once small, also where texts are long; make the package known to it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def parts_of(spark: SparkSession) -> int:
    """How many parts a hashed key space is cut into: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
