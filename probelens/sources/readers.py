"""Reading tables. Every reader has a fixed schema; nothing is inferred.

JSON that does not decode is an error when the table is read, and so is a row without its key: a truncated file must not
look like an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelens import schemas


def _retyped(df: DataFrame, target: T.StructType) -> DataFrame:
    """Columns by position in the target's names; nested field names follow through the cast."""
    return df.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, target.fields)])


STRICT = {"mode": "FAILFAST"}


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, or an error where a key is null, whichever columns are read later."""
    text = F.lit(f"a row has no {' or no '.join(keys)}")
    there = F.lit(True)
    for k in keys:
        there &= F.col(k).isNotNull()
    return df.where(F.when(there, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def read_canaries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Declarations of all namespaces: `json` has one manifest per line, `parquet` is our own table."""
    if fmt == "parquet":
        return spark.read.schema(schemas.CANARIES).parquet(path)
    manifest = spark.read.schema(schemas.MANIFEST).json(path, **STRICT)
    flat = manifest.select("metadata.namespace", "metadata.name", "metadata.creationTimestamp", "spec")
    return _keyed(_retyped(flat, schemas.CANARIES), "namespace", "name")


def read_statuses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Statuses written in the same manifests, one row per declaration; null before the first sync."""
    if fmt == "parquet":
        return spark.read.schema(schemas.STATUSES).parquet(path)
    manifest = spark.read.schema(schemas.MANIFEST).json(path, **STRICT)
    flat = manifest.select(
        "metadata.namespace", "metadata.name", "status.phase", "status.lastCheckTime", "status.lastStatus", "status.message"
    )
    return _keyed(_retyped(flat, schemas.STATUSES), "namespace", "name")


def read_probes(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A rendered probe set, one probe per line; no defaults are applied, absent numbers read as 0."""
    if fmt == "parquet":
        return spark.read.schema(schemas.PROBES).parquet(path)
    probes = _keyed(_retyped(spark.read.schema(schemas.PROBES_JSON).json(path, **STRICT), schemas.PROBES), "name")
    return probes.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("interval", "expected_status")})


def read_credentials(spark: SparkSession, path: str | None, fmt: str = "json") -> DataFrame:
    """Credentials as (credential_id, value); no path is an empty store, a path that does not exist an error."""
    if path is None:
        return spark.createDataFrame([], schemas.CREDENTIALS)
    return _keyed(_loaded(spark, schemas.CREDENTIALS, path, fmt), "credential_id")


def read_secrets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _keyed(_loaded(spark, schemas.SECRETS, path, fmt), "namespace", "name")


def _loaded(spark: SparkSession, schema: T.StructType, path: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path, **(STRICT if fmt == "json" else {}))


def read_exchanges(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """The log of recorded responses, as a table or as a stream of arriving files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.EXCHANGES).format(fmt).load(path, **(STRICT if fmt == "json" else {}))


def read_cycles(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.CHECK_CYCLES).format(fmt).load(path, **(STRICT if fmt == "json" else {}))


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Results from JSON: each file one array (a snapshot), or one object per line."""
    reader = spark.read.schema(schemas.RESULTS_JSON)
    return _keyed(_retyped(reader.json(path, multiLine=not lines, **STRICT), schemas.RESULTS), "name")


def _checked_array(text: Column) -> Column:
    """The text if it is one JSON array of objects with names and nothing else, or an error."""
    names = F.from_json(text, "array<struct<name: string>>")
    # the parser accepts text after the document; brackets around it make that a second element
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    array = F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY<")
    sound = F.coalesce(one & array & F.forall(names, lambda r: r["name"].isNotNull()), F.lit(False))
    shown = F.coalesce(F.substring(text, 1, 80), F.lit("null"))
    message = F.concat(F.lit("results do not parse as one JSON array of objects with names: "), shown)
    return F.when(sound, text).otherwise(F.raise_error(message))


def results_from_text(texts: DataFrame, body: str | Column) -> DataFrame:
    """Results from a column that holds such JSON arrays; the other columns are kept.

    A text that is no such array is an error: null or blank, cut off, an object instead of an array, text after the array, an
    element without name. An empty array has no results.
    """
    column = F.col(body) if isinstance(body, str) else body
    array = T.ArrayType(schemas.RESULTS_JSON)
    rows = texts.select("*", F.inline(F.from_json(_checked_array(column), array, STRICT)))
    names = dict(zip(schemas.RESULTS_JSON.names, schemas.RESULTS.names))
    return rows.withColumnsRenamed(names)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A log stored by `sinks.write_bucketed`. Its column `_salt` tells the operators that it need not move."""
    return spark.table(table)


_BAD = "_corrupt_record"


def _flat_results(rows: DataFrame) -> DataFrame:
    return _retyped(rows, schemas.RESULTS)


def _flat_probes(rows: DataFrame) -> DataFrame:
    return _retyped(rows, schemas.PROBES).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("interval", "expected_status")})


def _flat_canaries(rows: DataFrame) -> DataFrame:
    return _retyped(rows.select("metadata.namespace", "metadata.name", "metadata.creationTimestamp", "spec"), schemas.CANARIES)


#: Tables in JSON lines: schema of a line, its key, how it becomes a row, whether its text may be shown.
_LINES = {
    "canaries": (schemas.MANIFEST, ("metadata.namespace", "metadata.name"), _flat_canaries, True),
    "probes": (schemas.PROBES_JSON, ("name",), _flat_probes, True),
    "results": (schemas.RESULTS_JSON, ("name",), _flat_results, True),
    "exchanges": (schemas.EXCHANGES, ("cycle_id", "probe"), lambda rows: rows, True),
    "secrets": (schemas.SECRETS, ("namespace", "name"), lambda rows: rows, False),
    "credentials": (schemas.CREDENTIALS, ("credential_id",), lambda rows: rows, False),
}


def read_with_quarantine(spark: SparkSession, table: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of JSON lines: the rows of the files that are sound, and (file, cause, line, line_chars) for every line that is not.

    One bad line takes its file out as a whole, so that a truncated file never passes for a shorter one; the rest of
    the folder is read. A line is bad if it does not decode or has no key. `line` is null for tables that hold
    secrets. Reading strictly (an error at the first bad line) is what the other readers do.
    """
    schema, keys, flat, shown = _LINES[table]
    whole = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.schema(whole).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD).withColumn("_file", F.col("_metadata.file_path"))
    keyless = F.lit(False)
    for k in keys:
        keyless |= F.col(k).isNull()
    cause = F.when(F.col(_BAD).isNotNull(), "does not decode").when(keyless, f"has no {' or no '.join(keys)}")
    text = F.coalesce(F.col(_BAD), F.to_json(F.struct(*[c for c in schema.names])))
    bad = lines.withColumn("cause", cause).where("cause IS NOT NULL")
    line = text if shown else F.lit(None).cast("string")
    quarantine = bad.select(F.col("_file").alias("file"), "cause", line.alias("line"), F.length(text).alias("line_chars"))
    files = bad.select("_file").distinct()
    return flat(lines.join(files, ["_file"], "left_anti").select(schema.names)), quarantine
