"""Declarations and secrets as a stream of changes: the probe set is rebuilt once per micro-batch that changes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probelens import schemas
from probelens.operators import auth, specs
from probelens.streaming.streams import ALL_NOW, Trigger, compact_upserts, read_upserts, upsert_tables

KEY = ["kind", "namespace", "name"]
ORDER = ["at", "seq"]


def without_values(data: Column) -> Column:
    """A secret's keys alone; what is kept of a secret."""
    return F.transform_values(data, lambda key, value: F.lit(None).cast("string"))


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each key by time and number, combined before the shuffle; secret values are gone."""
    rest = [c for c in schemas.DECLARATION_EVENTS.names if c not in KEY]
    lean = events.withColumn("data", without_values(F.col("data")))
    return lean.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_last")).select(*KEY, "_last.*")


def declared_now(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations and secrets that exist, from the last event of each key."""
    there = state.where(~F.col("op").eqNullSafe("delete"))
    canaries = there.where("kind = 'canary'").select(schemas.CANARIES.names)
    return canaries, there.where("kind = 'secret'").select(schemas.SECRETS.names)


def start_probe_feed(events: DataFrame, path: str, checkpoint: str, compact_every: int = 100, trigger: Trigger = ALL_NOW) -> StreamingQuery:
    """Keep the probe set and the credential ids in step with a stream of `schemas.DECLARATION_EVENTS`.

    `path/events/batch=N` holds the last event of every key that batch N changed. Deleted keys stay as tombstones, so an event that
    is older than the last one of its key changes nothing, whenever it arrives, and neither does one that is repeated; a
    later one creates the key again. A batch with a change rebuilds the whole set, once however many events it has:
    `path/probes/batch=N` and `path/credentials/batch=N` (ids). Others write no set. A change of a secret thereby
    reaches all declarations that refer to it. Values of secrets are dropped on arrival and never stored.

    Batch N reads the events before it and replaces its own folders, so running it again gives the same. `read_probe_feed`
    gives the newest set; it is what `streams.start_probe_reload` may load.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived, stored = last_events(batch), f"{path}/events"
        if upsert_tables(spark, stored, batch_id):
            known = read_upserts(spark, stored, KEY, batch_id).select(*KEY, F.struct(*ORDER).alias("_known"))
            both = arrived.join(known, KEY, "left")
            arrived = both.where(F.col("_known").isNull() | (F.struct(*ORDER) > F.col("_known"))).select(schemas.DECLARATION_EVENTS.names)
        arrived.write.mode("overwrite").parquet(f"{stored}/batch={batch_id}")
        if batch_id and spark.read.parquet(f"{stored}/batch={batch_id}").isEmpty():
            return
        canaries, secrets = declared_now(read_upserts(spark, stored, KEY, batch_id + 1))
        valid = specs.valid_canaries(specs.spec_defaults(canaries))
        auth.probes_with_auth(valid, secrets).write.mode("overwrite").parquet(f"{path}/probes/batch={batch_id}")
        auth.credential_store(valid, secrets).write.mode("overwrite").parquet(f"{path}/credentials/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            compact_upserts(spark, stored, KEY)

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def read_probe_feed(spark: SparkSession, path: str, table: str = "probes") -> DataFrame:
    """The newest probe set of a feed, or the newest `credentials`."""
    kinds = upsert_tables(spark, f"{path}/{table}")
    if not kinds:
        raise FileNotFoundError(f"no {table} below {path}")
    return spark.read.parquet(f"{path}/{table}/batch={kinds[-1][1]}")
