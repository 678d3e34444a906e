"""Streaming intake of interactions: validation, references, idempotence, epochs, coalescing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions import signals as G
from feedloom.operators.validation import check_interactions, check_references
from feedloom.session import materialise
from feedloom.sources.read import read_or_empty
from feedloom.sources.sinks import append_events


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, fmt: str = "json", **options) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def validated(rows: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``reasons`` and ``reference_error`` on every row. Ids are compared as text, since rows that break a rule may hold anything."""
    known = [ids.select(F.col(c).cast("string").alias(c)) for ids, c in ((users, "user_id"), (items, "item_id"))]
    return check_references(check_interactions(rows), *known)


def within_watermark(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cheap first pass: drops repeats of a key that arrive within ``delay`` of each other. Keyless rows bypass it.

    The watermark runs over the time of arrival (the trigger's, which a restart repeats), so no row is ever too late, whatever its own date, and
    keys are forgotten as time goes on. What it forgets, ``exact_intake`` still knows.
    """
    arrived = "_arrived_at"
    keyed = stream.where(F.col("event_id").isNotNull()).withColumn(arrived, F.current_timestamp()).withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["event_id"])
    return keyed.drop(arrived).unionByName(stream.where(F.col("event_id").isNull()))


def exact_intake(
    stream: DataFrame, log_path: str, schema: str, checkpoint: str, on_batch=None, trigger: dict | None = None, order: tuple[str, ...] = ()
) -> StreamingQuery:
    """Append each key once for ever: every micro-batch is compared with the log's key index before it is written.

    A watermark forgets; the index does not. ``on_batch(recorded, batch_id)`` sees only rows that were recorded, and sees the
    same rows again if the batch is retried. Checkpoint and batch number name the batch's partition of the log.
    """

    source = _source_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        recorded = append_events(batch.sparkSession, log_path, batch, schema, f"{source}-{batch_id}", order)
        if on_batch is not None:
            on_batch(recorded, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _source_name(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def quarantined_intake(
    stream: DataFrame, references: Callable[[SparkSession], tuple[DataFrame, DataFrame]], log_path: str, quarantine_path: str, schema: str, checkpoint: str,
    on_batch=None, trigger: dict | None = None, order: tuple[str, ...] = (),
) -> StreamingQuery:
    """Validated intake of raw interactions (ids as text): accepted rows go to the log once per key, all others to the quarantine with their reasons.

    ``references(spark)`` gives the tables of users (user_id) and items (item_id) and is asked anew for every micro-batch, so ids that appear
    later are known from the next trigger on. Each batch is checked once, against one state of the references, and both sinks read
    that result. A sink replaces its partition of the batch whole: if the second write or ``on_batch`` fails, the retried batch leaves exactly what a
    single run would have. A key counts as used only by a row that was accepted. The log keeps the columns of ``schema``, cast to its types.
    """
    source = _source_name(checkpoint)
    wanted = T.StructType.fromDDL(schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dealt = batch.repartition("event_id", "user_id", "item_id")  # a micro-batch may be one row group of one file, which one task would check
        checked = materialise(validated(dealt, *references(spark)))
        good = (F.size("reasons") == 0) & F.col("reference_error").isNull()
        extra = [c for c in order if c not in wanted.names]
        accepted = checked.where(good).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted], *extra)
        recorded = append_events(spark, log_path, accepted, schema, f"{source}-{batch_id}", order)
        checked.where(~good).write.mode("overwrite").parquet(f"{quarantine_path}/batch=b-{source}-{batch_id}")
        if on_batch is not None:
            on_batch(recorded, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_quarantine(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rejected rows: the raw columns of ``schema``, then ``reasons``, ``reference_error`` and the batch."""
    return read_or_empty(spark, path, f"{schema}, reasons array<string>, reference_error string, batch string")


def epoch_steps(recorded: DataFrame) -> DataFrame:
    """Steps per user in one micro-batch: recorded, preference-changing events only."""
    return recorded.where(G.invalidates_feed(F.col("type"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"))


def coalesced_rebuilds(stream: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """One rebuild request per burst of preference-changing events of a user."""
    return (
        stream.where(G.invalidates_feed(F.col("type")))
        .withWatermark("created_at", delay)
        .groupBy("user_id", F.session_window("created_at", gap).alias("burst"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_id", F.col("burst.start").alias("first_at"), F.col("burst.end").alias("closes_at"), "n_events")
    )


_BURST = "user_id bigint, first_at timestamp, last_at timestamp, n_events bigint"


def merge_bursts(bursts: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Bursts (user_id, first_at, last_at, n_events) of a user that lie less than ``gap`` apart become one.

    Sessions are intervals, so any grouping of the events into partial bursts merges to the same result.
    """
    by_time = Window.partitionBy("user_id").orderBy("first_at", "last_at")
    reach = F.max("last_at").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("first_at") >= reach + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    numbered = bursts.withColumn("_new", starts).withColumn("_burst", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("user_id", "_burst").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n_events").alias("n_events"))
    return merged.drop("_burst")


def keep_bursts(stream: DataFrame, path: str, checkpoint: str, gap: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """The rebuild requests of ``coalesced_rebuilds`` as a stream that no event is too late for.

    Each micro-batch adds its own sessions as a partition of ``path``, combined before the shuffle; a retry replaces it. ``read_bursts`` merges the
    partitions, so an event that arrives after its burst was reported joins it, and may join two bursts into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.where(G.invalidates_feed(F.col("type"))).groupBy("user_id", F.session_window("created_at", gap).alias("_w"))
        sessions = wanted.agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n_events")).drop("_w")
        sessions.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_bursts(spark: SparkSession, path: str, gap: str = "10 minutes") -> DataFrame:
    """(user_id, first_at, last_at, n_events), one row per burst over all micro-batches so far."""
    return merge_bursts(read_or_empty(spark, path, _BURST), gap)
