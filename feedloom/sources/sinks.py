"""Sinks. Tables are parquet folders; "upsert" means rewriting only the partitions that change."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import materialise
from feedloom.sources import key_index
from feedloom.sources.read import read_or_empty

BUCKET = "bucket"


def first_of_each(incoming: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Keyed rows once per key: the first by the columns of ``order``, then the smallest. Repeats combine before the shuffle."""
    keyed = incoming.where(F.col("event_id").isNotNull())
    others = [c for c in incoming.columns if c != "event_id"]
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*others).alias("_r")))
    return keyed.groupBy("event_id").agg(first.alias("_f")).select("event_id", "_f._r.*").select(*incoming.columns)


def new_events(log: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``incoming`` the log does not hold yet: keyed rows once per key, keyless rows always. The log side is only its keys."""
    fresh = first_of_each(incoming, order).join(log.select("event_id"), "event_id", "left_anti")
    return fresh.unionByName(incoming.where(F.col("event_id").isNull()))


def key_folder(path: str) -> str:
    return f"{path.rstrip('/')}_keys"


def append_events(spark: SparkSession, path: str, incoming: DataFrame, schema: str, batch: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Append what is new and return it. The log is partitioned by batch and day, and its keys are indexed beside it.

    A named ``batch`` is a partition of its own: a retry compares with the other batches alone, replaces the partition and its part of the key
    index whole, and returns the same rows, so whatever follows the append can be retried as well. It finds known keys through the index and
    opens only the batches that may hold one of them. Without a name the batch gets one of its own, is compared with the log itself, and
    running it again appends nothing; if such a call stops half-way, ``index_log`` brings the index up to date. Of rows that repeat a key inside the
    batch the first by ``order`` stays.
    """
    if batch is not None:
        name = f"b-{batch}"
        repeated = key_index.known_keys(incoming, key_folder(path), name).select(F.col("key").alias("event_id"))
    else:
        name = f"u-{uuid.uuid4().hex}"
        repeated = read_or_empty(spark, path, f"{schema}, batch string")
    fresh = materialise(new_events(repeated, incoming, order))
    fresh.withColumn("day", F.to_date("created_at")).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={name}")
    key_index.add_keys(fresh, key_folder(path), name)
    return fresh


def index_log(spark: SparkSession, path: str, schema: str) -> None:
    """Index the batches of the log whose keys are not in the index yet."""
    log = read_or_empty(spark, path, f"{schema}, batch string")
    there = read_or_empty(spark, key_folder(path), "bucket int, batch string").select("batch").distinct()
    for row in log.where("event_id is not null").select("batch").distinct().join(there, "batch", "left_anti").collect():  # batches that were cut short
        key_index.add_keys(log.where(F.col("batch") == row.batch), key_folder(path), row.batch)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, schema: str, buckets: int = 16) -> None:
    """Insert or replace by ``key``: only buckets that hold a changed key are read back and rewritten."""
    incoming = materialise(bucketed(rows, key, buckets))
    stored = read_or_empty(spark, path, f"{schema}, {BUCKET} INT")
    touched = incoming.select(BUCKET).distinct()
    kept = stored.join(F.broadcast(touched), BUCKET, "left_semi").join(incoming.select(key), key, "left_anti")
    merged = materialise(kept.select(*incoming.columns).unionByName(incoming))
    merged.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def replace_projection(
    spark: SparkSession, path: str, rows: DataFrame, owners: DataFrame, owner: str, schema: str, buckets: int = 16
) -> None:
    """All rows of the given owners are replaced by ``rows``; owners without new rows end up with none.

    The owner list decides which buckets are rewritten, so an owner whose projection became empty is cleared.
    """
    incoming = bucketed(rows, owner, buckets)
    ids = materialise(bucketed(owners.select(owner).distinct(), owner, buckets))
    touched = ids.select(BUCKET).distinct()
    stored = read_or_empty(spark, path, f"{schema}, {BUCKET} INT")
    kept = stored.join(F.broadcast(touched), BUCKET, "left_semi").join(ids.select(owner), owner, "left_anti")
    merged = materialise(kept.select(*incoming.columns).unionByName(incoming))
    emptied = touched.join(merged.select(BUCKET).distinct(), BUCKET, "left_anti")
    merged.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for row in emptied.collect():  # at most ``buckets`` rows
        empty = spark.createDataFrame([], stored.drop(BUCKET).schema)
        empty.write.mode("overwrite").parquet(f"{path}/{BUCKET}={row[BUCKET]}")


def write_predictions(rows: DataFrame, path: str, run: dict[str, str]) -> str:
    """Predictions with run metadata; the run id is a partition, so runs never overwrite each other."""
    run_id = hashlib.sha256("|".join(f"{k}={run[k]}" for k in sorted(run)).encode()).hexdigest()[:16]
    tagged = rows
    for name, value in run.items():
        tagged = tagged.withColumn(name, F.lit(value))
    tagged.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").json(path)
    return run_id


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.select("file_name", "item_id").write.mode("overwrite").json(path)


def publish(generations: DataFrame, path: str, sidecar: DataFrame | None = None, sidecar_path: str | None = None) -> None:
    """Append sidecar rows first, then the generations: a feed that can be read always has its explanation.

    A ``feed_id`` that is there already is left as it is, so a retry adds nothing.
    """
    for rows, folder in ((sidecar, sidecar_path), (generations, path)):
        if rows is not None and folder is not None:
            there = read_or_empty(rows.sparkSession, folder, f"feed_id {rows.schema['feed_id'].dataType.simpleString()}")
            materialise(rows.join(there.distinct(), "feed_id", "left_anti")).write.mode("append").parquet(folder)
