"""Trending from hourly counters instead of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.config import Settings
from feedloom.functions import signals as G


def hourly_counters(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Per item and hour: ``sum(w)`` and ``sum(w * t)`` with t in hours since the hour began.

    These two sums are enough to evaluate linear recency at any later hour boundary, so the counters are kept
    once and read many times. Works on a batch or, with a watermark ``delay``, on a stream.
    """
    rows = events.where(G.is_meaningful(F.col("type")))
    if delay is not None:
        rows = rows.withWatermark("created_at", delay)
    start = F.window("created_at", "1 hour")
    w = G.event_weight(F.col("type"))
    return (
        rows.groupBy("item_id", start.alias("hour"))
        .agg(
            F.sum(w).alias("mass"),
            F.sum(w * (F.unix_micros("created_at") % F.lit(3_600_000_000)) / F.lit(G.US_PER_HOUR)).alias("moment"),
        )
        .select("item_id", F.col("hour.start").alias("hour"), "mass", "moment")
    )


COUNTERS = "item_id bigint, hour timestamp, mass double, moment double"


def keep_counters(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hourly counters of every micro-batch, each in a partition of its own that a retry overwrites.

    The counters add up, so no event is too late: there is no state and no watermark that could drop one.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        hourly_counters(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(COUNTERS).parquet(folder)
    return rows.groupBy("item_id", "hour").agg(F.sum("mass").alias("mass"), F.sum("moment").alias("moment"))


def engagement_from_counters(counters: DataFrame, s: Settings) -> DataFrame:
    """Engagement at ``s.now``. Exact when ``now`` is on an hour boundary and no event is dated after it."""
    now = G.now_col(s)
    hours_ago = (F.unix_micros(now) - F.unix_micros("hour")) / F.lit(G.US_PER_HOUR)
    inside = counters.where((hours_ago <= s.trending_window_hours) & (hours_ago > 0))
    w = F.lit(float(s.trending_window_hours))
    recency = F.col("mass") * (1 - hours_ago / w) + F.col("moment") / w
    return inside.groupBy("item_id").agg(F.sum(recency).alias("engagement"))


def fallback_feed(engaged: DataFrame, eligible: DataFrame, s: Settings) -> DataFrame:
    """The global list served on a miss. A top-k report: ``orderBy`` + ``limit`` keeps k rows per task."""
    positive = engaged.join(eligible.select("item_id", "creator_id"), "item_id").withColumn("engagement", F.round("engagement", 10))
    return positive.where(F.col("engagement") > 0).orderBy(F.desc("engagement"), "item_id").limit(s.trending_feed_size)
