"""Aggregations over the behaviour log: seen sets, counters, engagement, recent window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions import signals as G


def one_pair(events: DataFrame, user_id, item_id) -> DataFrame:
    return events.where((F.col("user_id") == user_id) & (F.col("item_id") == item_id))


def seen_pairs(events: DataFrame) -> DataFrame:
    """Distinct items per user; any event counts, impressions included."""
    return events.select("user_id", "item_id").distinct()


def seen_counts(seen: DataFrame) -> DataFrame:
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("seen_count"))


def seen_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "item_id").agg(
        F.bool_or(F.col("type") == "like").alias("liked"), F.max("created_at").alias("last_seen_at")
    )


def item_counters(events: DataFrame) -> DataFrame:
    def n(kind: str):
        return F.count_if(F.col("type") == kind)

    return events.groupBy("item_id").agg(
        n("impression").alias("impressions"),
        n("view").alias("views"),
        n("like").alias("likes"),
        n("skip").alias("skips"),
        n("complete").alias("completions"),
        F.sum(F.when(F.col("type").isin("view", "complete"), F.col("watch_ms")).otherwise(F.lit(0))).alias("watch_ms_sum"),
    )


def in_window(events: DataFrame, s: Settings) -> DataFrame:
    """Rows from the last N hours. There is no upper bound: rows dated later than ``now`` stay."""
    start = G.now_col(s) - F.make_interval(hours=F.lit(s.trending_window_hours))
    return events.where(F.col("created_at") >= start)


def engagement(events: DataFrame, s: Settings) -> DataFrame:
    recent = in_window(events, s).where(G.is_meaningful(F.col("type")))
    mass = G.event_weight(F.col("type")) * G.window_recency(F.col("created_at"), G.now_col(s), s.trending_window_hours)
    return recent.groupBy("item_id").agg(F.sum(mass).alias("engagement"))


def popularity(engaged: DataFrame) -> DataFrame:
    """``max(0, e) / max+(e)``; all zero when nothing is positive. The maximum is a one-row aggregate."""
    value = F.greatest(F.lit(0.0), F.col("engagement"))
    top = engaged.agg(F.max("engagement").alias("_top")).withColumn("_k", F.lit(1))
    return (
        engaged.withColumn("_k", F.lit(1))
        .join(F.broadcast(top), "_k")
        .select(
            "item_id", "engagement", F.when(F.col("_top") > 0, value / F.col("_top")).otherwise(F.lit(0.0)).alias("popularity")
        )
    )


def recent_items(events: DataFrame, eligible_ids: DataFrame, s: Settings) -> DataFrame:
    """The last distinct eligible items per user: newest events first, event key on ties.

    Two rank limits, both of which Spark applies before the shuffle, so a user with a long history sends
    only the newest events of each partition.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    window = (
        events.select("user_id", "item_id", "created_at", "event_id")
        .withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= s.fatigue_window_events)
    )
    firsts = window.groupBy("user_id", "item_id").agg(F.min("rn").alias("rn"))
    by_first = Window.partitionBy("user_id").orderBy("rn")
    return (
        firsts.join(eligible_ids.select("item_id"), "item_id", "left_semi")
        .withColumn("position", F.row_number().over(by_first))
        .where(F.col("position") <= s.fatigue_window_items)
        .select("user_id", "item_id", "position")
    )


def recent_repetition(recent: DataFrame, tagged: DataFrame, dim: int) -> DataFrame:
    """Per user: how often each creator and each diversity tag occurs in the recent window.

    The window holds a fixed number of items, so both results are small however long the history is.
    """
    joined = recent.join(tagged.select("item_id", "creator_id", "div_slots"), "item_id")
    in_slot = [F.expr(f"int(count_if(array_contains(div_slots, {i})))") for i in range(dim)]
    return joined.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recent_size"),
        F.array(*in_slot).alias("recent_slots"),
        F.collect_list(F.when(F.length("creator_id") > 0, F.col("creator_id"))).alias("recent_creators"),
    )
