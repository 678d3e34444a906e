"""Queries: stored profiles, refreshed and read; feeds published and read back; a vocabulary change carried through."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.operators import feeds as Z
from feedloom.plans import oracles as O
from feedloom.plans.migration import reencode_and_rebuild
from feedloom.plans.feed_build import PublishedFeeds, build_and_publish
from feedloom.plans.queries_feed import tag_inputs
from feedloom.plans.recommend import recommend
from feedloom.plans.registry import query
from feedloom.plans.stored_profiles import ProfileStore, from_store, read, refresh
from feedloom.session import materialise, shared_folder
from feedloom.sources import tables as T
from feedloom.sources.sinks import append_events

S = Settings()
_LOG = "event_id bigint, user_id bigint, item_id bigint, type string, created_at timestamp"


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _events(spark, d):
    return T.events(spark, d).select("event_id", "user_id", "item_id", "type", "created_at")


def refreshed_store(spark, d, first_now: str = "2024-01-25 00:00:00"):
    """A store built from two thirds of the log as of an earlier day, then refreshed with the last third as of today."""
    folder = scratch(spark)
    store, rows = ProfileStore(folder), _events(spark, d)
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    append_events(spark, f"{folder}/log", rows.where(third < 2), _LOG, "first")
    log = spark.read.schema(f"{_LOG}, batch string").parquet(f"{folder}/log")
    i = tag_inputs(spark, d)
    refresh(store, log, replace(i, s=S.but(now=first_now)))
    append_events(spark, f"{folder}/log", rows.where(third == 2), _LOG, "second")
    log = spark.read.schema(f"{_LOG}, batch string").parquet(f"{folder}/log")
    refresh(store, log, i)
    return store, i


@query(
    """SELECT p.user_id, is_cold_start, interaction_count, effective, skipped_no_features, positive_signal, negative_signal, x.slot, p.v[x.slot + 1] AS weight
       FROM prof p CROSS JOIN tax x""",
    keys="user_id, is_cold_start", ints="interaction_count, effective, skipped_no_features, slot", nums="positive_signal, negative_signal, weight",
)
def profile_refresh(spark, d):
    """Stored profiles after a refresh of the users that changed: equal to profiles built from the whole log."""
    store, i = refreshed_store(spark, d)
    profiles, _ = read(store, spark, i)
    keep = ["user_id", "is_cold_start", "interaction_count", "effective", "skipped_no_features", "positive_signal", "negative_signal"]
    return profiles.select(*keep, F.posexplode("vector").alias("slot", "weight"))


@query("SELECT user_id, creator_id, score, n AS interaction_count FROM affinity", keys="user_id, creator_id", ints="interaction_count", nums="score")
def affinity_refresh(spark, d):
    """Creator affinities of the same store: rows of changed users are replaced, never merged."""
    store, i = refreshed_store(spark, d)
    return read(store, spark, i)[1].select("user_id", "creator_id", "score", "interaction_count")


@query("SELECT * FROM reranked", keys="user_id, item_id, creator_id, relaxed", ints="rank", nums="base_score, diversity_penalty, final_score")
def recommended_stored(spark, d):
    """The diversified list of every user from stored profiles: the log only tells what was seen and what is popular."""
    folder = scratch(spark)
    store, i = ProfileStore(folder), tag_inputs(spark, d)
    refresh(store, _events(spark, d).withColumn("batch", F.lit("all")), i)
    return recommend(from_store(store, i), S.feed_size).selected


# --- published feeds ---


@query(
    f"""SELECT e.user_id, e.epoch, CASE WHEN e.user_id % 2 = 0 THEN 1 ELSE 2 END AS published_seq, r.item_id, r.rank
        FROM (SELECT user_id, count(*) AS epoch FROM ev WHERE {O.WEIGHT} <> 0 GROUP BY 1) e JOIN reranked r USING (user_id)"""
)
def published_feeds(spark, d):
    """Every user's active feed after two builds: the first for half the users, the second for all, which skips those whose feed is live.

    Between them a build that stops before its commit leaves rows that no reader sees.
    """
    i, store = tag_inputs(spark, d), PublishedFeeds(scratch(spark))
    current = materialise(Z.epochs(i.events))
    jobs = current.select("user_id", "epoch", F.lit("invalidation").alias("reason"))
    build_and_publish(jobs.where("user_id % 2 = 0"), i, lambda: current, store, "build-1", 1)
    store.generations(spark).drop("build").withColumn("published_seq", F.lit(9).cast("bigint")).write.parquet(f"{store.folder}/generations/build=stopped")
    build_and_publish(jobs, i, lambda: current, store, "build-2", 2)
    live = store.active(current, i.s.now, i.s)
    return live.select("user_id", "epoch", "published_seq", F.explode("items").alias("x")).select("user_id", "epoch", "published_seq", "x.item_id", "x.rank")


# --- a vocabulary change, carried through ---


@query(
    f"""SELECT p.user_id, p.interaction_count, e.epoch + 1 AS epoch, x.slot, p.v[x.slot + 1] AS weight FROM prof p CROSS JOIN tax x
        JOIN (SELECT p.user_id, count(ev.user_id) AS epoch FROM prof p LEFT JOIN (SELECT * FROM ev WHERE {O.WEIGHT} <> 0) ev USING (user_id) GROUP BY 1) e USING (user_id)""",
    keys="user_id", ints="interaction_count, epoch, slot", nums="weight",
)
def reencoded_profiles(spark, d):
    """Features encoded again, profiles rebuilt from them, epochs moved on: run twice, as after a stop between the steps."""
    i, folder = tag_inputs(spark, d), scratch(spark)
    store = ProfileStore(f"{folder}/profiles")
    log = _events(spark, d).withColumn("batch", F.lit("all"))
    epochs = materialise(Z.epochs(i.events))
    reencode_and_rebuild(f"{folder}/migration", "v1", i, store, log, epochs, stop_after="vectors")
    moved = reencode_and_rebuild(f"{folder}/migration", "v1", i, store, log, epochs)
    profiles, _ = read(store, spark, i)
    return profiles.join(moved, "user_id").select("user_id", "interaction_count", "epoch", F.posexplode("vector").alias("slot", "weight"))
