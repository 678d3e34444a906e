"""Feed generations as an append-only table: active pointer, retention, guards, pages, refill.

Nothing is mutated. "Active" is the newest generation of a user that was published for the current epoch and
has not expired; retention and clearing are filters over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import RANK_TERMS, SOURCE_ORDER, Settings
from feedloom.functions import signals as G
from feedloom.functions.vectors import half_up


def newest_first(generations: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("published_seq"), F.desc("feed_id"))
    return generations.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= n)


def retained(generations: DataFrame, s: Settings) -> DataFrame:
    """The current generation and the one it replaced."""
    return newest_first(generations, s.feed_generations_kept)


def epochs(recorded: DataFrame) -> DataFrame:
    """Epoch per user: one step per recorded event that can change preferences. Impressions do not count."""
    return recorded.where(G.invalidates_feed(F.col("type"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("epoch"))


def active(generations: DataFrame, current: DataFrame, now: Column, s: Settings) -> DataFrame:
    """Pointer semantics: newest per user, for the current epoch, younger than the pointer TTL."""
    newest = newest_first(generations, 1).drop("age_rank")
    live = newest.where(F.unix_micros(now) - F.unix_micros("generated_at") < s.feed_ttl_seconds * 1_000_000)
    joined = live.join(current.withColumnRenamed("epoch", "_now_epoch"), "user_id", "left")
    return joined.where(F.col("epoch") == F.coalesce("_now_epoch", F.lit(0))).drop("_now_epoch")


def expired_status(generations: DataFrame, now: Column) -> DataFrame:
    return generations.withColumn("status", F.when(F.col("expires_at") > now, "ready").otherwise("gone"))


def guard_jobs(jobs: DataFrame, current: DataFrame, live: DataFrame) -> DataFrame:
    """``jobs`` (user_id, epoch, reason) with a verdict: ``stale``, ``already_built`` or ``build``.

    Run before ranking to save the work and again before publishing, because the world may have moved.
    Refill and prewarm ask for a new generation while one is live, so only miss and invalidation can be satisfied.
    """
    have = live.select("user_id", F.col("epoch").alias("_live"))
    joined = jobs.join(current.withColumnRenamed("epoch", "_current"), "user_id", "left").join(have, "user_id", "left")
    verdict = (
        F.when(F.col("epoch") != F.coalesce("_current", F.lit(0)), "stale")
        .when(F.col("reason").isin("miss", "invalidation") & (F.col("_live") == F.col("epoch")), "already_built")
        .otherwise("build")
    )
    return joined.withColumn("verdict", verdict).drop("_current", "_live")


def request_keys(requests: DataFrame) -> DataFrame:
    """One build per (user, epoch), one refill per (user, feed)."""
    key = F.when(F.col("reason") == "refill", F.concat_ws(":", F.lit("refill"), "user_id", "feed_id")).otherwise(
        F.concat_ws(":", F.lit("build"), "user_id", F.col("epoch").cast("string"))
    )
    return requests.withColumn("dedup_key", key)


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """The smallest request per key; a plain minimum, so repeats combine before the shuffle."""
    keyed = request_keys(requests)
    cols = [c for c in requests.columns if c != "request_id"]
    return keyed.groupBy("dedup_key").agg(F.min(F.struct("request_id", *cols)).alias("r")).select("r.*", "dedup_key")


def pages(requests: DataFrame, generations: DataFrame) -> DataFrame:
    """Batch form of a feed read. ``requests``: request_id, user_id, feed_id, offset, page_size."""
    g = generations.select("user_id", "feed_id", "items", "candidate_shortage", F.lit(True).alias("_found"))
    joined = requests.join(g, ["user_id", "feed_id"], "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    served = F.slice("items", F.col("offset") + 1, F.col("page_size"))
    nxt = F.col("offset") + F.col("served")
    return (
        joined.withColumn("status", F.when(F.col("_found"), "ready").otherwise("gone"))
        .withColumn("page", F.when(F.col("_found"), served))
        .withColumn("served", F.when(F.col("_found"), F.size("page")).otherwise(F.lit(0)))
        .withColumn("total", n)
        .withColumn("has_more", nxt < n)
        .withColumn("next_offset", F.when(F.col("has_more"), nxt))
        .withColumn("remaining", F.greatest(F.lit(0), n - nxt))
    )


def needs_refill(served: DataFrame, s: Settings) -> DataFrame:
    return served.where(
        (F.col("status") == "ready")
        & (F.col("remaining") <= s.refill_watermark)
        & ~F.coalesce("candidate_shortage", F.lit(False))
        & (F.col("total") > 0)
    )


def clear(generations: DataFrame, users: DataFrame) -> DataFrame:
    return generations.join(users.select("user_id"), "user_id", "left_anti")


def bump_epochs(current: DataFrame, affected: DataFrame) -> DataFrame:
    """Taxonomy change: every affected user moves one epoch on, users without an epoch start from 0."""
    hit = affected.select("user_id").distinct().withColumn("_hit", F.lit(1))
    return current.join(hit, "user_id", "full").select(
        "user_id", (F.coalesce("epoch", F.lit(0)) + F.coalesce("_hit", F.lit(0))).alias("epoch")
    )


def assemble(selected: DataFrame, diagnostics: DataFrame, jobs: DataFrame, seq: int, now: str, s: Settings) -> DataFrame:
    """Generations ready to append. The id is a function of user, epoch and sequence, so a retry writes the same row.

    A job whose user has no candidates still publishes an empty feed.
    """
    items = selected.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "creator_id"))).alias("_i")
    )
    at = F.lit(now).cast("timestamp")
    keep = s.feed_ttl_seconds * s.feed_retention_factor
    return (
        jobs.select("user_id", "epoch")
        .distinct()
        .join(items, "user_id", "left")
        .join(diagnostics.select("user_id", "cold_start", "candidate_shortage", "diversity_relaxed"), "user_id", "left")
        .select(
            F.sha2(F.concat_ws("|", "user_id", "epoch", F.lit(seq)), 256).alias("feed_id"),
            "user_id",
            F.col("epoch").cast("bigint").alias("epoch"),
            F.lit(seq).cast("bigint").alias("published_seq"),
            at.alias("generated_at"),
            F.timestamp_add("SECOND", F.lit(keep), at).alias("expires_at"),
            F.coalesce("cold_start", F.lit(True)).alias("cold_start"),
            F.coalesce("candidate_shortage", F.lit(True)).alias("candidate_shortage"),
            F.coalesce("diversity_relaxed", F.lit(False)).alias("diversity_relaxed"),
            F.coalesce(
                F.transform("_i", lambda x: F.struct(x["item_id"].alias("item_id"), x["rank"].alias("rank"), x["creator_id"].alias("creator_id"))),
                F.array().cast("array<struct<item_id:bigint,rank:int,creator_id:string>>"),
            ).alias("items"),
        )
    )


def _r4(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(half_up(x, 4))


EXPLAINED = ("content_similarity", "tag_affinity", "affinity", "creator_affinity", "popularity", "freshness", "fatigue", "exploration", "quality")


def explanations(selected: DataFrame, scored: DataFrame) -> DataFrame:
    """The sidecar rows of a feed: every term rounded to four digits, projected from the same ranking pass."""
    s = scored.drop("creator_id", "base_score", "vector")
    joined = selected.join(s, ["user_id", "item_id"])
    return joined.select(
        "user_id", "item_id", "rank", "sources", "creator_handle", "external_id", F.col("div_tags").alias("tags"),
        *[_r4(F.col(c)).alias(c) for c in EXPLAINED],
        "quality_available",
        *[_r4(F.col(f"weighted.{t}")).alias(f"w_{t}") for t in RANK_TERMS],
        *[_r4(F.col(c)).alias(c) for c in ("base_score", "diversity_penalty", "final_score")],
        "relaxed",
    )


def sidecar_header(diagnostics: DataFrame, s: Settings) -> DataFrame:
    """Counts and the weights in force, one row per user."""
    weights = F.struct(*[F.lit(-s.rank_weights[t] if t == "fatigue" else s.rank_weights[t]).alias(t) for t in RANK_TERMS])
    return diagnostics.select(
        "user_id", "cold_start", F.struct(*[F.col(f"n_{x}").alias(x) for x in SOURCE_ORDER]).alias("candidate_counts"),
        "unique_candidates", "eligible_items", "seen_count", "candidate_shortage", "diversity_relaxed", "relaxed_count",
        weights.alias("weights"),
    )
