"""Five candidate sources for all users at once, their union and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.config import SOURCE_ORDER, Settings
from feedloom.functions import signals as G
from feedloom.functions import vectors as V
from feedloom.operators import history as H
from feedloom.operators import pairwise
from feedloom.operators.profiles import preferred_tags
from feedloom.operators.ranked_lists import list_positions, take_unseen
from feedloom.taxonomy import NOT_A_PREFERENCE, Taxonomy


def user_base(profiles: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, vector, is_cold_start, seen_count) for every user with a profile, a default one included."""
    return (
        profiles.select("user_id", "vector", "is_cold_start")
        .join(H.seen_counts(seen), "user_id", "left")
        .withColumn("seen_count", F.coalesce("seen_count", F.lit(0)))
    )


def personalised(base: DataFrame) -> DataFrame:
    """Users whose profile may steer retrieval: warm and not the zero vector."""
    return base.where(~F.col("is_cold_start") & ~V.is_zero(F.col("vector")))


def similar_source(base: DataFrame, eligible: DataFrame, seen: DataFrame, size: pairwise.Sizes, s: Settings) -> DataFrame:
    k = s.source_limits["similar"]
    users = personalised(base).select("user_id", "vector", (F.col("seen_count") + k).alias("need"))
    scored = pairwise.nearest_items(users, eligible.select("item_id", "vector"), size, s)
    return pairwise.unseen_top(scored, seen, k)


def explore_source(base: DataFrame, eligible: DataFrame, seen: DataFrame, size: pairwise.Sizes, s: Settings) -> DataFrame:
    k = s.source_limits["explore"]
    users = base.select("user_id", "seen_count")
    return pairwise.top_hashed(users, eligible.select("item_id"), seen, s.now[:10], k, size, s)


TRENDING_KEY, FRESH_KEY = "trending", "fresh"


def trending_rows(eligible: DataFrame) -> DataFrame:
    """Positive engagement only; items without events in the window have none."""
    return eligible.where(F.round("engagement", 10) > 0).select(
        F.lit(TRENDING_KEY).alias("list_key"), F.round("engagement", 10).alias("key"), "item_id"
    )


def fresh_rows(eligible: DataFrame) -> DataFrame:
    return eligible.select(
        F.lit(FRESH_KEY).alias("list_key"), F.unix_micros("created_at").cast("double").alias("key"), "item_id"
    )


def tag_rows(eligible: DataFrame) -> DataFrame:
    """One posting per (preference tag, item), keyed by the tag's slot; inside a tag the order is the item id."""
    return eligible.select(F.explode("tag_slots").alias("slot"), "item_id").select(
        F.concat(F.lit("slot-"), F.col("slot").cast("string")).alias("list_key"), F.lit(0.0).alias("key"), "item_id"
    )


def list_sources(
    base: DataFrame,
    eligible: DataFrame,
    seen: DataFrame,
    tax: Taxonomy,
    size: pairwise.Sizes,
    s: Settings,
    which: tuple[str, ...] = ("tag", "trending", "fresh"),
) -> DataFrame:
    """Tag, trending and fresh sources: one sort builds all lists, one pass takes from them.

    ``eligible`` carries ``created_at``, ``engagement`` and ``tag_slots``. Tag source order: the user's strongest matching tag
    first, then item id.
    """
    rows, asks = [], []

    def ask(users: DataFrame, source: str, list_key, priority, alone: bool = True) -> None:
        names = [F.lit(source).alias("source"), list_key.alias("list_key"), priority.alias("priority"), F.lit(alone).alias("alone")]
        asks.append(users.select("user_id", *names, "seen_count"))

    if "trending" in which:
        rows.append(trending_rows(eligible))
        ask(base, "trending", F.lit(TRENDING_KEY), F.lit(0))
    if "fresh" in which:
        rows.append(fresh_rows(eligible))
        ask(base, "fresh", F.lit(FRESH_KEY), F.lit(0))
    if "tag" in which:
        rows.append(tag_rows(eligible))
        warm = base.where(~F.col("is_cold_start"))
        wanted = preferred_tags(warm, tax.slot_names, NOT_A_PREFERENCE, s.preferred_tags, ("seen_count",))
        ask(wanted, "tag", F.concat(F.lit("slot-"), F.col("slot").cast("string")), F.col("tag_rank"), False)
    lists, requests = rows[0], asks[0]
    for r, a in zip(rows[1:], asks[1:]):
        lists, requests = lists.unionByName(r), requests.unionByName(a)
    ordered = list_positions(lists, [F.desc("key"), F.col("item_id")], size.items, s.list_head)
    return take_unseen(requests, ordered, seen, tax.dim + 2, size.items, {k: s.source_limits[k] for k in which}, s, size.users)


def source_bit(source: Column) -> Column:
    return F.coalesce(*[F.when(source == x, F.lit(1 << i)) for i, x in enumerate(SOURCE_ORDER)])


def source_bits(per_source: DataFrame) -> DataFrame:
    """One row per (user, item) with one bit per source that produced it.

    Every source draws from eligible items alone, so nothing is joined here: the rows combine before their one exchange, on (user, item).
    """
    return per_source.groupBy("user_id", "item_id").agg(F.bit_or(source_bit(F.col("source"))).alias("bits"))


def union_sources(per_source: DataFrame) -> DataFrame:
    """One row per (user, item) with every source that produced it, in fixed order."""
    names = [F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(SOURCE_ORDER)]
    return source_bits(per_source).select("user_id", "item_id", F.array_compact(F.array(*names)).alias("sources"))


def candidate_counts(base: DataFrame, candidates: DataFrame, eligible: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """Per user: rows per source, unique candidates, eligible and seen counts, and whether the corpus ran short. ``candidates`` name their sources or have their bits."""

    def has(i: int, source: str):
        return F.col("bits").bitwiseAND(F.lit(1 << i)) != 0 if "bits" in candidates.columns else F.array_contains("sources", source)

    per_user = candidates.groupBy("user_id").agg(
        *[F.count_if(has(i, x)).alias(f"n_{x}") for i, x in enumerate(SOURCE_ORDER)],
        F.count(F.lit(1)).alias("unique_candidates"),
    )
    seen_eligible = (
        seen.join(eligible.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("_se"))
    )
    total = eligible.agg(F.count(F.lit(1)).alias("eligible_items")).withColumn("_k", F.lit(1))
    filled = [f"n_{x}" for x in SOURCE_ORDER] + ["unique_candidates"]
    return (
        base.select("user_id", "seen_count", F.lit(1).alias("_k"))
        .join(F.broadcast(total), "_k")
        .join(per_user, "user_id", "left")
        .join(seen_eligible, "user_id", "left")
        .select(
            "user_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in filled],
            "eligible_items",
            "seen_count",
            (F.col("eligible_items") - F.coalesce("_se", F.lit(0)) < limit).alias("candidate_shortage"),
        )
    )


def generate(base: DataFrame, eligible: DataFrame, seen: DataFrame, tax: Taxonomy, size: pairwise.Sizes, s: Settings) -> dict[str, DataFrame]:
    """All five sources as independent frames; callers write them side by side and union them."""
    cols = ["user_id", "item_id", "source"]
    return {
        "listed": list_sources(base, eligible, seen, tax, size, s).select(*cols),
        "similar": similar_source(base, eligible, seen, size, s).withColumn("source", F.lit("similar")).select(*cols),
        "explore": explore_source(base, eligible, seen, size, s).withColumn("source", F.lit("explore")).select(*cols),
    }
