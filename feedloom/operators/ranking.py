"""Ranking features and the weighted score, one row per (user, candidate)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import RANK_TERMS, SOURCE_ORDER, Settings
from feedloom.operators import newcomers, user_slices
from feedloom.operators.candidates import source_bit
from feedloom.operators.pairwise import Sizes

FEATURES = (
    "content_similarity", "tag_affinity", "affinity", "creator_affinity", "popularity", "freshness", "fatigue",
    "exploration", "quality", "quality_available",
)
SCORE_DIGITS = 12


def source_bits(sources: Column) -> Column:
    return reduce(add, (F.when(F.array_contains(sources, x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(SOURCE_ORDER)))


def source_names(bits: Column) -> Column:
    """The names behind ``bits``, looked up among all possible lists: they are few, and a list is not built again for every row."""
    lists = [[x for i, x in enumerate(SOURCE_ORDER) if b >> i & 1] for b in range(1 << len(SOURCE_ORDER))]
    return F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists]), bits)


def score_candidates(
    candidates: DataFrame,
    items: DataFrame,
    profiles: DataFrame,
    affinity: DataFrame,
    repetition: DataFrame,
    s: Settings,
    newcomers: bool = False,
    size: Sizes | None = None,
) -> DataFrame:
    """Seven weighted terms per candidate; of ``sources``, the names in ``SOURCE_ORDER`` are kept. Candidates may also be a row per ``source``.

    Candidates go to slices of users as bare ids, see ``user_slices``. A user without history costs one narrow row there, so ``newcomers`` (many
    users are cold and have no recent items) changes nothing; ``score_newcomers`` makes and scores all candidates of such users without moving any.
    """
    size = size or Sizes.of(profiles, items)
    bits = source_bits(F.col("sources")) if "sources" in candidates.columns else F.coalesce(source_bit(F.col("source")), F.lit(0))
    asked = candidates.select("user_id", "item_id", bits.alias("bits"))
    terms = user_slices.scored_terms(asked, items, profiles, affinity, repetition, size.users, size.items, s)
    return _weighted(terms.withColumn("sources", source_names(F.col("bits"))).drop("bits"), s)


def score_newcomers(users: DataFrame, items: DataFrame, s: Settings, size: Sizes) -> DataFrame:
    """The candidates of ``users`` (user_id) without history and their scores, as ``score_candidates`` would return them."""
    terms = newcomers.scored_terms(users, items, size, s)
    return _weighted(terms.withColumn("sources", source_names(F.col("bits"))).drop("bits"), s)


def _weighted(terms: DataFrame, s: Settings) -> DataFrame:
    featured = terms.withColumn("affinity", (F.col("content_similarity") + F.col("tag_affinity")) / 2)
    weighted = [
        (F.lit(-s.rank_weights[t] if t == "fatigue" else s.rank_weights[t]) * F.col(t)).alias(t) for t in RANK_TERMS
    ]
    scored = featured.withColumn("weighted", F.struct(*weighted))
    return scored.withColumn(
        "base_score", F.round(reduce(add, (F.col(f"weighted.{t}") for t in RANK_TERMS)), SCORE_DIGITS)
    )


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Score descending, item id ascending."""
    w = Window.partitionBy("user_id").orderBy(F.desc("base_score"), "item_id")
    return scored.withColumn("base_rank", F.row_number().over(w))


def top_reasons(weighted: Column, sign: int, n: int) -> Column:
    """The named terms that moved a score most in one direction (beyond 0.001), strongest first."""
    entries = F.array(*[F.struct((weighted[t] * -sign).alias("key"), F.lit(t).alias("term"), weighted[t].alias("value")) for t in RANK_TERMS])
    kept = F.slice(F.array_sort(F.filter(entries, lambda e: e["key"] < -0.001)), 1, n)
    return F.transform(kept, lambda e: F.struct(e["term"], e["value"]))


def overlap(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of users, ``lists`` (user_id, items): shared count, same-order flag."""
    left = lists.select(F.col("user_id").alias("a"), F.col("items").alias("items_a"))
    right = lists.select(F.col("user_id").alias("b"), F.col("items").alias("items_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(
            "a", "b",
            F.size(F.array_intersect("items_a", "items_b")).alias("shared"),
            F.size("items_a").alias("size_a"),
            (F.col("items_a") == F.col("items_b")).alias("identical"),
        )
    )
