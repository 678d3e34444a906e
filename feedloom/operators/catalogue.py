"""Eligible items and the one wide item table that ranking and diversity share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions import hashing as X
from feedloom.functions import signals as G
from feedloom.functions import vectors as V
from feedloom.operators.encoding import tag_columns
from feedloom.taxonomy import Taxonomy


def current_vectors(vectors: DataFrame, version: int, dim: int) -> DataFrame:
    """Vectors of the current space with the right length and only finite values."""
    return vectors.where((F.col("taxonomy_version") == version) & V.is_valid(F.col("vector"), dim))


def eligible_items(items: DataFrame, vectors: DataFrame, features: DataFrame, version: int, dim: int) -> DataFrame:
    """Analysed items that have features and a usable current vector. Every filter runs below the joins."""
    return (
        items.where(F.col("status") == "analyzed")
        .drop("taxonomy_version")
        .join(current_vectors(vectors, version, dim).select("item_id", "vector"), "item_id")
        .join(features.select("item_id"), "item_id", "left_semi")
    )


def ranking_items(
    eligible: DataFrame, features: DataFrame, popular: DataFrame, tax: Taxonomy, s: Settings
) -> DataFrame:
    """Per-item terms that do not depend on the user, computed once instead of once per candidate.

    ``popular``: item_id, engagement, popularity of the trending window.
    """
    quality = F.col("quality_raw")
    available = quality.isNotNull() & ~F.isnan(quality)
    return eligible.join(tag_columns(features, tax), "item_id").join(popular, "item_id", "left").select(
        "item_id",
        "creator_id",
        "creator_handle",
        "external_id",
        "created_at",
        "vector",
        V.norm(F.col("vector")).alias("vector_norm"),
        "tag_slots",
        "div_tags",
        "div_slots",
        X.item_codes(F.col("item_id"), s.now[:10]).alias("hash_codes"),
        G.freshness(F.col("created_at"), G.now_col(s), s.freshness_halflife_hours).alias("freshness"),
        F.when(available, F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))).otherwise(F.lit(0.0)).alias("quality"),
        available.alias("quality_available"),
        "engagement",
        F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
    )


def handles_by_creator(items: DataFrame) -> DataFrame:
    """One handle per creator, the smallest, so the answer does not depend on row order."""
    return items.where(F.col("creator_id").isNotNull()).groupBy("creator_id").agg(F.min("creator_handle").alias("creator_handle"))


def work_list(items: DataFrame, features: DataFrame) -> DataFrame:
    """Items still to analyse, in corpus order."""
    todo = items.where(F.col("status") != "analyzed").select("item_id", "external_id", "status")
    done = features.select("item_id").distinct().withColumn("has_features", F.lit(True))
    return (
        todo.join(done, "item_id", "left")
        .withColumn("has_features", F.coalesce("has_features", F.lit(False)))
        .orderBy("external_id", "item_id")
    )


def corpus_page(items: DataFrame, limit: int) -> DataFrame:
    return items.select("item_id", "external_id").orderBy("external_id", "item_id").limit(limit)
