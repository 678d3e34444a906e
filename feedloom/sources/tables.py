"""Binding of the star-schema test tables to the engine's roles.

Each function reads one or two parquet tables and returns a role (events, items, item_tags, ...) with the
engine's column names, so the jobs never see where the rows came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import materialise_all, pin_utc
from feedloom.taxonomy import Taxonomy, neutral


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    mapped = (
        F.when(kind == "view", "view")
        .when(kind == "click", "complete")
        .when(kind == "purchase", "like")
        .when(kind == "error", "skip")
        .when(kind == "signup", "impression")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        mapped.alias("type"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "value",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("label"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue attributes for every part, before the join that decides which parts are items."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("item_id"),
        F.concat(F.lit("item-"), k.cast("string")).alias("external_id"),
        F.when(k % 10 != 0, F.col("p_brand")).alias("creator_id"),
        F.when(k % 10 != 0, F.lower(F.regexp_replace("p_brand", "#", "_"))).alias("creator_handle"),
        F.timestamp_add("DAY", (k % 30).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
        F.when(k % 17 == 0, "failed").otherwise("analyzed").alias("status"),
        F.when(k % 23 == 0, 0).otherwise(1).alias("taxonomy_version"),
        F.when(k % 19 != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p_retailprice") - 900) / 100))).alias(
            "quality_raw"
        ),
        (F.col("p_size") * F.lit(4.0)).alias("duration_s"),
    )


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.lit(1).alias("taxonomy_version"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    return parts(spark, sf_dir).join(ids, "item_id")


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part with the five neutral fields, a confidence map and the catalogue version."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    size = F.col("p_size")
    kind = F.lower("p_type")
    return table(spark, sf_dir, "part").select(
        k.alias("item_id"),
        F.when(k % 23 == 0, 0).otherwise(1).alias("taxonomy_version"),
        F.when(size <= 5, "none").when(size <= 20, "small").when(size <= 35, "medium").when(size <= 45, "large")
        .otherwise("unknown").alias("size_band"),
        F.when(kind == "standard", "other").otherwise(kind).alias("finish"),
        F.when(k % 13 == 0, "unknown").when(F.col("p_retailprice") >= 950, "high").otherwise("low").alias("grade"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(words, F.lit(0)))).alias("trait"),
        F.array(F.get(words, F.lit(1))).alias("object"),
        F.when(k % 2 == 1, F.create_map(F.lit("finish"), F.lit(0.9)))
        .otherwise(F.create_map().cast("map<string,double>")).alias("confidence"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """(items, features of items alone), written once and dealt over all tasks by item.

    Narrow columns make small files, which few tasks read however many rows they hold; whatever is computed per item (vectors, tags) would stay in
    those tasks. Parts that are no items are dropped before anything is computed for them.
    """
    known = items(spark, sf_dir)
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    features = item_features(spark, sf_dir).join(ids, "item_id", "left_semi")
    return materialise_all(known.repartition("item_id"), features.repartition("item_id"))


def vocabulary() -> Taxonomy:
    return neutral()
