"""Catalogue intake: discovery, content dedup, attribution, validation and the outcome report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings


def attribute(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Left join by exact file name. Files without a manifest row keep null creators."""
    return files.join(manifest.select("file_name", "creator_id", "creator_handle"), "file_name", "left")


def unmatched_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows that name no discovered file; pass the whole directory, not a limited slice."""
    return manifest.join(files.select("file_name"), "file_name", "left_anti").select("file_name")


def repeated_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def ingest_outcomes(files: DataFrame, existing: DataFrame, s: Settings) -> DataFrame:
    """One outcome per file.

    ``files``: file_name, checksum, duration_s, width, height, creator_id, creator_handle.
    ``existing``: item_id, checksum, creator_id, creator_handle (unique checksum).

    A file without checksum could not be read. In discovery (file name) order the first valid file of a checksum is ingested and all
    later ones are duplicates, as are files whose content is known already: they are not probed. Files before it that are too long, too
    short or give no positive duration are rejected. An item without attribution takes the first one offered and later different ones conflict.
    These facts per checksum are plain minima, so copies are combined before the shuffle and a checksum that
    holds a third of all files costs one row, not one task.
    """
    offered = F.col("creator_id").isNotNull() | F.col("creator_handle").isNotNull()
    probed = F.coalesce((F.col("duration_s") > 0) & ~F.isnan("duration_s"), F.lit(False))
    reason = (
        F.when(F.col("checksum").isNull(), "unreadable")
        .when(~probed, "probe_failed")
        .when(F.col("duration_s") > s.max_duration_s, "too_long")
        .when(F.col("duration_s") < s.min_duration_s, "too_short")
    )
    valid = reason.isNull()
    offer = F.struct("file_name", "creator_id", "creator_handle")
    firsts = files.where("checksum is not null").groupBy("checksum").agg(
        F.min(F.when(valid, F.col("file_name"))).alias("_first_file"),
        F.min(F.when(offered, offer)).alias("_any_offer"),
        F.min(F.when(offered & valid, offer)).alias("_valid_offer"),
    )
    known = existing.select(
        "checksum", F.col("item_id").alias("existing_item"), F.col("creator_id").alias("_ec"), F.col("creator_handle").alias("_eh")
    )
    rows = files.join(firsts.join(known, "checksum", "left"), "checksum", "left")
    exists = F.col("existing_item").isNotNull()
    rows = rows.withColumn("_offer", F.when(exists, F.col("_any_offer")).otherwise(F.col("_valid_offer")))
    later = F.coalesce(F.col("_first_file") < F.col("file_name"), F.lit(False))
    status = F.when(exists | later, "duplicate").when(reason.isNotNull(), "rejected").otherwise("ingested")
    had = F.col("_ec").isNotNull() | F.col("_eh").isNotNull()
    earlier = F.col("_offer.file_name") < F.col("file_name")
    owner_c = F.when(had, F.col("_ec")).when(earlier, F.col("_offer.creator_id"))
    owner_h = F.when(had, F.col("_eh")).when(earlier, F.col("_offer.creator_handle"))
    owned = F.coalesce(had | earlier, F.lit(False))
    same = owner_c.eqNullSafe(F.col("creator_id")) & owner_h.eqNullSafe(F.col("creator_handle"))
    dup = F.col("status") == "duplicate"
    return (
        rows.withColumn("status", status)
        .withColumn("reason", F.when(F.col("status") == "rejected", reason))
        .withColumn("creator_enriched", dup & offered & ~owned)
        .withColumn("_conflict", dup & offered & owned & ~same)
        .withColumn(
            "warnings",
            F.array_compact(
                F.array(
                    F.when((F.col("status") == "ingested") & (F.col("height") <= F.col("width")), F.lit("not_vertical")),
                    F.when(F.col("_conflict"), F.lit("creator_conflict")),
                )
            ),
        )
        .select("file_name", "checksum", "status", "reason", "warnings", "creator_enriched", "existing_item")
    )


def reconciled_items(existing: DataFrame, files: DataFrame) -> DataFrame:
    """Existing items after backfill: null attribution takes the first offer, anything else stays."""
    offered = F.col("creator_id").isNotNull() | F.col("creator_handle").isNotNull()
    offers = files.where(offered).groupBy("checksum").agg(
        F.min(F.struct("file_name", "creator_id", "creator_handle")).alias("_offer")
    )
    bare = F.col("creator_id").isNull() & F.col("creator_handle").isNull()
    return (
        existing.join(offers, "checksum", "left")
        .withColumn("_c", F.when(bare, F.col("_offer.creator_id")).otherwise(F.col("creator_id")))
        .withColumn("_h", F.when(bare, F.col("_offer.creator_handle")).otherwise(F.col("creator_handle")))
        .select("item_id", "checksum", F.col("_c").alias("creator_id"), F.col("_h").alias("creator_handle"))
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status", F.coalesce("reason", F.lit("-")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.array_contains("warnings", "not_vertical")).alias("not_vertical"),
        F.count_if(F.array_contains("warnings", "creator_conflict")).alias("creator_conflict"),
        F.count_if("creator_enriched").alias("enriched"),
    )


def mapping(outcomes: DataFrame, ids: DataFrame) -> DataFrame:
    """``file_name -> item_id`` for every file whose content has an item, reruns included."""
    return outcomes.join(ids.select("checksum", "item_id"), "checksum").select("file_name", "item_id")
