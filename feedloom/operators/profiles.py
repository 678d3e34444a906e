"""Signed, time-decayed user profiles from the behaviour log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions import signals as G
from feedloom.functions import vectors as V


def signal_pairs(events: DataFrame, s: Settings) -> DataFrame:
    """Collapse the log to one row per (user, item) before any vector is joined.

    The sums below are linear in the signal, so the wide vector join sees each pair once and a hot user
    or item costs one row per distinct partner, not one per event. The same rows are the seen set.
    """
    sig = G.signal(F.col("type"), F.col("created_at"), G.now_col(s), s.halflife_days)
    rows = events.select("user_id", "item_id", "type", sig.alias("sig"))
    meaningful = G.is_meaningful(F.col("type"))
    return rows.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(meaningful).alias("n_meaningful"),
        F.count_if(F.col("sig") != 0).alias("n_effective"),
        F.sum("sig").alias("sig"),
        F.sum(F.greatest(F.col("sig"), F.lit(0.0))).alias("pos"),
        F.sum(F.greatest(-F.col("sig"), F.lit(0.0))).alias("neg"),
    )


def history(pairs: DataFrame, items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Signal pairs of known items with the creator and whether a usable vector exists. Still narrow."""
    known = pairs.join(items.select("item_id", "creator_id"), "item_id")
    have = vectors.select("item_id", F.lit(True).alias("has_vector"))
    return known.join(have, "item_id", "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))


def build_profiles(hist: DataFrame, vectors: DataFrame, slot_names: list[str], version: int, s: Settings) -> DataFrame:
    """One row per user. ``vector = sum(signal * v) / max(sum(|signal|), epsilon)``."""
    dim = len(slot_names)
    has = F.col("has_vector")
    flat = hist.join(vectors.select("item_id", F.col("vector").alias("_v")), "item_id", "left").select(
        "user_id",
        "n_events",
        F.when(has, F.lit(0)).otherwise(F.col("n_meaningful")).alias("skipped"),
        F.when(has, F.col("n_effective")).otherwise(F.lit(0)).alias("effective"),
        F.when(has, F.col("pos")).otherwise(F.lit(0.0)).alias("pos"),
        F.when(has, F.col("neg")).otherwise(F.lit(0.0)).alias("neg"),
        F.col("sig"),
        "_v",
    )
    sums = flat.groupBy("user_id").agg(
        F.sum("n_events").alias("interaction_count"),
        F.sum("effective").alias("effective"),
        F.sum("skipped").alias("skipped_no_features"),
        F.sum("pos").alias("positive_signal"),
        F.sum("neg").alias("negative_signal"),
        *V.weighted_sums("_v", "sig", dim),
    )
    total = F.greatest(F.col("positive_signal") + F.col("negative_signal"), F.lit(s.signal_epsilon))
    return (
        sums.withColumn("abs_signal", total)
        .withColumn("vector", V.gather_sums("abs_signal", dim))
        .select(
            "user_id",
            F.lit(version).alias("taxonomy_version"),
            "vector",
            V.tag_affinity(F.col("vector"), slot_names).alias("tag_affinity"),
            "interaction_count",
            "effective",
            "positive_signal",
            "negative_signal",
            "skipped_no_features",
            (F.col("effective") < s.cold_start_min).alias("is_cold_start"),
        )
    )


def with_cold_users(profiles: DataFrame, users: DataFrame, slot_names: list[str], version: int) -> DataFrame:
    """A profile for every user of ``users`` (user_id): those without one get the zero vector and are cold."""
    known = profiles.withColumn("_known", F.lit(True))
    defaults = _cold(slot_names, version)
    kept = [F.when(F.col("_known"), F.col(c)).otherwise(defaults[c].cast(profiles.schema[c].dataType)).alias(c) for c in profiles.columns if c != "user_id"]
    return users.select("user_id").distinct().join(known, "user_id", "left").select("user_id", *kept)


def cold_profiles(users: DataFrame, like: DataFrame, slot_names: list[str], version: int) -> DataFrame:
    """The profiles of ``users`` (user_id), none of whom has one, with the columns of ``like``."""
    defaults = _cold(slot_names, version)
    return users.select(*[F.col(c) if c == "user_id" else defaults[c].cast(like.schema[c].dataType).alias(c) for c in like.columns])


def _cold(slot_names: list[str], version: int) -> dict[str, Column]:
    zero = F.array_repeat(F.lit(0.0), len(slot_names))
    return {
        "taxonomy_version": F.lit(version), "vector": zero, "tag_affinity": V.tag_affinity(zero, slot_names), "interaction_count": F.lit(0), "effective": F.lit(0),
        "positive_signal": F.lit(0.0), "negative_signal": F.lit(0.0), "skipped_no_features": F.lit(0), "is_cold_start": F.lit(True),
    }


def creator_affinity(hist: DataFrame, s: Settings) -> DataFrame:
    """Signed share per (user, creator) on the profile's own denominator. Missing creators are skipped."""
    usable = hist.where(F.col("has_vector") & (F.col("n_effective") > 0))
    per_creator = usable.groupBy("user_id", "creator_id").agg(
        F.sum("sig").alias("sig"), F.sum("n_effective").alias("n"), F.sum(F.col("pos") + F.col("neg")).alias("mass")
    )
    totals = per_creator.groupBy("user_id").agg(F.sum("mass").alias("total"))
    return (
        per_creator.where(F.length("creator_id") > 0)
        .join(totals, "user_id")
        .select(
            "user_id",
            "creator_id",
            (F.col("sig") / F.greatest(F.col("total"), F.lit(s.signal_epsilon))).alias("score"),
            F.col("n").alias("interaction_count"),
        )
    )


def affinity_with_handles(affinity: DataFrame, handles: DataFrame) -> DataFrame:
    return affinity.join(handles, "creator_id", "left")


def profile_slots(profiles: DataFrame, slots: DataFrame) -> DataFrame:
    """``(user_id, slot, field, value, weight)`` for every slot of every profile."""
    exploded = profiles.select("user_id", F.posexplode("vector").alias("slot", "weight"))
    return exploded.join(F.broadcast(slots.select("slot", "field", "value")), "slot")


def preferred_tags(profiles: DataFrame, slot_names: list[str], skip: tuple[str, ...], n: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The strongest positive preferences per user, ranked; ties go to the lower slot.

    Everything needed sits in the profile row, so this is a projection: no join and no window.
    """
    names = V.literal_names(slot_names)
    allowed = F.expr("array(" + ", ".join(str(x.split(":", 1)[1] not in skip).lower() for x in slot_names) + ")")
    entries = F.transform(
        F.arrays_zip(F.col("vector").alias("w"), names.alias("tag"), allowed.alias("ok")),
        lambda t, i: F.struct((-F.round(t["w"], 12)).alias("neg"), i.alias("slot"), t["tag"].alias("tag"), t["w"], t["ok"]),
    )
    best = F.slice(F.array_sort(F.filter(entries, lambda t: (t["w"] > 0) & t["ok"])), 1, n)
    return profiles.select("user_id", *carry, F.posexplode(best).alias("p", "t")).select(
        "user_id", *carry, (F.col("p") + 1).alias("tag_rank"), F.col("t.slot").alias("slot"), F.col("t.tag").alias("tag"),
        F.col("t.w").alias("weight"),
    )


def explain_profiles(profiles: DataFrame, slot_names: list[str], n: int) -> DataFrame:
    """Strongest likes and dislikes per user as long rows."""
    names = V.literal_names(slot_names)

    def side(label: str, sign: float):
        entries = F.transform(
            F.arrays_zip(F.col("vector").alias("w"), names.alias("tag")),
            lambda t, i: F.struct((F.round(t["w"], 12) * -sign).alias("key"), i.alias("slot"), t["tag"].alias("tag"), t["w"]),
        )
        kept = F.slice(F.array_sort(F.filter(entries, lambda t: t["w"] * sign > 0)), 1, n)
        return F.transform(
            kept, lambda t, i: F.struct(F.lit(label).alias("direction"), (i + 1).alias("rank"), t["tag"].alias("dimension"), t["w"].alias("contribution"))
        )

    both = F.concat(side("positive", 1.0), side("negative", -1.0))
    return profiles.select("user_id", F.explode(both).alias("e")).select("user_id", "e.*")


def read_profiles(profiles: DataFrame, affinity: DataFrame, slot_names: list[str], top: int = 5, with_vector: bool = False) -> DataFrame:
    """The profile read model. ``top`` is clamped to 1..20; the vector is optional."""
    n = min(20, max(1, int(top or 5)))
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 12)), "creator_id")
    creators = (
        affinity.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "creator_id", "score", "interaction_count"))).alias("creator_affinity"))
    )
    likes = explain_profiles(profiles, slot_names, n)
    sides = likes.groupBy("user_id").agg(
        *[
            F.array_sort(
                F.collect_list(F.when(F.col("direction") == d, F.struct("rank", "dimension", "contribution")))
            ).alias(f"top_{d}")
            for d in ("positive", "negative")
        ]
    )
    out = profiles.join(sides, "user_id", "left").join(creators, "user_id", "left")
    keep = [
        "user_id", "taxonomy_version", "is_cold_start", "interaction_count", "effective",
        F.round("positive_signal", 4).alias("positive_signal"), F.round("negative_signal", 4).alias("negative_signal"),
        "skipped_no_features", "top_positive", "top_negative", "creator_affinity",
    ]
    return out.select(*keep, *(["vector"] if with_vector else []))
