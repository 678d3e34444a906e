"""Frame planning, scene snapping, cut-log parsing and near-duplicate frame removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions.hashing import hamming
from feedloom.functions.vectors import half_up


def frame_budget(duration: Column, s: Settings) -> Column:
    tier = F.lit(s.frame_tier_max)
    for bound, frames in reversed(s.frame_tiers):
        tier = F.when(duration <= bound, F.lit(frames)).otherwise(tier)
    feasible = F.greatest(F.lit(1), F.floor(F.least(duration, F.lit(1e9))).cast("int"))
    n = F.greatest(F.lit(1), F.least(tier, F.lit(s.frame_cap), feasible))
    usable = duration.isNotNull() & ~F.isnan(duration) & (duration > 0) & (duration < F.lit(float("inf")))
    return F.when(usable, n).otherwise(F.lit(1))


def plan_timestamps(duration: Column, n: Column, s: Settings) -> Column:
    """Midpoints of ``n`` equal parts of the trimmed duration, 3 decimals, distinct."""
    trim = min(max(s.frame_trim, 0.0), 0.45)
    start, span = duration * trim, duration * (1 - trim) - duration * trim
    last = F.greatest(duration - 0.05, F.lit(0.0))
    stamps = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: half_up(F.greatest(F.least(start + span * (i + 0.5) / n, last), F.lit(0.0)), 3),
    )
    return F.when((duration > 0) & (n > 0), F.array_distinct(stamps)).otherwise(F.array().cast("array<double>"))


def frame_plan(items: DataFrame, s: Settings) -> DataFrame:
    return items.select("item_id", "duration_s").withColumn("n_frames", frame_budget(F.col("duration_s"), s)).withColumn(
        "timestamps", plan_timestamps(F.col("duration_s"), F.col("n_frames"), s)
    )


def parse_cuts(log: Column) -> Column:
    """Sorted ``pts_time:`` values of a scene-detection log."""
    found = F.regexp_extract_all(log, F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_sort(F.transform(found, lambda x: x.cast("double")))


def snap_to_scenes(timestamps: Column, cuts: Column, s: Settings) -> Column:
    """Move each timestamp to the nearest free spot just after a cut, if one lies within the window.

    A fold, because a spot taken by an earlier timestamp is no longer free. Arrays are bounded by the frame cap.
    """
    spots = F.transform(F.array_sort(cuts), lambda c: half_up(c + s.scene_offset, 3))
    empty = F.array().cast("array<double>")

    def step(used: Column, t: Column) -> Column:
        near = F.filter(spots, lambda c: (F.abs(c - t) <= s.scene_snap_window) & ~F.array_contains(used, c))
        best = F.array_min(F.transform(near, lambda c, i: F.struct(F.abs(c - t).alias("d"), i.alias("i"), c.alias("c"))))
        return F.concat(used, F.array(F.coalesce(best["c"], t)))

    snapped = F.aggregate(timestamps, empty, step)
    return F.when(F.size(cuts) == 0, timestamps).otherwise(F.array_sort(F.array_distinct(snapped)))


def drop_near_duplicates(frames: DataFrame, threshold: int, floor: int) -> DataFrame:
    """``frames`` (item_id, ts_sec, hash) -> the same rows with ``kept``.

    Each frame is compared with the last *kept* frame of its item, so this is a fold over the item's frames
    (never more than the frame cap), not a lag. If fewer than ``floor`` survive, the most distant removed
    frames return.
    """
    ordered = frames.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ts_sec", "hash"))).alias("f"))
    entry = "struct<ts_sec:double,hash:bigint,distance:int>"

    def step(acc: Column, x: Column) -> Column:
        d = F.when(F.size(acc["kept"]) == 0, F.lit(65)).otherwise(hamming(F.element_at(acc["kept"], -1)["hash"], x["hash"]))
        row = F.array(F.struct(x["ts_sec"].alias("ts_sec"), x["hash"].alias("hash"), d.cast("int").alias("distance")))
        keep = d > threshold
        return F.struct(
            F.when(keep, F.concat(acc["kept"], row)).otherwise(acc["kept"]).alias("kept"),
            F.when(keep, acc["gone"]).otherwise(F.concat(acc["gone"], row)).alias("gone"),
        )

    empty = F.array().cast(f"array<{entry}>")
    folded = ordered.select(
        "item_id", F.aggregate("f", F.struct(empty.alias("kept"), empty.alias("gone")), step).alias("r")
    ).select("item_id", "r.kept", "r.gone")
    by_distance = F.array_sort(
        F.transform("gone", lambda g, i: F.struct((-g["distance"]).alias("k"), i.alias("i"), g["ts_sec"].alias("ts_sec"), g["hash"].alias("hash"), g["distance"].alias("distance")))
    )
    short = F.greatest(F.lit(0), F.lit(floor) - F.size("kept"))
    ranked = F.transform(by_distance, lambda g, i: F.struct(g["ts_sec"].alias("ts_sec"), g["hash"].alias("hash"), (i < short).alias("kept")))
    rows = F.concat(F.transform("kept", lambda g: F.struct(g["ts_sec"].alias("ts_sec"), g["hash"].alias("hash"), F.lit(True).alias("kept"))), ranked)
    return folded.select("item_id", F.explode(rows).alias("x")).select("item_id", "x.ts_sec", "x.hash", "x.kept")


def frame_totals(plan: DataFrame) -> DataFrame:
    n = F.size("timestamps")
    return plan.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("duration_s").alias("total_duration"),
        F.sum("n_frames").alias("requested"),
        F.sum(n).alias("selected"),
        F.min(n).alias("min_frames"),
        F.median(n).alias("median_frames"),
        F.max(n).alias("max_frames"),
    )
