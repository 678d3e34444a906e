"""Incremental profiles: decayed running sums that add up to the batch formula.

With ``s = w * 2^(-(t_ref - t) / h)`` at a fixed reference time, moving the reference multiplies every sum by the
same power of two, so events may arrive in any order and late ones add exactly. Rows dated after the reference
count in full (micro-batch sums) or move the reference forward (keyed state).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.config import EVENT_WEIGHTS, Settings
from feedloom.functions import signals as G
from feedloom.functions import vectors as V

STATE = "ref_us bigint, sums array<double>, pos double, neg double, effective bigint, skipped bigint, total bigint"
OUTPUT = "user_id bigint, ref_us bigint, sums array<double>, pos double, neg double, effective bigint, skipped bigint, total bigint"


def decayed_sums(rows: DataFrame, reference: str, dim: int, s: Settings) -> DataFrame:
    """One micro-batch as partial sums per user at a fixed reference time.

    Decay is a factor per row, so partial sums of any split of the log add up: map-side combine works and a hot
    user costs one row per task. Rows dated after ``reference`` have age 0, as in the batch formula.
    """
    at = F.lit(reference).cast("timestamp")
    weight = G.event_weight(F.col("type"))
    has = F.col("vector").isNotNull() & (F.size("vector") == dim)
    sig = weight * G.decay(G.age_days(F.col("created_at"), at), s.halflife_days)
    flat = rows.select(
        "user_id", "vector", F.when(has, sig).otherwise(F.lit(0.0)).alias("sig"),
        (has & (sig != 0)).alias("eff"), (~has & (weight != 0)).alias("skip"),
    )
    return flat.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("eff").alias("effective"),
        F.count_if("skip").alias("skipped"),
        F.sum(F.greatest("sig", F.lit(0.0))).alias("pos"),
        F.sum(F.greatest(-F.col("sig"), F.lit(0.0))).alias("neg"),
        *V.weighted_sums("vector", "sig", dim),
    ).select("user_id", "total", "effective", "skipped", "pos", "neg", F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(dim)]).alias("sums"))


def merge_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    """Add two sets of partial sums taken at the same reference."""
    dim_add = F.zip_with(F.col("x.sums"), F.col("y.sums"), lambda p, q: p + q)
    joined = a.alias("x").join(b.alias("y"), "user_id", "full")

    def add(c: str):
        return (F.coalesce(F.col(f"x.{c}"), F.lit(0)) + F.coalesce(F.col(f"y.{c}"), F.lit(0))).alias(c)

    return joined.select(
        "user_id", *[add(c) for c in ("total", "effective", "skipped", "pos", "neg")],
        F.coalesce(dim_add, F.col("x.sums"), F.col("y.sums")).alias("sums"),
    )


def profiles_from_sums(sums: DataFrame, s: Settings) -> DataFrame:
    mass = F.greatest(F.col("pos") + F.col("neg"), F.lit(s.signal_epsilon))
    return sums.select(
        "user_id", F.transform("sums", lambda x: x / mass).alias("vector"),
        F.col("total").alias("interaction_count"), "effective", F.col("pos").alias("positive_signal"),
        F.col("neg").alias("negative_signal"), F.col("skipped").alias("skipped_no_features"),
        (F.col("effective") < s.cold_start_min).alias("is_cold_start"),
    )


class RunningProfile(StatefulProcessor):
    """Keyed state per user: the sums above at the newest event time seen, rescaled when the reference moves."""

    def __init__(self, dim: int, halflife_days: float, weights: dict[str, float]):
        self.dim, self.halflife, self.weights = dim, halflife_days, weights

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", STATE)

    def _shrink(self, us: int) -> float:
        return 1.0 if self.halflife <= 0 else float(0.5 ** (us / G.US_PER_DAY / self.halflife))

    def handleInputRows(self, key, rows, timerValues):
        ref, sums, pos, neg, eff, skip, total = self.state.get() or (0, [0.0] * self.dim, 0.0, 0.0, 0, 0, 0)
        sums = np.array(sums)
        for pdf in rows:
            times = pdf["at_us"].to_numpy()
            newest = max(ref, int(times.max()))
            back = self._shrink(newest - ref) if ref else 1.0
            sums, pos, neg, ref = sums * back, pos * back, neg * back, newest
            w = pdf["type"].map(self.weights).fillna(0.0).to_numpy()
            has = np.array([v is not None and len(v) == self.dim for v in pdf["vector"]])
            sig = np.where(has, w * np.array([self._shrink(newest - int(t)) for t in times]), 0.0)
            if has.any():
                sums = sums + sig[has] @ np.vstack([np.asarray(v, dtype=float) for v in pdf["vector"][has]])
            pos, neg = pos + float(sig[sig > 0].sum()), neg - float(sig[sig < 0].sum())
            eff, skip, total = eff + int((sig != 0).sum()), skip + int((~has & (w != 0)).sum()), total + len(pdf)
        self.state.update((ref, sums.tolist(), pos, neg, eff, skip, total))
        yield pd.DataFrame(
            {"user_id": [key[0]], "ref_us": [ref], "sums": [sums.tolist()], "pos": [pos], "neg": [neg], "effective": [eff], "skipped": [skip], "total": [total]}
        )

    def close(self) -> None:
        pass


def running_profiles(stream: DataFrame, vectors: DataFrame, dim: int, s: Settings) -> DataFrame:
    """Stream of updated sums. Needs the RocksDB state store; ``stream`` has user_id, item_id, type, created_at."""
    rows = stream.join(vectors.select("item_id", "vector"), "item_id", "left").select(
        "user_id", "type", F.unix_micros("created_at").alias("at_us"), "vector"
    )
    return rows.groupBy("user_id").transformWithStateInPandas(
        RunningProfile(dim, s.halflife_days, EVENT_WEIGHTS), OUTPUT, "Update", "None"
    )


def read_at(sums: DataFrame, now: str, s: Settings) -> DataFrame:
    """Profiles at ``now`` from state rows: one common factor per user cancels in the vector, not in the masses."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.col("ref_us")) / F.lit(G.US_PER_DAY))
    f = G.decay(days, s.halflife_days)
    scaled = sums.withColumn("_f", f).select(
        "user_id", "total", "effective", "skipped", (F.col("pos") * F.col("_f")).alias("pos"), (F.col("neg") * F.col("_f")).alias("neg"),
        F.transform("sums", lambda x: x * F.col("_f")).alias("sums"),
    )
    return profiles_from_sums(scaled, s)
