"""Cost inputs from measured rows and the scenario table derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.operators.quantiles import interpolated, nearest_rank

GIB = 1024.0**3
MEASURED = ("items", "avg_frames", "avg_tokens_in", "avg_tokens_out", "avg_latency", "token_samples", "avg_size", "avg_duration", "p95_latency")


def cost_inputs(runs: DataFrame, group: str | None = None) -> DataFrame:
    """One row, or one per value of ``group``. ``runs``: item_id, frames_used, tokens_in?, tokens_out?, latency_ms, size_bytes, duration_s, run_key.

    Null tokens are not zeros: averages run over reporting rows and stay null without any.
    """
    keyed = runs.withColumn("_g", F.lit("all") if group is None else F.col(group))
    p95 = interpolated(keyed, "_g", "latency_ms", "run_key", 0.95, "p95_latency")
    means = keyed.groupBy("_g").agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.avg("frames_used"), F.lit(0.0)).alias("avg_frames"),
        F.avg("tokens_in").alias("avg_tokens_in"),
        F.avg("tokens_out").alias("avg_tokens_out"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency"),
        F.count("tokens_in").alias("token_samples"),
        F.coalesce(F.avg("size_bytes"), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.avg("duration_s"), F.lit(0.0)).alias("avg_duration"),
    )
    out = means.join(p95, "_g", "left").withColumn("p95_latency", F.coalesce("p95_latency", F.lit(0.0)))
    return out.drop("_g") if group is None else out.withColumnRenamed("_g", group)


def modal_model(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy("model_name", "model_version")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "model_name", "model_version")
        .limit(1)
    )


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.sum("frames_used").alias("frames"),
        (F.sum("latency_ms") / 1000).alias("latency_total_s"),
        F.avg("latency_ms").alias("latency_avg_ms"),
        F.count("tokens_in").alias("reporting"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.avg("tokens_in").alias("tokens_in_avg"),
    )


def run_statistics(runs: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: latency mean and nearest-rank p50/p95, frames, tokens, tokens per frame, repaired runs."""
    base = runs.groupBy(group).agg(
        F.avg("latency_ms").alias("latency_mean"),
        F.avg("frames_used").alias("frames_mean"),
        F.avg("tokens_in").alias("tokens_in_mean"),
        F.avg("tokens_out").alias("tokens_out_mean"),
        F.try_divide(F.avg("tokens_in"), F.avg("frames_used")).alias("tokens_per_frame"),
        F.count_if(F.col("attempts") > 1).alias("repaired"),
    )
    return base.join(nearest_rank(runs, group, "latency_ms", key, (50, 95)), group)


def cost_scenarios(inputs: DataFrame, dim: int, s: Settings) -> DataFrame:
    """``(scenario, provenance, quantity, unit, usd)`` for the target item count, per row of ``inputs`` and with its group column, if any."""
    n = float(s.cost_target_items)

    def row(name: str, provenance: str, quantity: Column, unit: str, usd: Column) -> Column:
        return F.struct(
            F.lit(name).alias("scenario"), F.lit(provenance).alias("provenance"), quantity.cast("double").alias("quantity"),
            F.lit(unit).alias("unit"), usd.cast("double").alias("usd"),
        )

    base = F.col("avg_latency") / 1000 * n / 3600
    p95 = F.col("p95_latency") / 1000 * n / 3600
    best = base / s.cost_optimistic_speedup
    storage = F.col("avg_size") * n / GIB
    rows = F.lit((dim * 4 + 8 + s.cost_features_bytes) * n / GIB)
    cpu = F.lit(n * s.cost_preprocess_s / 3600)
    mtok_in, mtok_out = F.col("avg_tokens_in") * n / 1e6, F.col("avg_tokens_out") * n / 1e6
    table = F.array(
        row("gpu_base", "measured", base, "gpu_hours", base * s.cost_gpu_hour_usd),
        row("gpu_p95", "measured", p95, "gpu_hours", p95 * s.cost_gpu_hour_usd),
        row("gpu_batched", "hypothetical", best, "gpu_hours", best * s.cost_gpu_hour_usd),
        row("media_storage", "measured", storage, "gib", storage * s.cost_storage_usd_gb_month),
        row("vector_rows", "assumed", rows, "gib", rows * s.cost_storage_usd_gb_month),
        row("hosted_input", "measured", mtok_in, "mtok", mtok_in * s.cost_input_usd_mtok),
        row("hosted_output", "measured", mtok_out, "mtok", mtok_out * s.cost_output_usd_mtok),
        row("preprocess_cpu", "assumed", cpu, "core_hours", cpu * s.cost_cpu_hour_usd),
    )
    group = [c for c in inputs.columns if c not in MEASURED]
    return inputs.select(*group, F.explode(table).alias("r")).select(*group, "r.*")


def with_rub(scenarios: DataFrame, s: Settings) -> DataFrame:
    """``rub`` beside ``usd``: GPU hours at their own hourly rate, the rest at the exchange rate, null without one. Null amounts stay null."""
    exchanged = F.col("usd") * s.cost_rub_per_usd if s.cost_rub_per_usd > 0 else F.lit(None).cast("double")
    return scenarios.withColumn("rub", F.when(F.col("unit") == "gpu_hours", F.col("quantity") * s.cost_gpu_hour_rub).otherwise(exchanged))
