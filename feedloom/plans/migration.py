"""An append-only vocabulary change as one resumable job: encode stored features again, rebuild the profiles, invalidate the feeds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import encoding as E
from feedloom.operators import feeds as Z
from feedloom.plans import stored_profiles
from feedloom.plans.recommend import Inputs
from feedloom.plans.stored_profiles import ProfileStore
from feedloom.sources.read import read_or_empty

STEPS = ("vectors", "profiles", "epochs")
_STEP = "step string, finished_at timestamp"


def finished(spark, folder: str, change: str) -> set[str]:
    return {r.step for r in read_or_empty(spark, f"{folder}/steps/change={change}", _STEP).select("step").collect()}  # at most one row per step


def reencode_and_rebuild(
    folder: str, change: str, inputs: Inputs, store: ProfileStore, log: DataFrame, epochs: DataFrame, stop_after: str | None = None,
    on_step: Callable[[str], None] | None = None,
) -> DataFrame:
    """The epochs (user_id, epoch) after the change, every user with a profile one further than in ``epochs``.

    Each step writes its result under ``folder`` and then its row of the step table, so a run after a stop begins at the first step without one and
    repeats none that has one. ``change`` names the vocabulary change; ``epochs`` are those from before it. ``stop_after`` ends the run after that step.
    """
    spark = log.sparkSession
    done = finished(spark, folder, change)
    vectors, moved = f"{folder}/vectors/change={change}", f"{folder}/epochs/change={change}"
    vector_type = "item_id bigint, taxonomy_version int, vector array<double>"

    def encode() -> None:
        E.reencode(inputs.features, inputs.tax).write.mode("overwrite").parquet(vectors)

    def rebuild() -> None:
        stored_profiles.rebuild(store, log, replace(inputs, vectors=read_or_empty(spark, vectors, vector_type)))

    def invalidate() -> None:
        Z.bump_epochs(epochs, store.stored_profiles(spark)).write.mode("overwrite").parquet(moved)

    for step, work in zip(STEPS, (encode, rebuild, invalidate)):
        if step not in done:
            if on_step is not None:
                on_step(step)
            work()
            row = spark.range(1).select(F.lit(step).alias("step"), F.current_timestamp().alias("finished_at"))
            row.coalesce(1).write.mode("append").parquet(f"{folder}/steps/change={change}")
        if step == stop_after:
            break
    return read_or_empty(spark, moved, "user_id bigint, epoch bigint")
