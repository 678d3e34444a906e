"""Profiles and creator affinities kept as tables, refreshed for the users whose history changed.

``<folder>/profiles`` and ``<folder>/affinity`` are bucketed by user, ``<folder>/batches`` lists the log batches they cover. A refresh reads only the log's new
batches to find the users that changed, builds those from the whole log, and rewrites only their buckets. A vector does not depend on the moment
it was built at (every signal decays by one factor), so users without news keep theirs; the masses are moved to the moment of
reading.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import signals as G
from feedloom.operators import profiles as P
from feedloom.plans.recommend import Inputs
from feedloom.session import materialise
from feedloom.sources.read import read_or_empty
from feedloom.sources.sinks import BUCKET, bucketed, replace_projection

_PROFILE = (
    "user_id {id}, taxonomy_version int, vector array<double>, tag_affinity map<string,double>, interaction_count bigint, effective bigint, positive_signal double, "
    "negative_signal double, skipped_no_features bigint, is_cold_start boolean, newest timestamp, as_of timestamp"
)
_AFFINITY = "user_id {id}, creator_id string, score double, interaction_count bigint, mass double, as_of timestamp"


@dataclass(frozen=True)
class ProfileStore:
    """Where the tables lie. The bucket count is fixed by the number of users when the store is first built, and kept with it."""

    folder: str
    id_type: str = "bigint"
    users_per_bucket: int = 20_000

    @property
    def profile_schema(self) -> str:
        return _PROFILE.format(id=self.id_type)

    @property
    def affinity_schema(self) -> str:
        return _AFFINITY.format(id=self.id_type)

    def covered(self, spark: SparkSession) -> DataFrame:
        """(batch, buckets): the log batches that the store covers."""
        return read_or_empty(spark, f"{self.folder}/batches", "batch string, buckets int")

    def stored_profiles(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.folder}/profiles", f"{self.profile_schema}, {BUCKET} int")

    def stored_affinity(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.folder}/affinity", f"{self.affinity_schema}, {BUCKET} int")


def _fresh_rows(store: ProfileStore, inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """Profile and affinity rows of the users of ``inputs``, as of its ``now``."""
    now = G.now_col(inputs.s).alias("as_of")
    inputs.pairs = materialise(inputs.pairs)
    built = P.build_profiles(inputs.history, inputs.usable_vectors, inputs.slot_names, inputs.tax.version, inputs.s)
    newest = inputs.user_events.groupBy("user_id").agg(F.max("created_at").alias("newest"))
    rows = built.join(newest, "user_id").select("*", now)
    affinity = P.creator_affinity(inputs.history, inputs.s)
    rows = materialise(rows)
    mass = rows.select("user_id", (F.col("positive_signal") + F.col("negative_signal")).alias("mass"), "as_of")
    affinity = materialise(affinity.join(mass, "user_id"))
    return tuple(df.select([F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(schema)]) for df, schema in ((rows, store.profile_schema), (affinity, store.affinity_schema)))


def rebuild(store: ProfileStore, log: DataFrame, inputs: Inputs) -> None:
    """Build every user of ``log`` (the columns of the events, and ``batch``) and replace the store."""
    profiles, affinity = _fresh_rows(store, replace(inputs, events=log, users=None, stored=None))
    buckets = max(16, -(-profiles.count() // store.users_per_bucket))
    for rows, name in ((affinity, "affinity"), (profiles, "profiles")):
        bucketed(rows, "user_id", buckets).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{store.folder}/{name}")
    covered = materialise(log.select("batch").distinct().withColumn("buckets", F.lit(buckets)))
    covered.write.mode("overwrite").parquet(f"{store.folder}/batches")  # last: a store without it is built anew


def changed_users(store: ProfileStore, log: DataFrame, inputs: Inputs, changed_items: DataFrame | None = None) -> DataFrame:
    """(user_id): users with rows in batches the store does not cover, whose profile is of another vocabulary version or was built before the date of one of
    their own events (such a row does not decay yet), or who met one of ``changed_items`` (item_id; items whose vector or creator changed).
    """
    spark = log.sparkSession
    fresh = log.select("batch").distinct().join(store.covered(spark).select("batch"), "batch", "left_anti")
    fresh = materialise(fresh.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))).where("n > 0")
    found = log.join(F.broadcast(fresh), "batch", "left_semi").select("user_id")  # one row per micro-batch since the last refresh; prunes the log's partitions
    stored = store.stored_profiles(spark)
    stale = stored.where((F.col("taxonomy_version") != inputs.tax.version) | (F.col("newest") > F.col("as_of"))).select("user_id")
    found = found.unionByName(stale)
    if changed_items is not None:
        found = found.unionByName(log.join(changed_items.select("item_id").distinct(), "item_id", "left_semi").select("user_id"))
    return found.distinct()


def refresh(store: ProfileStore, log: DataFrame, inputs: Inputs, changed_items: DataFrame | None = None) -> DataFrame:
    """Bring the store up to date with ``log`` at ``inputs.s.now`` and return the users (user_id) that were built anew.

    Users whose rows all vanished from the known items lose their profile. The list of covered batches is written last: after a stop in between
    the next refresh does the same users again.
    """
    spark = log.sparkSession
    covered = store.covered(spark).select("buckets").first()
    if covered is None:
        rebuild(store, log, inputs)
        return store.stored_profiles(spark).select("user_id")
    batches = materialise(log.select("batch").distinct())
    users = materialise(changed_users(store, log, inputs, changed_items))
    profiles, affinity = _fresh_rows(store, replace(inputs, events=log, users=users, stored=None))
    replace_projection(spark, f"{store.folder}/affinity", affinity, users, "user_id", store.affinity_schema, covered.buckets)
    replace_projection(spark, f"{store.folder}/profiles", profiles, users, "user_id", store.profile_schema, covered.buckets)
    added = materialise(batches.join(store.covered(spark).select("batch"), "batch", "left_anti").withColumn("buckets", F.lit(covered.buckets)))
    added.write.mode("append").parquet(f"{store.folder}/batches")
    return users


def read(store: ProfileStore, spark: SparkSession, inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """(profiles, affinities) as ``Inputs`` would build them at ``inputs.s.now``, from the stored rows alone."""
    s = inputs.s
    age = F.greatest(F.lit(0.0), (F.unix_micros(G.now_col(s)) - F.unix_micros("as_of")) / F.lit(G.US_PER_DAY))
    factor = G.decay(age, s.halflife_days)
    least = F.lit(s.signal_epsilon)

    def moved(mass):
        """What a share of ``mass`` at as_of becomes: 1, but for masses that fall under epsilon."""
        return F.when(mass * factor >= least, F.lit(1.0)).otherwise(F.greatest(mass, least) * factor / least)

    mass = F.col("positive_signal") + F.col("negative_signal")
    rows = store.stored_profiles(spark).drop(BUCKET).withColumn("_m", moved(mass)).withColumn("_f", factor)
    vector = F.when(F.col("_m") == 1, F.col("vector")).otherwise(F.transform("vector", lambda x: x * F.col("_m")))
    tags = F.when(F.col("_m") == 1, F.col("tag_affinity")).otherwise(F.transform_values("tag_affinity", lambda _, x: x * F.col("_m")))
    profiles = rows.select(
        "user_id", "taxonomy_version", vector.alias("vector"), tags.alias("tag_affinity"), "interaction_count", "effective", (F.col("positive_signal") * F.col("_f")).alias("positive_signal"),
        (F.col("negative_signal") * F.col("_f")).alias("negative_signal"), "skipped_no_features", "is_cold_start",
    )
    affinity = store.stored_affinity(spark).select("user_id", "creator_id", (F.col("score") * moved(F.col("mass"))).alias("score"), "interaction_count")
    return profiles, affinity


def from_store(store: ProfileStore, inputs: Inputs) -> Inputs:
    """``inputs`` with profiles and affinities read from the store; the log then only tells what users have seen and what is popular."""
    return replace(inputs, stored=read(store, inputs.events.sparkSession, inputs))
