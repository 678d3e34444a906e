"""Feed build for a set of jobs: guard, recommend, guard again, assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.operators import feeds
from feedloom.plans.recommend import Inputs, diagnostics, recommend
from feedloom.session import materialise
from feedloom.sources.read import read_or_empty


_GENERATION = (
    "feed_id string, user_id {user}, epoch bigint, published_seq bigint, generated_at timestamp, expires_at timestamp, cold_start boolean, candidate_shortage boolean, "
    "diversity_relaxed boolean, items array<struct<item_id: {item}, rank: int, creator_id: string>>, build string"
)


@dataclass(frozen=True)
class PublishedFeeds:
    """Feeds as tables of builds. ``sidecar``, ``generations`` and ``commits`` have one partition per build, written in this order.

    Readers see the builds that have a commit record and nothing of others, so a build that stopped between two writes is invisible; publishing it again
    replaces its partitions. A committed build is never written again. What is active follows from the sequence and dates of the generations.
    """

    folder: str
    user_type: str = "bigint"
    item_type: str = "bigint"

    def committed(self, spark: SparkSession) -> DataFrame:
        """(build, seq, n_feeds, generated_at) of every build that is published."""
        return read_or_empty(spark, f"{self.folder}/commits", "seq bigint, n_feeds bigint, generated_at timestamp, build string")

    def publish(self, build: Build, build_id: str, seq: int, now: str) -> bool:
        """True if the build was published now, False if it had been before."""
        spark = build.generations.sparkSession
        if not self.committed(spark).where(F.col("build") == build_id).isEmpty():
            return False
        if build.sidecar is not None:
            build.sidecar.write.mode("overwrite").parquet(f"{self.folder}/sidecar/build={build_id}")
        build.generations.write.mode("overwrite").parquet(f"{self.folder}/generations/build={build_id}")
        written = read_or_empty(spark, f"{self.folder}/generations/build={build_id}", "feed_id string")
        record = written.agg(F.lit(seq).cast("bigint").alias("seq"), F.count(F.lit(1)).alias("n_feeds"), F.lit(now).cast("timestamp").alias("generated_at"))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/build={build_id}")
        return True

    def _visible(self, rows: DataFrame) -> DataFrame:
        done = self.committed(rows.sparkSession).where("n_feeds >= 0").select("build")
        return rows.join(F.broadcast(done), "build", "left_semi")  # one row per build; prunes the partitions of the others

    def generations(self, spark: SparkSession) -> DataFrame:
        return self._visible(read_or_empty(spark, f"{self.folder}/generations", _GENERATION.format(user=self.user_type, item=self.item_type)))

    def sidecar(self, spark: SparkSession, schema: str) -> DataFrame:
        return self._visible(read_or_empty(spark, f"{self.folder}/sidecar", f"{schema}, build string"))

    def active(self, current: DataFrame, now: str, s: Settings) -> DataFrame:
        """Each user's newest published generation, if it is for the epoch in ``current`` (user_id, epoch) and young enough at ``now``."""
        return feeds.active(self.generations(current.sparkSession), current, F.lit(now).cast("timestamp"), s)

    def drop_expired(self, spark: SparkSession, now: str) -> list[str]:
        """Builds without a generation that is still readable at ``now``; their partitions may be deleted by whoever owns the folder."""
        left = self.generations(spark).groupBy("build").agg(F.max("expires_at").alias("until")).where(F.col("until") <= F.lit(now).cast("timestamp"))
        return sorted(r.build for r in left.select("build").collect())  # at most one row per build


@dataclass
class Build:
    generations: DataFrame
    sidecar: DataFrame | None
    skipped: DataFrame


#: What an explanation shows of an item: looked up for the selected rows alone, not carried by every candidate.
_NAMES = ("creator_handle", "external_id", "div_tags")


def build_feeds(
    jobs: DataFrame, inputs: Inputs, current, live, seq: int, with_sidecar: bool = False
) -> Build:
    """``current()`` and ``live()`` return the epoch and active-generation tables as of the moment they are called.

    Jobs that cannot publish are dropped before any ranking, and the survivors are checked again afterwards.
    """
    s = inputs.s
    verdicts = materialise(feeds.guard_jobs(jobs, current(), live()))
    todo = verdicts.where(F.col("verdict") == "build").drop("verdict")
    run = recommend(inputs, s.feed_size, todo.select("user_id"))
    run.selected = materialise(run.selected)
    info = diagnostics(run, s.feed_size)
    late = materialise(feeds.guard_jobs(todo, current(), live()))
    final = late.where(F.col("verdict") == "build")
    generations = feeds.assemble(run.selected, info, final, seq, s.now, s)
    sidecar = None
    if with_sidecar:
        ids = generations.select("user_id", "feed_id", "epoch", "generated_at")
        named = run.selected.join(run.items.select("item_id", *_NAMES), "item_id")
        shown = run.candidates.join(run.selected.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
        sidecar = feeds.explanations(named, run.score(shown)).join(ids, "user_id")
    skipped = verdicts.where(F.col("verdict") != "build").unionByName(late.where(F.col("verdict") != "build"))
    return Build(generations, sidecar, skipped)


def build_and_publish(jobs: DataFrame, inputs: Inputs, current, store: PublishedFeeds, build_id: str, seq: int, with_sidecar: bool = True) -> Build | None:
    """One build from guard to commit; what is live is what the store shows. None if the build is published already."""
    spark = jobs.sparkSession
    if not store.committed(spark).where(F.col("build") == build_id).isEmpty():
        return None
    build = build_feeds(jobs, inputs, current, lambda: store.active(current(), inputs.s.now, inputs.s).select("user_id", "epoch"), seq, with_sidecar)
    store.publish(build, build_id, seq, inputs.s.now)
    return build
