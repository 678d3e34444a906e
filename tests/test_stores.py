"""Key index, validated intake, bursts, stored profiles, published feeds and the resumable vocabulary change."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.plans import feed_build, migration, queries_feed, queries_reports, queries_store, stored_profiles
from feedloom.plans.queries_feed import tag_inputs
from feedloom.session import materialise
from feedloom.sources import key_index, sinks
from feedloom.sources import tables as T
from feedloom.streaming import intake

SF = "/root/testdata/sf0.001"
LOG = "event_id string, user_id bigint, item_id bigint, type string, created_at timestamp"
RAW = "event_id string, user_id string, item_id string, type string, watch_ratio double, watch_ms bigint, created_at timestamp"
RECORDED = "event_id string, user_id bigint, item_id bigint, type string, watch_ratio double, watch_ms bigint, created_at timestamp"


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "event_id string")


# ---- key index ----


def test_filters_forget_nothing():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    packed = key_index.make_filter(h1[:2500], h2[:2500])
    assert key_index.may_hold(packed, h1[:2500], h2[:2500]).all() and key_index.may_hold(packed, h1[2500:], h2[2500:]).sum() <= 1
    assert not key_index.may_hold(key_index.make_filter(h1[:0], h2[:0]), h1, h2).any()


def test_index_opens_only_batches_that_may_hold_a_key(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert key_index.known_keys(keys(spark, ["a", None]), folder).count() == 0  # no index yet
    for b in range(6):
        key_index.add_keys(keys(spark, [f"k{b}-{i}" for i in range(50)] + [None, f"k{b}-0"]), folder, f"b{b}")
    asked = keys(spark, ["k2-7", "k2-8", "k4-1", "new-1", "new-2", None])
    possible = materialise(key_index.possible_batches(asked, folder))
    assert {r.batch for r in possible.collect()} == {"b2", "b4"}
    found = key_index.stored_keys(possible, folder)
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()  # the scan of the keys is cut to the batches named
    assert {r.key for r in found.collect()} == {"k2-7", "k2-8", "k4-1"}
    assert {r.key for r in key_index.known_keys(asked, folder, except_batch="b2").collect()} == {"k4-1"}
    # With every other batch's file gone the answer stays the same: they were never opened.
    for b in (0, 1, 3, 5):
        for name in os.listdir(f"{folder}/batch=b{b}"):
            if name.endswith(".parquet"):
                with open(f"{folder}/batch=b{b}/{name}", "r+b") as file:
                    file.truncate(4)
    assert {r.key for r in key_index.stored_keys(possible, folder).collect()} == {"k2-7", "k2-8", "k4-1"}


def test_append_keeps_the_first_arrival_and_replaces_a_retried_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", 9, 1, "like", "2024-01-02", 1), ("a", 1, 1, "view", "2024-01-01", 2), ("b", 2, 2, "view", "2024-01-01", 3), (None, 3, 3, "view", "2024-01-01", 4), (None, 3, 3, "view", "2024-01-01", 5)]
    batch = spark.createDataFrame(rows, "event_id string, user_id long, item_id long, type string, created_at string, seq int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    schema = f"{LOG}, seq int"
    assert {(r.event_id, r.user_id) for r in sinks.append_events(spark, path, batch, schema, "one", order=("seq",)).collect()} == {("a", 9), ("b", 2), (None, 3)}
    read = lambda: spark.read.schema(schema).parquet(path)
    assert read().count() == 4
    # The retry brings fewer rows and fewer days: nothing of the first attempt is left.
    sinks.append_events(spark, path, batch.where("event_id = 'b'"), schema, "one", order=("seq",))
    assert [(r.event_id, r.user_id) for r in read().collect()] == [("b", 2)]
    # 'a' is free again, 'b' is not.
    sinks.append_events(spark, path, batch.where("event_id is not null"), schema, "two", order=("seq",))
    assert sorted((r.event_id, r.user_id) for r in read().collect()) == [("a", 9), ("b", 2)]


def test_index_log_catches_up(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1, 1, "like", None)], LOG)
    rows.withColumn("day", F.lit("2024-01-01")).write.partitionBy("day").parquet(f"{path}/batch=u-lost")
    sinks.index_log(spark, path, LOG)
    assert sinks.append_events(spark, path, rows, LOG, "next").count() == 0


# ---- validated intake ----


def raw(spark, rows, folder):
    """One file per list of rows, each a micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, RAW.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")
    return intake.read_events(spark, f"{folder}/*", spark.read.schema(RAW).parquet(f"{folder}/f0").schema, fmt="parquet")


def row(key, user="1", item="1", kind="like", ratio=0.5, ms=10, at="2024-01-01 10:00:00"):
    return key, user, item, kind, ratio, ms, at


def test_quarantine_survives_a_failed_second_sink(spark, tmp_path, monkeypatch):
    stream = raw(spark, [[row("a"), row("b", user="x"), row("c", item="77"), row("a", kind="view"), row(None), row("d", ratio=2.0, ms=-1)]], str(tmp_path / "in"))
    users, items = spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([(1,)], "item_id long")
    log, bad = str(tmp_path / "log"), str(tmp_path / "bad")
    seen, failures = [], [True]

    def later(recorded, batch_id):
        seen.append(sorted((str(r.event_id), r.user_id) for r in recorded.collect()))
        if failures.pop() if failures else False:
            raise RuntimeError("second sink")

    start = lambda: intake.quarantined_intake(stream, lambda s: (users, items), log, bad, RECORDED, str(tmp_path / "ck"), on_batch=later)
    with pytest.raises(Exception, match="second sink"):
        start().awaitTermination()
    start().awaitTermination()
    assert seen == [[("None", 1), ("a", 1)]] * 2
    rows = spark.read.schema(RECORDED).parquet(log).collect()
    assert sorted((str(r.event_id), r.user_id, r.item_id, r.type) for r in rows)[0] == ("None", 1, 1, "like") and len(rows) == 2
    turned = {r.event_id: (r.reasons, r.reference_error) for r in intake.read_quarantine(spark, bad, RAW).collect()}
    assert turned == {"b": (["user_id"], "unknown_user"), "c": ([], "unknown_item"), "d": (["watch_ratio", "watch_ms"], None)}


def test_references_are_read_anew_for_each_batch(spark, tmp_path):
    stream = raw(spark, [[row("a", user="2")], [row("b", user="2")]], str(tmp_path / "in"))
    items, asked = spark.createDataFrame([(1,)], "item_id long"), []

    def references(s):
        asked.append(1)
        return s.createDataFrame([(len(asked),)], "user_id long"), items

    log, bad = str(tmp_path / "log"), str(tmp_path / "bad")
    intake.quarantined_intake(stream, references, log, bad, RECORDED, str(tmp_path / "ck")).awaitTermination()
    assert len(asked) == 2 and [r.user_id for r in spark.read.schema(RECORDED).parquet(log).collect()] == [2]
    assert intake.read_quarantine(spark, bad, RAW).count() == 1


def test_bursts_merge_whatever_the_order(spark):
    minutes = [(1, 0), (1, 5), (1, 14), (1, 24), (1, 60), (2, 0), (1, 19), (1, 75)]
    rows = spark.createDataFrame(minutes, "user_id long, m int").select("user_id", F.timestamp_seconds(F.col("m") * 60).alias("first_at"), F.timestamp_seconds(F.col("m") * 60).alias("last_at"), F.lit(1).cast("bigint").alias("n_events"))
    whole = sorted((r.user_id, r.first_at, r.last_at, r.n_events) for r in intake.merge_bursts(rows).collect())
    assert [(u, n) for u, _, _, n in whole] == [(1, 5), (1, 1), (1, 1), (2, 1)]
    parts = intake.merge_bursts(rows.where("minute(first_at) in (0, 14, 24)")).unionByName(intake.merge_bursts(rows.where("minute(first_at) not in (0, 14, 24)")))
    assert sorted((r.user_id, r.first_at, r.last_at, r.n_events) for r in intake.merge_bursts(parts).collect()) == whole


# ---- stored profiles ----


def files(folder):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_refresh_leaves_other_buckets_unwritten(spark, tmp_path):
    i = tag_inputs(spark, SF)
    rows = T.events(spark, SF).select("event_id", "user_id", "item_id", "type", "created_at")
    user = rows.groupBy("user_id").count().orderBy("user_id").first().user_id
    log = str(tmp_path / "log")
    schema = "event_id bigint, user_id bigint, item_id bigint, type string, created_at timestamp"
    late = (F.col("user_id") == user) & (F.col("event_id") % 2 == 0)
    sinks.append_events(spark, log, rows.where(~late), schema, "first")
    store = stored_profiles.ProfileStore(str(tmp_path / "store"))
    read_log = lambda: spark.read.schema(f"{schema}, batch string").parquet(log)
    stored_profiles.refresh(store, read_log(), i)
    before = files(store.folder)
    sinks.append_events(spark, log, rows.where(late), schema, "second")
    done = stored_profiles.refresh(store, read_log(), i)
    assert [r.user_id for r in done.collect()] == [user]
    after = files(store.folder)
    bucket = store.stored_profiles(spark).where(F.col("user_id") == user).first().bucket
    changed = {p for p in after if before.get(p) != after[p] and "/batches/" not in p} | {p for p in before if p not in after}
    assert changed and all(f"bucket={bucket}/" in p for p in changed)
    got, affinity = stored_profiles.read(store, spark, i)
    want = {r.user_id: r for r in i.profiles.collect()}
    rows_ = {r.user_id: r for r in got.collect()}
    assert rows_.keys() == want.keys()
    for u, r in rows_.items():
        assert np.allclose(r.vector, want[u].vector) and r.effective == want[u].effective and abs(r.positive_signal - want[u].positive_signal) < 1e-9
    assert affinity.count() == i.creator_affinity.count()
    assert stored_profiles.refresh(store, read_log(), i).count() == 0  # nothing new


def test_masses_follow_the_moment_of_reading(spark, tmp_path):
    rows = T.events(spark, SF).select("event_id", "user_id", "item_id", "type", "created_at").withColumn("batch", F.lit("all"))
    store = stored_profiles.ProfileStore(str(tmp_path / "store"))
    stored_profiles.refresh(store, rows, tag_inputs(spark, SF))
    for later in ("2024-02-20 00:00:00", "2026-01-01 00:00:00"):  # the second is so late that masses fall under epsilon
        i = tag_inputs(spark, SF, Settings().but(now=later))
        got, affinity = stored_profiles.read(store, spark, i)
        want = {r.user_id: r for r in i.profiles.collect()}
        for r in got.collect():
            assert np.allclose(r.vector, want[r.user_id].vector, rtol=1e-9, atol=1e-15) and np.isclose(r.negative_signal, want[r.user_id].negative_signal, rtol=1e-9)
        scores = {(r.user_id, r.creator_id): r.score for r in i.creator_affinity.collect()}
        assert all(np.isclose(r.score, scores[r.user_id, r.creator_id], rtol=1e-9, atol=1e-15) for r in affinity.collect())


def test_rows_of_another_version_or_ahead_of_their_date_are_stale(spark, tmp_path):
    rows = T.events(spark, SF).select("event_id", "user_id", "item_id", "type", "created_at").withColumn("batch", F.lit("all"))
    store, early = stored_profiles.ProfileStore(str(tmp_path / "store")), tag_inputs(spark, SF, Settings().but(now="2024-01-20 00:00:00"))
    stored_profiles.refresh(store, rows, early)
    i = tag_inputs(spark, SF)
    ahead = {r.user_id for r in rows.where("created_at > timestamp'2024-01-20'").select("user_id").collect()}
    assert {r.user_id for r in stored_profiles.changed_users(store, rows, i).collect()} == ahead & {r.user_id for r in i.profiles.collect()}
    item = rows.first().item_id
    met = {r.user_id for r in rows.where(F.col("item_id") == item).collect()}
    assert met <= {r.user_id for r in stored_profiles.changed_users(store, rows, i, spark.createDataFrame([(item,)], "item_id long")).collect()}


# ---- published feeds ----


def test_builds_are_visible_only_when_committed(spark, tmp_path, monkeypatch):
    schema = feed_build._GENERATION.format(user="bigint", item="bigint").removesuffix(", build string")
    make = lambda user, epoch, seq: spark.createDataFrame([(f"f{user}-{seq}", user, epoch, seq, None, None, False, False, False, [])], schema).withColumn("generated_at", F.lit("2024-01-01").cast("timestamp"))
    note = lambda user, seq: spark.createDataFrame([(f"f{user}-{seq}", user)], "feed_id string, user_id long")
    store = feed_build.PublishedFeeds(str(tmp_path))
    assert store.generations(spark).count() == 0 and store.committed(spark).count() == 0
    one = feed_build.Build(make(1, 5, 1), note(1, 1), None)
    assert store.publish(one, "b1", 1, "2024-01-01") and not store.publish(one, "b1", 1, "2024-01-01")
    # A build that stops between its writes: after the sidecar, then after the generations.
    two = feed_build.Build(make(2, 7, 2), note(2, 2), None)
    for stop in ("generations", "commits"):

        class Stopped(Exception):
            pass

        plain = type(two.generations.write).parquet

        def parquet(self, path, *args, **kwargs):
            if f"/{stop}/" in path:
                raise Stopped
            return plain(self, path, *args, **kwargs)

        with monkeypatch.context() as patch:
            patch.setattr(type(two.generations.write), "parquet", parquet)
            with pytest.raises(Stopped):
                store.publish(two, "b2", 2, "2024-01-01")
        assert [r.user_id for r in store.generations(spark).collect()] == [1]
        assert [r.user_id for r in store.sidecar(spark, "feed_id string, user_id bigint").collect()] == [1]
    assert store.publish(two, "b2", 2, "2024-01-01")
    assert sorted(r.user_id for r in store.generations(spark).collect()) == [1, 2] and store.sidecar(spark, "feed_id string, user_id bigint").count() == 2
    assert {(r.build, r.n_feeds) for r in store.committed(spark).collect()} == {("b1", 1), ("b2", 1)}
    now = spark.createDataFrame([(1, 5), (2, 8)], "user_id long, epoch long")
    assert [r.user_id for r in store.active(now, "2024-01-01 00:10:00", Settings()).collect()] == [1]  # user 2 has moved on


# ---- vocabulary change ----


def test_a_rerun_repeats_no_finished_step(spark, tmp_path):
    i, store = tag_inputs(spark, SF), stored_profiles.ProfileStore(str(tmp_path / "profiles"))
    log = T.events(spark, SF).select("event_id", "user_id", "item_id", "type", "created_at").withColumn("batch", F.lit("all"))
    epochs = spark.createDataFrame([(1, 4), (999, 2)], "user_id long, epoch long")
    for stop, want in (("vectors", ["vectors"]), ("profiles", ["profiles"]), (None, ["epochs"]), (None, [])):
        ran: list[str] = []
        moved = migration.reencode_and_rebuild(str(tmp_path / "m"), "v2", i, store, log, epochs, stop_after=stop, on_step=ran.append)
        assert ran == want
    got = {r.user_id: r.epoch for r in moved.collect()}
    assert got[999] == 2 and got[1] == 5 and all(got[r.user_id] >= 1 for r in store.stored_profiles(spark).collect())


# ---- selection ----


@pytest.mark.parametrize("seed", range(2))
def test_selection_equals_sorting(spark, seed, monkeypatch):
    from feedloom.operators import quantiles

    monkeypatch.setattr(quantiles, "BINS", 64)
    monkeypatch.setattr(quantiles, "SORT_ROWS", 30)
    rng = np.random.default_rng(seed)
    columns = {"spread": np.exp(rng.normal(0, 4, 300)), "ties": rng.integers(0, 3, 200).astype(float), "one": np.array([7.0]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-320, 2e-320] * 4), "odd": np.array([-np.inf, 1.0, np.inf, np.nan, 2.0])}
    rows = [(g, float(v)) for g, vs in columns.items() for v in vs] + [("spread", None), ("empty", None), (None, 4.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("k", F.lit(1))
    got = {r.g: r for r in quantiles.nearest_rank(df, "g", "v", "k", (0, 50, 95)).collect()}
    assert got.keys() == {*columns, None} and got[None].p50 == 4.0
    for g, vs in columns.items():
        ordered = np.sort(vs)  # NaN last
        want = [ordered[min(len(vs) - 1, int(p / 100 * len(vs)))] for p in (0, 50, 95)]
        assert np.array_equal([got[g].p0, got[g].p50, got[g].p95], want, equal_nan=True), g
    mid = {r.g: r.m for r in quantiles.interpolated(df.where("g in ('spread', 'ties', 'one')"), "g", "v", "k", 0.3, "m").collect()}
    assert all(np.isclose(mid[g], np.quantile(columns[g], 0.3)) for g in mid) and len(mid) == 3
    plan = quantiles.nearest_rank(df, "g", "v", "k", (50,))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_a_refreshed_store_has_one_file_a_bucket_and_encodes_once(spark, monkeypatch):
    """Every task used to write a file into every bucket, and the catalogue was read and encoded for each of the two builds."""
    encoded, plain = [], queries_feed.E.encode_features
    monkeypatch.setattr(queries_feed.E, "encode_features", lambda *a: encoded.append(1) or plain(*a))
    store, _ = queries_store.refreshed_store(spark, SF.replace("sf0.001", "sf0.01"))
    assert len(encoded) == 1
    for name in ("profiles", "affinity"):
        folders = [f for f in os.listdir(f"{store.folder}/{name}") if f.startswith("bucket=")]
        assert len(folders) > 10 and all(sum(x.endswith(".parquet") for x in os.listdir(f"{store.folder}/{name}/{f}")) == 1 for f in folders)


def test_a_micro_batch_is_checked_by_many_tasks(spark, tmp_path, monkeypatch):
    """A batch from one file was checked by the one task that read it."""
    plans, plain = [], intake.validated
    monkeypatch.setattr(intake, "validated", lambda rows, *refs: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or plain(rows, *refs))
    stream = raw(spark, [[row("a"), row(None), row("b", user="x")]], str(tmp_path / "in"))
    users, items = spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([(1,)], "item_id long")
    log, bad = str(tmp_path / "log"), str(tmp_path / "bad")
    intake.quarantined_intake(stream, lambda s: (users, items), log, bad, RECORDED, str(tmp_path / "ck")).awaitTermination()
    assert plans and all("RepartitionByExpression [event_id" in p for p in plans)
    assert spark.read.schema(RECORDED).parquet(log).count() == 2 and intake.read_quarantine(spark, bad, RAW).count() == 1


def test_accepted_rows_need_the_log_once_for_references(spark, monkeypatch):
    """Each of ten micro-batches used to read the whole log again to learn who its users are."""
    asked, plain = [], intake.quarantined_intake
    monkeypatch.setattr(intake, "quarantined_intake", lambda stream, references, *rest: asked.append(references(spark)) or plain(stream, references, *rest))
    queries_reports.stream_accepted(spark, SF)
    assert not any("events.parquet" in f or "part.parquet" in f for side in asked[0] for f in side.inputFiles())


def test_probing_stops_early_and_filters_are_built_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    h1, h2 = (rng.integers(-(2**63), 2**63 - 1, 4000) for _ in range(2))
    whole = key_index.make_filter(h1[:2000], h2[:2000])
    monkeypatch.setattr(key_index, "_AT_ONCE", 300)
    assert key_index.make_filter(h1[:2000], h2[:2000]) == whole
    at = key_index._places(h1, h2, 64_000)
    bits = np.unpackbits(np.frombuffer(whole, np.uint8, offset=8))
    assert (key_index.may_hold(whole, h1, h2) == (bits[at.astype(np.int64)] == 1).all(axis=1)).all()
