"""Sources, sinks, feed tables and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.operators import evaluation as Q
from feedloom.operators import feeds as Z
from feedloom.operators import ingest as N
from feedloom.operators import validation as L
from feedloom.sources import files, sinks
from feedloom.streaming import intake, profile_state
from feedloom.taxonomy import neutral

S = Settings()
LOG = "event_id string, user_id bigint, item_id bigint, type string, created_at timestamp"


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, user_id bigint, item_id bigint, type string, at string").select(
        "event_id", "user_id", "item_id", "type", F.col("at").cast("timestamp").alias("created_at")
    )


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = events(spark, [("a", 1, 1, "like", "2024-01-01"), ("a", 1, 1, "like", "2024-01-01"), (None, 1, 2, "view", "2024-01-01"), (None, 1, 2, "view", "2024-01-01")])
    assert sinks.append_events(spark, path, batch, LOG).count() == 3
    assert sinks.append_events(spark, path, batch.where("event_id is not null"), LOG).count() == 0
    assert spark.read.parquet(path).count() == 3


def test_upsert_replaces_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "user_id bigint, score double"
    sinks.upsert(spark, path, spark.createDataFrame([(i, 0.0) for i in range(50)], schema), "user_id", schema)
    sinks.upsert(spark, path, spark.createDataFrame([(7, 7.0), (60, 6.0)], schema), "user_id", schema)
    got = {r["user_id"]: r["score"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 51 and got[7] == 7.0 and got[60] == 6.0 and got[8] == 0.0


def test_replace_projection_clears_old_rows(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "user_id bigint, creator_id string"
    first = spark.createDataFrame([(u, c) for u in range(20) for c in "ab"], schema)
    sinks.replace_projection(spark, path, first, first, "user_id", schema, 4)
    owners = spark.createDataFrame([(u,) for u in range(5)], "user_id bigint")
    sinks.replace_projection(spark, path, spark.createDataFrame([(1, "z")], schema), owners, "user_id", schema, 4)
    got = {(r["user_id"], r["creator_id"]) for r in spark.read.schema(schema + ", bucket int").parquet(path).collect()}
    assert got == {(1, "z")} | {(u, c) for u in range(5, 20) for c in "ab"}


def test_discovery_and_manifest(spark, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    for name in ("b.mp4", "a_copy.MP4", "a.mov", "notes.txt"):
        (folder / name).write_bytes(name[:1].encode())
    found = files.with_checksum(files.discover(spark, str(folder)))
    assert [r["file_name"] for r in found.collect()] == ["a.mov", "a_copy.MP4", "b.mp4"]
    assert files.discover(spark, str(folder), 1).count() == 1
    path = tmp_path / "manifest.json"
    assert files.manifest(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"file": "b.mp4", "creatorId": "c1"}, {"file": "gone.mp4"}]))
    manifest = files.manifest(spark, str(path))
    assert [r[0] for r in N.unmatched_manifest(found, manifest).collect()] == ["gone.mp4"]
    assert {r["file_name"]: r["creator_id"] for r in N.attribute(found, manifest).collect()} == {"a.mov": None, "a_copy.MP4": None, "b.mp4": "c1"}
    path.write_text(json.dumps([{"file": "b.mp4"}, {"file": "b.mp4"}]))
    with pytest.raises(Exception, match="more than once"):
        files.manifest(spark, str(path)).collect()
    path.write_text("[{broken")
    with pytest.raises(Exception):
        files.manifest(spark, str(path)).collect()


def test_ingest_rerun_adds_nothing_and_reconciles(spark):
    cols = "file_name string, checksum string, duration_s double, width int, height int, creator_id string, creator_handle string"
    rows = [("a", "x", 5.0, 4, 8, None, None), ("b", "x", 5.0, 4, 8, "c1", None), ("c", "x", 5.0, 4, 8, "c2", None), ("d", "y", 400.0, 4, 8, None, None), ("e", "z", 9.0, 8, 4, "c3", "h")]
    f = spark.createDataFrame(rows, cols)
    none = spark.createDataFrame([], "item_id bigint, checksum string, creator_id string, creator_handle string")
    got = {r["file_name"]: r for r in N.ingest_outcomes(f, none, S).collect()}
    assert [got[k]["status"] for k in "abcde"] == ["ingested", "duplicate", "duplicate", "rejected", "ingested"]
    assert got["b"]["creator_enriched"] and got["c"]["warnings"] == ["creator_conflict"] and got["d"]["reason"] == "too_long" and got["e"]["warnings"] == ["not_vertical"]
    have = spark.createDataFrame([(1, "x", "c1", None), (2, "z", "c3", "h")], "item_id bigint, checksum string, creator_id string, creator_handle string")
    again = {r["file_name"]: r for r in N.ingest_outcomes(f, have, S).collect()}
    assert [again[k]["status"] for k in "abcde"] == ["duplicate", "duplicate", "duplicate", "rejected", "duplicate"]
    assert not any(again[k]["creator_enriched"] for k in "abce") and again["c"]["warnings"] == ["creator_conflict"] and again["b"]["warnings"] == []


def test_gold_and_predictions_guard_version(spark, tmp_path):
    label = "finish: STRING"
    g = tmp_path / "gold.json"
    g.write_text(json.dumps({"taxonomyVersion": 1, "reviewedBy": "r", "reviewedAt": "d", "items": [{"videoId": "1", "labels": {"finish": "promo"}}]}))
    assert files.gold_labels(spark, str(g), label, 1).first()["finish"] == "promo"
    with pytest.raises(Exception, match="taxonomy version"):
        files.gold_labels(spark, str(g), label, 2).collect()
    p = tmp_path / "pred"
    run = sinks.write_predictions(spark.createDataFrame([("1", "promo")], "item_id string, finish string"), str(p), {"model": "m", "prompt": "2"})
    assert spark.read.json(str(p)).first()["run_id"] == run
    saved = tmp_path / "saved.json"
    saved.write_text(json.dumps({"model": "m", "items": [{"videoId": "1", "features": {"finish": "large"}}]}))
    assert files.predictions(spark, str(saved), label, 1).first()["finish"] == "large"


def test_vocabulary_is_consistent(spark):
    tax = neutral().frame(spark)
    assert L.vocabulary_mismatch(tax.select("field", "value"), tax).count() == 0
    twice = tax.unionByName(tax.limit(1))
    assert {r["problem"] for r in L.vocabulary_mismatch(tax.select("field", "value"), twice).collect()} == {"duplicate_tag", "duplicate_slot"}
    mixed = spark.createDataFrame([(1, 1), (2, 2)], "item_id bigint, taxonomy_version int")
    with pytest.raises(Exception, match="expected taxonomy version 1"):
        L.require_one_version(mixed, 1).collect()


def test_agreement_corner_cases(spark):
    g = spark.createDataFrame([(1, "t", "multi", []), (2, "t", "multi", []), (3, "t", "multi", ["a", "b"]), (4, "s", "single", ["unknown"])], "item_id bigint, field string, kind string, values array<string>")
    p = spark.createDataFrame([("m", 1, "t", []), ("m", 2, "t", ["a"]), ("m", 3, "t", []), ("m", 4, "s", ["unknown"])], "model string, item_id bigint, field string, values array<string>")
    got = {r["item_id"]: r for r in Q.compare(g, p).collect()}
    assert [(got[i]["score"], got[i]["precision"], got[i]["recall"]) for i in (1, 2, 3)] == [(1.0, 1.0, 1.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)]
    assert got[4]["score"] == 1.0 and got[4]["gold_unknown"] and got[4]["precision"] is None


# --- feed tables ---

GEN = "feed_id string, user_id bigint, epoch bigint, published_seq bigint, at string, candidate_shortage boolean, items array<struct<item_id:bigint,rank:int,creator_id:string>>"


def generations(spark, rows):
    df = spark.createDataFrame(rows, GEN).withColumn("generated_at", F.col("at").cast("timestamp")).drop("at")
    return df.withColumn("expires_at", F.timestamp_add("SECOND", F.lit(7200), F.col("generated_at")))


def test_guards_follow_epoch_and_reason(spark):
    gen = generations(spark, [("f1", 1, 3, 1, "2024-01-01 00:00:00", False, []), ("f2", 2, 1, 1, "2024-01-01 00:00:00", False, []), ("f3", 3, 2, 1, "2024-01-01 00:00:00", False, [])])
    current = spark.createDataFrame([(1, 3), (2, 2), (3, 2)], "user_id bigint, epoch bigint")
    live = Z.active(gen, current, F.lit("2024-01-01 00:30:00").cast("timestamp"), S)
    assert sorted(r["user_id"] for r in live.collect()) == [1, 3]
    jobs = spark.createDataFrame([(1, 3, "miss"), (1, 3, "refill"), (2, 1, "invalidation"), (2, 2, "invalidation"), (3, 2, "prewarm"), (4, 0, "miss")], "user_id bigint, epoch bigint, reason string")
    got = {(r["user_id"], r["epoch"], r["reason"]): r["verdict"] for r in Z.guard_jobs(jobs, current, live).collect()}
    assert got == {(1, 3, "miss"): "already_built", (1, 3, "refill"): "build", (2, 1, "invalidation"): "stale", (2, 2, "invalidation"): "build", (3, 2, "prewarm"): "build", (4, 0, "miss"): "build"}
    late = Z.active(gen, current, F.lit("2024-01-01 01:00:00").cast("timestamp"), S)
    assert late.count() == 0  # the pointer expires before the payload
    assert Z.expired_status(gen, F.lit("2024-01-01 01:00:00").cast("timestamp")).where("status = 'ready'").count() == 3


def test_retention_keeps_two(spark):
    gen = generations(spark, [(f"f{i}", 1, i, i, "2024-01-01 00:00:00", False, []) for i in range(5)])
    assert sorted(r["feed_id"] for r in Z.retained(gen, S).collect()) == ["f3", "f4"]


def test_pages_and_refill(spark):
    items = [(i, i, None) for i in range(1, 26)]
    gen = generations(spark, [("f", 1, 0, 1, "2024-01-01", False, items), ("short", 2, 0, 1, "2024-01-01", True, items), ("empty", 3, 0, 1, "2024-01-01", False, [])])
    reads = spark.createDataFrame([(1, 1, "f", 0, 10), (2, 1, "f", 10, 10), (3, 1, "f", 20, 10), (4, 1, "old", 0, 10), (5, 2, "short", 20, 10), (6, 3, "empty", 0, 10)], "request_id int, user_id bigint, feed_id string, offset int, page_size int")
    served = Z.pages(reads, gen)
    got = {r["request_id"]: r for r in served.collect()}
    assert [x["item_id"] for x in got[2]["page"]] == list(range(11, 21)) and got[2]["next_offset"] == 20 and got[2]["has_more"]
    assert got[3]["next_offset"] is None and got[3]["served"] == 5 and got[4]["status"] == "gone"
    assert sorted(r["request_id"] for r in Z.needs_refill(served, S).collect()) == [2, 3]


# --- streams ---


def test_stream_intake_is_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"event_id": f"e{i % 7}", "user_id": 1, "item_id": i % 7, "type": "like", "created_at": "2024-01-01T00:00:00Z"} for i in range(20)]
    for n in range(4):
        (src / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 5 : n * 5 + 5]))
    log = str(tmp_path / "log")
    for run in "ab":
        stream = intake.read_events(spark, str(src), LOG)
        intake.exact_intake(stream, log, LOG, str(tmp_path / f"ck{run}")).awaitTermination()
    assert spark.read.parquet(log).count() == 7


def test_a_failed_callback_sees_its_rows_again(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"event_id": f"e{n}{i}", "user_id": i, "item_id": 1, "type": "like", "created_at": f"2024-01-0{n + 1}T00:00:00Z"}) for i in range(4)))
    seen, failed = [], []

    def steps(recorded, batch_id):
        rows = [(r["user_id"], r["steps"]) for r in intake.epoch_steps(recorded).collect()]
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("once")
        seen.extend(rows)

    log, check = str(tmp_path / "log"), str(tmp_path / "ck")
    with pytest.raises(Exception):
        intake.exact_intake(intake.read_events(spark, str(src), LOG), log, LOG, check, on_batch=steps).awaitTermination()
    intake.exact_intake(intake.read_events(spark, str(src), LOG), log, LOG, check, on_batch=steps).awaitTermination()
    assert failed == [1] and sorted(seen) == sorted([(i, 1) for i in range(4)] * 3)
    assert spark.read.parquet(log).count() == 12


def test_publishing_again_adds_nothing(spark, tmp_path):
    feeds = spark.createDataFrame([("f1", 1), ("f2", 2)], "feed_id string, user_id bigint")
    notes = spark.createDataFrame([("f1", 7), ("f1", 8), ("f2", 7)], "feed_id string, item_id bigint")
    path, side = str(tmp_path / "feeds"), str(tmp_path / "notes")
    for _ in range(2):
        sinks.publish(feeds, path, notes, side)
    sinks.publish(feeds.union(spark.createDataFrame([("f3", 3)], feeds.schema)), path)
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(side).count() == 3


def test_late_events_count_in_running_counters(spark, tmp_path):
    from feedloom.operators import history as H
    from feedloom.streaming import trending

    src = tmp_path / "in"
    src.mkdir()
    for n, day in enumerate(("30", "29", "28")):  # newest first
        (src / f"{n}.json").write_text("\n".join(json.dumps({"event_id": f"{n}{i}", "user_id": i, "item_id": i % 3, "type": "like", "created_at": f"2024-01-{day}T0{i}:30:00Z"}) for i in range(5)))
    stream = intake.read_events(spark, str(src), LOG)
    trending.keep_counters(stream, str(tmp_path / "c"), str(tmp_path / "ck")).awaitTermination()
    got = trending.engagement_from_counters(trending.read_counters(spark, str(tmp_path / "c")), S)
    want = H.engagement(spark.read.schema(LOG).json(str(src)), S)
    assert {r["item_id"]: round(r["engagement"], 9) for r in got.collect()} == {r["item_id"]: round(r["engagement"], 9) for r in want.collect()}


def test_failed_ingest_outcomes(spark):
    cols = "file_name string, checksum string, duration_s double, width int, height int, creator_id string, creator_handle string"
    rows = [("a", None, 5.0, 4, 8, None, None), ("b", "x", None, 4, 8, "c0", None), ("c", "x", 5.0, 4, 8, None, None), ("d", "x", None, 4, 8, "c1", None), ("e", "y", 0.0, 4, 8, None, None)]
    none = spark.createDataFrame([], "item_id bigint, checksum string, creator_id string, creator_handle string")
    got = {r["file_name"]: r for r in N.ingest_outcomes(spark.createDataFrame(rows, cols), none, S).collect()}
    assert [(got[k]["status"], got[k]["reason"]) for k in "abcde"] == [("rejected", "unreadable"), ("rejected", "probe_failed"), ("ingested", None), ("duplicate", None), ("rejected", "probe_failed")]


def test_running_profiles_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [
        {"event_id": str(i), "user_id": i % 3, "item_id": i % 5, "type": ["like", "skip", "view", "impression"][i % 4], "created_at": f"2024-01-{1 + (i * 7) % 28:02d}T00:00:00Z"}
        for i in range(60)
    ]
    for n in range(3):
        (src / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 20 : n * 20 + 20]))
    vectors = spark.createDataFrame([(i, [float(i), 1.0 - i]) for i in range(4)], "item_id bigint, vector array<double>")
    out = str(tmp_path / "out")
    sums = profile_state.running_profiles(intake.read_events(spark, str(src), LOG), vectors, 2, S)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    latest = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("ref_us", "sums", "pos", "neg", "effective", "skipped", "total"), "batch").alias("v")).select("user_id", "v.*")
    got = {r["user_id"]: r for r in profile_state.read_at(latest, S.now, S).collect()}
    ev = spark.read.schema(LOG).json(str(src))
    whole = profile_state.profiles_from_sums(profile_state.decayed_sums(ev.join(vectors, "item_id", "left"), S.now, 2, S), S)
    halves = [profile_state.decayed_sums(ev.where(c).join(vectors, "item_id", "left"), S.now, 2, S) for c in ("event_id < '3'", "event_id >= '3'")]
    merged = {r["user_id"]: r for r in profile_state.profiles_from_sums(profile_state.merge_sums(*halves), S).collect()}
    for r in whole.collect():
        for other in (got[r["user_id"]], merged[r["user_id"]]):
            assert other["vector"] == pytest.approx(r["vector"]) and other["positive_signal"] == pytest.approx(r["positive_signal"])
            assert (other["effective"], other["skipped_no_features"], other["interaction_count"]) == (r["effective"], r["skipped_no_features"], r["interaction_count"])


def test_missing_or_wrong_vectors_fail(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "item_id bigint, vector array<double>")
    assert L.require_dimension(good, 2).count() == 2
    for bad in (good.limit(0), good.union(spark.createDataFrame([(3, [1.0])], good.schema)), good.union(spark.createDataFrame([(4, None)], good.schema))):
        with pytest.raises(ValueError, match="expected vectors of length 2"):
            L.require_dimension(bad, 2)
