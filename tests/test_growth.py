"""Plans and results whose cost must not outgrow the input."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from feedloom import session
from feedloom.config import Settings
from feedloom.functions import hashing as X
from feedloom.operators import candidates as C
from feedloom.operators import evaluation as Q
from feedloom.operators import history as H
from feedloom.operators import newcomers as N
from feedloom.operators import pairwise as W
from feedloom.operators import ranked_lists
from feedloom.operators import ranking as R
from feedloom.operators import user_slices as U
from feedloom.operators import validation as L
from feedloom.operators.diversity import rerank
from feedloom.operators.ranked_lists import take_unseen
from feedloom.plans import recommend as plan
from feedloom.plans.queries_feed import tag_inputs
from feedloom.plans.recommend import recommend
from feedloom.session import materialise
from feedloom.sources import tables as T
from feedloom.taxonomy import neutral


def test_label_comparison_broadcasts_no_labels(spark):
    tax = neutral()
    gold = spark.range(40).select(F.col("id").alias("item_id"), *[(F.lit("x") if k == "single" else F.array(F.lit("x"))).alias(f) for f, k in tax.fields])
    predicted = gold.select(F.lit("a").alias("model"), "*")
    compared = Q.compare(Q.long_labels(gold, tax, ("item_id",)), Q.long_labels(predicted, tax, ("model", "item_id")))
    assert "BroadcastHashJoin" not in compared._jdf.queryExecution().executedPlan().toString()
    assert compared.where("score = 1").count() == 40 * len(tax.fields)


def test_users_are_moved_once_to_the_items(spark):
    """Tiny blocks used to send each user's vector to every block: 300 users x 300 blocks."""
    rng = np.random.default_rng(5)
    items, people = rng.normal(size=(300, 8)), rng.normal(size=(300, 8))
    vec = "array<double>"
    u = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(people)], f"user_id bigint, vector {vec}, need bigint")
    it = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], f"item_id bigint, vector {vec}")
    got = W.nearest_items(u, it, W.Sizes(300, 300), Settings(block_items=1, block_users=1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit(people) @ unit(items).T, 10), axis=1, kind="stable")[:, :7]
    assert {(r.user_id, r.item_id) for r in got.collect()} == {(i, int(j)) for i, row in enumerate(want) for j in row}


def test_users_ask_for_few_buckets_of_hashes(spark):
    """Items of a bucket that a user meets do not grow with the catalogue."""
    users = spark.range(200).select(F.col("id").alias("user_id"), F.lit(0).cast("bigint").alias("seen_count"))
    for n in (2_000, 16_000):
        items = spark.range(n).select(F.col("id").alias("item_id"))
        asked = users.select("user_id", F.ceil(F.lit((1 - 112 / n) * 2**32)).alias("floor"))
        bits = {11 + digits: max(0, math.ceil(math.log2(min(9 * 10 ** (digits - 1), n) / 64))) for digits in range(1, 6)}
        met = W._arcs(asked, bits).join(W._item_values(items, "2024-01-31", bits), "key").count()
        assert met < 200 * 1_000
    top = W.top_hashed(users, items, spark.createDataFrame([], "user_id bigint, item_id bigint"), "2024-01-31", 5, W.Sizes(200, n), Settings(block_items=64, block_users=40))
    plain = X.fnv_grid(X.fnv_states([f"{u}|" for u in range(200)]), [f"{i}|2024-01-31" for i in range(n)])
    want = np.argsort(-plain.astype("i8"), axis=1, kind="stable")[:, :5]
    assert {(r.user_id, r["rank"], r.item_id) for r in top.collect()} == {(u, k + 1, int(i)) for u, row in enumerate(want) for k, i in enumerate(row)}


def test_newcomers_are_scored_without_a_user_side(spark):
    """Users without history get the heads of the lists and item terms: no row of theirs meets a seen set or a profile."""
    requests = spark.createDataFrame([(1, "s", "a", 0, 0, True), (2, "s", "a", 0, 1, True)], "user_id bigint, source string, list_key string, priority int, seen_count bigint, alone boolean")
    lists = spark.createDataFrame([("a", i, 10 + i, 9) for i in range(1, 10)], "list_key string, pos bigint, item_id bigint, list_size bigint")
    seen = spark.createDataFrame([(2, 11)], "user_id bigint, item_id bigint")
    got = take_unseen(requests, lists, seen, 1, 9, {"s": 3}, Settings())
    assert sorted(map(tuple, got.collect())) == [(1, 11, "s", 1), (1, 12, "s", 2), (1, 13, "s", 3), (2, 12, "s", 1), (2, 13, "s", 2), (2, 14, "s", 3)]

    i = tag_inputs(spark, "/root/testdata/sf0.001")
    ids = spark.range(990_000, 990_030).select(F.col("id").alias("user_id"))
    i.users = i.events.select("user_id").distinct().union(ids)
    _, items = i.pairs, materialise(i.ranking_items)
    profiles = materialise(i.profiles)
    cand = profiles.select("user_id").crossJoin(items.select("item_id")).withColumn("sources", F.array(F.lit("tag")))
    side = (items, profiles, i.creator_affinity, H.recent_repetition(i.recent, items, i.tax.dim), i.s)
    apart, together = (R.score_candidates(cand, *side, newcomers=x).select("user_id", "item_id", "fatigue", "exploration", "affinity", "base_score") for x in (True, False))
    assert apart.count() == together.count() and apart.exceptAll(together).isEmpty()


def test_items_are_moved_once_to_a_slice_of_users(spark):
    """Each candidate used to carry its item's vector to its user; now a slice takes an item once, and lists equal those of the plain way."""
    i = tag_inputs(spark, "/root/testdata/sf0.001")
    run = recommend(i, 12)
    assert "FlatMapGroupsInArrow" not in run.selected._jdf.queryExecution().executedPlan().toString()
    cand = materialise(run.candidates)
    items = run.items.select("item_id", "creator_id", "div_slots", "vector")
    side = items.select("item_id", U._body(F.col("vector")), U._named(F.col("creator_id")))
    for n_users, n_items in ((15, 200), (15, 10**9), (640, 10**9)):  # all items, and those that candidates name
        dealt = U._sliced(cand.select("user_id", "item_id", F.lit(0).alias("bits"), F.lit(0.0).alias("score")), side, [], n_users, n_items, 500).where(F.size("body") > 0)
        assert dealt.groupBy("slice", "a").count().where("count > 1").isEmpty() and dealt.count() <= cand.count()
    scored = run.score(cand).join(items, "item_id")
    columns = ("user_id", "item_id", "rank", "creator_id", "relaxed")
    fast, plain = run.selected.select(*columns), rerank(scored, 12, i.s).select(*columns)
    assert fast.count() > 0 and fast.exceptAll(plain).isEmpty() and plain.exceptAll(fast).isEmpty()


def test_unknown_users_items_and_creators_are_scored_without(spark):
    i = tag_inputs(spark, "/root/testdata/sf0.001")
    items, profiles = materialise(i.ranking_items), materialise(i.profiles)
    first = items.orderBy("item_id").first().item_id
    user = profiles.orderBy("user_id").first().user_id
    rows = [(user, first, ["tag", "fresh"]), (user, -5, ["tag"]), (10**12, first, ["tag"]), (None, first, ["tag"]), (user, None, ["tag"])]
    cand = spark.createDataFrame(rows, "user_id bigint, item_id bigint, sources array<string>")
    none = i.creator_affinity.limit(0), H.recent_repetition(i.recent, items, i.tax.dim).limit(0)
    got = R.score_candidates(cand, items, profiles, *none, i.s).collect()
    assert [(r.user_id, r.item_id, r.sources, r.creator_affinity, r.fatigue) for r in got] == [(user, first, ["tag", "fresh"], 0.0, 0.0)]


def test_answers_are_parsed_once(spark):
    """Every field of every branch used to salvage and parse the answer's text again."""
    answers = spark.createDataFrame([(1, '{"size_band":"small"}', 6), (2, "no json", 6)], "item_id bigint, answer string, frames_used int")
    accepted, repairs = L.ingest_answers(answers, neutral())
    for frame in (accepted, repairs):
        assert "from_json" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert accepted.isEmpty() and {(r.item_id, r.kind) for r in repairs.collect()} == {(1, "schema_validation"), (2, "invalid_json")}


def test_best_items_so_far_are_held_as_two_numbers(spark):
    """User, item and score took 24 bytes a row, and every sort copied all of them."""
    rng = np.random.default_rng(3)
    people, items = rng.normal(size=(40, 6)), np.repeat(rng.normal(size=(120, 6)), 3, axis=0)
    near = W._Nearest(np.arange(40) + 7, np.arange(40) % 9, people)
    for part in np.array_split(np.arange(360), 5):
        near.add(part, items[part])
        near.settle()
    assert [len(x.shape) for x in near.found[0]] == [1, 1]
    key, item = near.settle()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(people) @ unit(items).T, 10)
    want = {(u, int(i), scores[u, i]) for u in range(40) for i in np.argsort(-scores[u], kind="stable")[: u % 9]}
    assert {(int(u), int(i), float(x)) for u, i, x in zip(key >> 36, item, near._score_of(key))} == want


def test_features_are_kept_for_items_alone(spark):
    """Every part used to be encoded, by the few tasks that read a small file, though nine of ten are no items."""
    i = tag_inputs(spark, "/root/testdata/sf0.01")
    assert i.features.count() == i.vectors.count() == i.items.count() == 500
    plain = T.item_features(spark, "/root/testdata/sf0.01").join(i.items, "item_id", "left_semi")
    assert i.features.drop("confidence").exceptAll(plain.drop("confidence")).isEmpty()


def test_requests_are_dealt_by_number_of_users(spark):
    """4,096 requests are a few kilobytes and used to be one task's, with all the rows they pull."""
    users = spark.range(4096).select(F.col("id").alias("user_id"), F.lit("fresh").alias("source"), F.lit("fresh").alias("list_key"), F.lit(0).alias("priority"), F.lit(1).alias("seen_count"))
    lists = spark.range(1, 41).select(F.lit("fresh").alias("list_key"), F.col("id").alias("pos"), (F.col("id") * 10).alias("item_id"), F.lit(40).cast("bigint").alias("list_size"))
    seen = users.select("user_id", F.lit(10).cast("bigint").alias("item_id"))
    taken = take_unseen(users, lists, seen, 1, 40, {"fresh": 3}, Settings(), 4096)
    assert "hashpartitioning(user_id" in (plan := taken._jdf.queryExecution().executedPlan().toString()) and ", 4), REPARTITION_BY_NUM" in plan
    assert {(r.item_id, r["rank"], r.n) for r in taken.groupBy("item_id", "rank").agg(F.count(F.lit(1)).alias("n")).collect()} == {(20, 1, 4096), (30, 2, 4096), (40, 3, 4096)}


def test_sources_are_counted_by_their_bits(spark):
    i = tag_inputs(spark, "/root/testdata/sf0.001")
    run = recommend(i, 12)
    rows = run.candidates.select("user_id", "item_id", F.explode("sources").alias("source"))
    named, bits = (C.candidate_counts(run.base, c, run.items, run.seen, 420) for c in (run.candidates, C.source_bits(rows)))
    assert bits.count() == 15 and bits.exceptAll(named).isEmpty()
    assert "similar" not in C.source_bits(rows).schema.simpleString()


def test_hashes_are_made_by_many_tasks_and_written_for_those_who_ask_again(spark, monkeypatch):
    """Item ids are few bytes, so one or two tasks made 256 rows of each; and all of these rows were written although nobody asked twice."""
    made, written, plain, write = [], [], W._item_values, W.materialise
    monkeypatch.setattr(W, "_item_values", lambda items, *rest: made.append(items.rdd.getNumPartitions()) or plain(items, *rest))
    monkeypatch.setattr(W, "materialise", lambda df: written.append("value" in df.columns) or write(df))
    ids = spark.range(9000).select(F.col("id").alias("item_id")).coalesce(1)
    users = spark.range(3).select(F.col("id").alias("user_id"), F.lit(0).cast("bigint").alias("seen_count"))
    seen = spark.createDataFrame([], "user_id bigint, item_id bigint")
    top = W.top_hashed(users, ids, seen, "2024-01-31", 5, W.Sizes(3, 9000), Settings())
    assert made == [3] and not any(written)
    hashes = X.fnv_grid(X.fnv_states([f"{u}|" for u in range(3)]), [f"{i}|2024-01-31" for i in range(9000)]).astype("i8")
    assert {(r.user_id, r.item_id) for r in top.collect()} == {(u, int(i)) for u in range(3) for i in np.argsort(-hashes[u], kind="stable")[:5]}
    # Users who have seen most of what they first find ask again, and meet the rows written for them.
    best = np.argsort(-hashes[0], kind="stable")[:200]
    seen = spark.createDataFrame([(0, int(i)) for i in best], "user_id bigint, item_id bigint")
    again = W.top_hashed(users, ids, seen, "2024-01-31", 5, W.Sizes(3, 9000), Settings()).where("user_id = 0")
    assert sum(written) == 1 and {r.item_id for r in again.collect()} == {int(i) for i in np.argsort(-hashes[0], kind="stable")[200:205]}


def test_a_vector_is_moved_once_with_its_items(spark, monkeypatch):
    """Each item used to carry its vector to every slice of users, and a chunk of copies handed every user ``need`` rows of each vector."""
    rng = np.random.default_rng(11)
    kinds = rng.integers(0, 2, size=(30, 5)).astype(float)
    kinds[0] = 0
    people, of = rng.integers(0, 2, size=(25, 5)).astype(float), rng.integers(0, 30, size=900)
    need = rng.integers(1, 60, size=25)
    u = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(people, need))], "user_id bigint, vector array<double>, need bigint")
    it = spark.createDataFrame([(i, kinds[k].tolist()) for i, k in enumerate(of)], "item_id bigint, vector array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    order = np.argsort(-np.round(unit(people) @ unit(kinds[of]).T, 10), axis=1, kind="stable")
    want = {(i, int(j)) for i, row in enumerate(order) for j in row[: need[i]]}
    for listed in (65_536, 300):  # a vector's items in one list, and dealt over three
        monkeypatch.setattr(W, "_LIST_ITEMS", listed)
        for settings in (Settings(), Settings(block_items=64, block_users=9)):
            got = W.nearest_items(u, it, W.Sizes(25, 900), settings)
            assert "collect_list(item_id" in got._jdf.queryExecution().optimizedPlan().toString()
            assert {(r.user_id, r.item_id) for r in got.collect()} == want
    near = W._Nearest(np.arange(25), np.full(25, 10), people)
    near.add(np.arange(3000), kinds, np.full(30, 100))
    assert sum(len(k) for k, _ in near.found) < 25 * 10 * 12  # 25 x 30 x 10 before, but for ties


def test_candidates_of_newcomers_are_not_written(spark, monkeypatch):
    """Those of users without history used to be written as sources and as candidates, and to cross an exchange for each source, the union and the ranking."""
    written, plain = [], session.materialise
    for module in (session, plan, W, ranked_lists):
        monkeypatch.setattr(module, "materialise", lambda df: written.append(plain(df)) or written[-1])

    def inputs():
        i = tag_inputs(spark, "/root/testdata/sf0.001")
        return i, i.events.select("user_id").distinct().union(spark.range(990_000, 990_040).select(F.col("id").alias("user_id")))

    i, users = inputs()
    i.users = users.union(users)
    run = recommend(i, 12)
    scored = plain(run.scored)
    pairs = [t for t in written if {"user_id", "item_id"} <= set(t.columns)]
    assert pairs and all(t.where("user_id >= 990000").isEmpty() for t in pairs)

    j, j.users = inputs()  # the plain way: all users take their candidates from lists and joins
    items, profiles = plain(j.ranking_items), plain(j.profiles)
    size = W.Sizes.of(profiles, items)
    base = C.user_base(profiles, j.seen)
    listed, similar, explore = (x.select("user_id", "item_id", "source") for x in C.generate(base, items, j.seen, j.tax, size, j.s).values())
    cand = plain(C.union_sources(listed.union(similar).union(explore)))
    sides = items, profiles, j.creator_affinity, H.recent_repetition(j.recent, items, j.tax.dim)
    want = plain(R.score_candidates(cand, *sides, j.s))
    assert want.where("user_id >= 990000").count() > 40 * 100

    def same(a, b):
        b = b.select(*a.columns)
        return a.count() == b.count() and a.exceptAll(b).isEmpty()

    assert same(scored, want) and same(run.candidates, cand)
    assert same(run.base.select("user_id", "vector", "is_cold_start", "seen_count"), base)
    lists = ("user_id", "item_id", "rank", "creator_id", "relaxed")
    assert same(run.selected.select(*lists), rerank(want.join(items.select("item_id", "creator_id", "div_slots", "vector"), "item_id"), 12, j.s).select(*lists))
    monkeypatch.setattr(N, "_HELD_ITEMS", 60)  # a catalogue in parts
    monkeypatch.setattr(N, "_PACKED", 7)
    monkeypatch.setattr(N, "_CHUNK_ROWS", 500)
    assert size.items > 120 and same(plain(run._new), want.where("user_id >= 990000"))


def test_best_hashes_of_newcomers_by_items_of_any_length(spark, monkeypatch):
    rng = np.random.default_rng(8)
    ids = np.unique(np.r_[rng.integers(-900, 1000, 40), rng.integers(10**6, 10**8, 90), [2**63 - 1, -(2**63), 0]])
    columns = "item_id bigint, created_at timestamp, engagement double, popularity double, freshness double, quality double, quality_available boolean"
    rows = [(int(x), datetime(2024, 1, 1 + n % 20), 1.0 if n % 9 == 0 else None, 0.5, None if n == 3 else n / 7, 0.0, n % 2 == 0) for n, x in enumerate(ids)]
    items, people = spark.createDataFrame(rows, columns), [*range(500), -4, 10**12]
    users = spark.createDataFrame([(u,) for u in [*people, None]], "user_id bigint")
    grid = X.fnv_grid(X.fnv_states([f"{u}|" for u in people]), [f"{i}|2024-01-31" for i in ids]).astype("i8")
    order = np.argsort(-grid, axis=1, kind="stable")
    for k, held in ((11, 10**6), (11, 30), (10**4, 10**6), (0, 10**6)):
        monkeypatch.setattr(N, "_HELD_ITEMS", held)
        s = Settings(source_limits={"similar": 1, "tag": 1, "trending": 5, "fresh": 4, "explore": k})
        got = N.scored_terms(users, items, W.Sizes(len(people) + 1, len(ids)), s).toPandas()
        assert not got.duplicated(["user_id", "item_id"]).any() and set(got.user_id) == set(people)
        explored = got[got.bits & 16 > 0]
        assert set(zip(explored.user_id, explored.item_id)) == {(u, int(ids[i])) for u, best in zip(people, order) for i in best[:k]}
        at = np.searchsorted(ids, got.item_id)
        assert (got.exploration * 2**32 == grid[np.searchsorted(people[:500], got.user_id.clip(0, 499)), at])[got.user_id.between(0, 499)].all()
        assert (got.freshness.isna() == (at == 3)).all() and np.allclose(got.freshness.fillna(3 / 7), at / 7) and (got.quality_available == (at % 2 == 0)).all()
        for bit, n in ((4, 5), (8, 4)):
            assert (got[got.bits & bit > 0].groupby("user_id").size() == n).all() and got[got.bits & bit > 0].item_id.nunique() == n
    empty = items.limit(0)
    assert N.scored_terms(users, empty, W.Sizes(9, 0), s).isEmpty() and N.scored_terms(users.limit(0), items, W.Sizes(0, 9), s).isEmpty()


def test_source_rows_are_combined_where_they_are_scored(spark, monkeypatch):
    """Candidates used to be combined by an exchange of their own, and written, before they were scored or selected."""
    written, plain = [], session.materialise
    for module in (session, plan):
        monkeypatch.setattr(module, "materialise", lambda df: written.append(plain(df)) or written[-1])
    run = recommend(tag_inputs(spark, "/root/testdata/sf0.001"), 12)
    scored, selected = plain(run.scored), plain(run.selected)
    assert written and not any("sources" in t.columns for t in written)
    cand = run.candidates
    assert cand.count() < run.per_source.count()
    want, lists = run.score(cand), U.selected(cand, *run._sides, run.size.users, run.size.items, 12, run.inputs.s)
    for got, one in ((scored, want), (selected, lists)):
        one = plain(one.select(*got.columns))
        assert got.count() == one.count() > 0 and got.exceptAll(one).isEmpty()
