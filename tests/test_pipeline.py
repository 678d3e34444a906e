"""Operators against plain-Python restatements of their rules, on random inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.operators import diversity as Y
from feedloom.operators import encoding as E
from feedloom.operators import frames as R
from feedloom.operators import pairwise as W
from feedloom.operators import profiles as P
from feedloom.operators.ranked_lists import list_positions, take_unseen
from feedloom.taxonomy import neutral
from test_expressions import plain_fnv

S = Settings()
TAX = neutral()
VEC = "array<double>"


def unit(rng, n, d):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


# --- encoding ---


def plain_encode(row):
    vec = [0.0] * TAX.dim
    slot = {(f, v): s for f, _, v, s, *_ in TAX.rows}
    weight = {r[0]: r[4] for r in TAX.rows}
    for field, kind in TAX.fields:
        values = [v for v in dict.fromkeys([row[field]] if kind == "single" else row[field]) if v != "unknown"]
        for v in values:
            vec[slot[(field, v)]] = weight[field] / len(values) ** 0.5 * row["confidence"].get(field, 0.5)
    size = sum(x * x for x in vec) ** 0.5
    return [x / size for x in vec] if size else vec


def test_encoding(spark):
    rnd = random.Random(4)
    values = {f: [r[2] for r in TAX.rows if r[0] == f] for f, _ in TAX.fields}
    rows = []
    for i in range(60):
        row = {"item_id": i, "taxonomy_version": 1, "confidence": {"trait": rnd.random()} if i % 3 else {}}
        for f, k in TAX.fields:
            row[f] = rnd.choice(values[f]) if k == "single" else rnd.choices(values[f], k=rnd.randint(0, 4))
        rows.append(row)
    rows.append({"item_id": 60, "taxonomy_version": 1, "confidence": {}, "size_band": "unknown", "finish": "other", "grade": "unknown", "trait": [], "object": []})
    schema = "item_id bigint, taxonomy_version int, confidence map<string,double>, size_band string, finish string, grade string, trait array<string>, object array<string>"
    got = {r["item_id"]: r["vector"] for r in E.encode_features(spark.createDataFrame(rows, schema), TAX).collect()}
    for row in rows:
        assert got[row["item_id"]] == pytest.approx(plain_encode(row), abs=1e-12)
    assert TAX.dim == 30 and TAX.slot_names[0] == "size_band:none" and TAX.slot_names[-1] == "object:widget"


# --- profiles ---


def test_profile_rules(spark):
    ev = [
        ("view", 1, 10, "2024-01-31"), ("like", 1, 11, "2024-01-24"), ("skip", 1, 10, "2024-01-31"), ("impression", 1, 12, "2024-01-31"),
        ("like", 1, 13, "2024-01-31"), ("like", 2, 10, "2024-02-09"), ("like", 1, 99, "2024-01-31"),
    ]
    events = spark.createDataFrame([(i, u, it, t, at) for i, (t, u, it, at) in enumerate(ev)], "event_id bigint, user_id bigint, item_id bigint, type string, at string").withColumn("created_at", F.col("at").cast("timestamp"))
    items = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, None)], "item_id bigint, creator_id string")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0])], f"item_id bigint, vector {VEC}")
    hist = P.history(P.signal_pairs(events, S), items, vectors)
    got = {r["user_id"]: r for r in P.build_profiles(hist, vectors, ["f:x", "f:y"], 1, S).collect()}
    one = got[1]
    assert (one["interaction_count"], one["effective"], one["skipped_no_features"], one["is_cold_start"]) == (5, 3, 1, True)
    total = 0.25 + 0.5 + 0.5
    assert one["vector"] == pytest.approx([-0.25 / total, 0.5 / total])
    assert one["positive_signal"] == pytest.approx(0.75) and one["negative_signal"] == pytest.approx(0.5)
    assert got[2]["vector"] == pytest.approx([1.0, 0.0])  # a future event counts in full
    aff = {(r["user_id"], r["creator_id"]): (r["score"], r["interaction_count"]) for r in P.creator_affinity(hist, S).collect()}
    assert aff[(1, "a")] == (pytest.approx(0.25 / total), 3) and set(aff) == {(1, "a"), (2, "a")}


def test_profile_is_independent_of_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(5)), int(rng.integers(20)), ["like", "skip", "view"][i % 3], f"2024-01-{1 + i % 30:02d}") for i in range(400)]
    vec = unit(rng, 20, 3)
    items = spark.createDataFrame([(i, "c") for i in range(20)], "item_id bigint, creator_id string")
    vectors = spark.createDataFrame([(i, vec[i].tolist()) for i in range(20)], f"item_id bigint, vector {VEC}")
    seen = []
    for parts, order in ((1, 1), (7, -1)):
        df = spark.createDataFrame(rows[::order], "event_id bigint, user_id bigint, item_id bigint, type string, at string").repartition(parts)
        ev = df.withColumn("created_at", F.col("at").cast("timestamp"))
        hist = P.history(P.signal_pairs(ev, S), items, vectors)
        seen.append(sorted((r["user_id"], [round(x, 9) for x in r["vector"]]) for r in P.build_profiles(hist, vectors, ["a:1", "a:2", "a:3"], 1, S).collect()))
    assert seen[0] == seen[1]


# --- pairwise scoring ---


def _plain_top(users, items, need):
    out = {}
    for u, v in enumerate(users):
        sims = np.round(items @ v, 10)
        order = sorted(range(len(items)), key=lambda i: (-sims[i], i))[: need[u]]
        out[u] = order
    return out


@pytest.mark.parametrize("block,pivots", [(10_000, 64), (40, 64), (40, 3)])
def test_nearest_items_is_exact(spark, block, pivots):
    rng = np.random.default_rng(7)
    items = unit(rng, 300, 6)
    items[50:150] = items[50]  # a third of the items are copies of one
    users = unit(rng, 25, 6)
    need = [int(x) for x in rng.integers(1, 60, size=25)]
    s = S.but(block_items=block, max_pivots=pivots, block_users=10)
    u = spark.createDataFrame([(i, users[i].tolist(), need[i]) for i in range(25)], f"user_id bigint, vector {VEC}, need bigint")
    it = spark.createDataFrame([(i, items[i].tolist()) for i in range(300)], f"item_id bigint, vector {VEC}")
    scored = W.nearest_items(u, it, W.Sizes(25, 300), s)
    ranked = W._first_n(scored).join(u.select("user_id", "need"), "user_id").where("rank <= need")
    got = {}
    for r in ranked.orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got == _plain_top(users, items, need)


@pytest.mark.parametrize("block", [10_000, 30])
def test_top_hashed_is_exact(spark, block):
    rnd = random.Random(3)
    n_items, k = 400, 12
    seen = {(u, i) for u in range(12) for i in rnd.sample(range(n_items), 395 if u == 3 else rnd.randint(0, 80))}
    counts = {u: sum(1 for a, _ in seen if a == u) for u in range(12)}
    users = spark.createDataFrame(list(counts.items()), "user_id bigint, seen_count bigint")
    items = spark.range(n_items).select(F.col("id").alias("item_id"))
    seen_df = spark.createDataFrame(list(seen), "user_id bigint, item_id bigint")
    s = S.but(block_items=block, block_users=5)
    got = {}
    for r in W.top_hashed(users, items, seen_df, "2024-01-31", k, W.Sizes(12, n_items), s).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    for u in range(12):
        rest = [i for i in range(n_items) if (u, i) not in seen]
        want = sorted(rest, key=lambda i: (-plain_fnv(f"{u}|{i}|2024-01-31"), i))[:k]
        assert got.get(u, []) == want


@pytest.mark.parametrize("chunk,head", [(128, 4096), (4, 8)])
def test_lists_give_first_unseen(spark, chunk, head):
    rnd = random.Random(9)
    lists = {"a": rnd.sample(range(100), 30), "b": rnd.sample(range(100), 60), "c": rnd.sample(range(100), 100)}
    rows = spark.createDataFrame([(k, float(-n), i) for k, ids in lists.items() for n, i in enumerate(ids)], "list_key string, key double, item_id bigint").repartition(5)
    placed = list_positions(rows, [F.desc("key"), F.col("item_id")])
    assert {(r["list_key"], r["item_id"]): r["pos"] for r in placed.collect()} == {(k, i): n + 1 for k, ids in lists.items() for n, i in enumerate(ids)}
    seen = {(u, i) for u in range(6) for i in rnd.sample(range(100), 15 * u)}
    asks = [(u, "s", k, p, sum(1 for a, _ in seen if a == u)) for u in range(6) for p, k in enumerate("abc")]
    requests = spark.createDataFrame(asks, "user_id bigint, source string, list_key string, priority int, seen_count bigint")
    seen_df = spark.createDataFrame(list(seen), "user_id bigint, item_id bigint")
    s = S.but(list_chunk=chunk, list_head=head)
    got = {}
    for r in take_unseen(requests, placed, seen_df, 3, 100, {"s": 20}, s).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    for u in range(6):
        want = [i for i in dict.fromkeys(lists["a"] + lists["b"] + lists["c"]) if (u, i) not in seen][:20]
        assert got[u] == want


# --- diversity ---


def plain_rerank(cands, limit, s):
    """Direct restatement: every step rescans everything."""
    def cos(a, b):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return 0.0 if na == 0 or nb == 0 else float(a @ b / (na * nb))

    left, picked = {c["item_id"]: c for c in cands}, []

    def pen(c):
        return s.diversity_lambda * max([0.0] + [cos(c["vector"], p["vector"]) for p, _ in picked])

    def blocked(c):
        if c["creator_id"] and sum(p["creator_id"] == c["creator_id"] for p, _ in picked) >= s.max_same_creator:
            return True
        return len(picked) < 10 and any(sum(t in p["div_slots"] for p, _ in picked[:10]) >= s.max_same_tag for t in c["div_slots"])

    while len(picked) < limit:
        free = [c for c in left.values() if not blocked(c)]
        if not free:
            break
        best = min(free, key=lambda c: (-(c["base_score"] - pen(c)), c["item_id"]))
        picked.append((best, False))
        del left[best["item_id"]]
    for c in sorted(left.values(), key=lambda c: (-c["base_score"], c["item_id"])):
        if len(picked) >= limit:
            break
        picked.append((c, True))
    return [(c["item_id"], relaxed) for c, relaxed in picked]


def test_rerank_matches_direct_rule(spark):
    rng, rnd = np.random.default_rng(2), random.Random(2)
    rows = []
    for u in range(20):
        vec = unit(rng, 25, 4)
        for i in range(25):
            creator = rnd.choice([None, "", "x", "y", "z"][: 2 + u % 4])
            rows.append((u, i, round(rnd.random(), 3), creator, sorted(rnd.sample(range(5), rnd.randint(0, 3))), vec[i].tolist()))
    df = spark.createDataFrame(rows, f"user_id bigint, item_id bigint, base_score double, creator_id string, div_slots array<int>, vector {VEC}").repartition(5)
    got = {}
    for r in Y.rerank(df, 18, S).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["item_id"], r["relaxed"]))
    relaxed = 0
    for u in range(20):
        cands = [dict(item_id=r[1], base_score=r[2], creator_id=r[3], div_slots=r[4], vector=np.array(r[5])) for r in rows if r[0] == u]
        assert got[u] == plain_rerank(cands, 18, S)
        relaxed += sum(x for _, x in got[u])
    assert relaxed > 0


# --- frames ---


def test_scene_snap_matches_loop(spark):
    rnd = random.Random(5)
    cases = []
    for i in range(40):
        ts = sorted({round(rnd.uniform(0, 30), 3) for _ in range(rnd.randint(1, 8))})
        cuts = [round(rnd.uniform(0, 30), 2) for _ in range(rnd.randint(0, 10))]
        cases.append((i, ts, cuts))
    df = spark.createDataFrame(cases, "item_id int, ts array<double>, cuts array<double>")
    got = {r["item_id"]: r["x"] for r in df.select("item_id", R.snap_to_scenes(F.col("ts"), F.col("cuts"), S).alias("x")).collect()}
    for i, ts, cuts in cases:
        used = []
        for t in ts:
            options = [(abs(c - t), c) for c in (np.floor((c + 0.15) * 1000 + 0.5) / 1000 for c in sorted(cuts)) if abs(c - t) <= 1.5 and c not in used]
            used.append(min(options, key=lambda o: o[0])[1] if options else t)
        assert got[i] == pytest.approx(sorted(set(used)) if cuts else ts)


def test_near_duplicates_match_loop(spark):
    rnd = random.Random(6)
    rows = []
    for item in range(30):
        h = rnd.getrandbits(63)
        for t in range(rnd.randint(1, 12)):
            for _ in range(rnd.choice([0, 1, 2, 9])):
                h ^= 1 << rnd.randrange(63)
            rows.append((item, float(t), h))
    df = spark.createDataFrame(rows, "item_id bigint, ts_sec double, hash bigint").repartition(4)
    got = {}
    for r in R.drop_near_duplicates(df, 6, 3).where("kept").orderBy("item_id", "ts_sec").collect():
        got.setdefault(r["item_id"], []).append(r["ts_sec"])
    for item in range(30):
        frames = [r for r in rows if r[0] == item]
        kept, gone = [frames[0]], []
        for f in frames[1:]:
            d = bin(kept[-1][2] ^ f[2]).count("1")
            (gone if d <= 6 else kept).append((d, f) if d <= 6 else f)
        gone.sort(key=lambda x: -x[0])
        while len(kept) < 3 and gone:
            kept.append(gone.pop(0)[1])
        assert got[item] == sorted(f[1] for f in kept)


@pytest.mark.parametrize("duration,n", [(None, 1), (0.0, 1), (0.5, 1), (3.0, 3), (30.0, 6), (30.1, 8), (61.0, 12), (121.0, 16), (9999.0, 16)])
def test_frame_budget(spark, duration, n):
    df = spark.createDataFrame([(1, duration)], "item_id bigint, duration_s double")
    row = R.frame_plan(df, S).first()
    assert row["n_frames"] == n
    assert row["timestamps"] == sorted(set(row["timestamps"])) and all(0 <= t < (duration or 1) for t in row["timestamps"])


# --- users without history ---


def test_users_without_history_get_the_global_sources(spark):
    from feedloom.plans.feed_build import build_feeds
    from feedloom.plans.queries_feed import tag_inputs

    inputs = tag_inputs(spark, "/root/testdata/sf0.001")
    newcomer, old = 10**9, inputs.events.first()["user_id"]
    jobs = spark.createDataFrame([(newcomer, 0, "prewarm"), (old, 0, "miss")], "user_id bigint, epoch bigint, reason string")
    current = spark.createDataFrame([], "user_id bigint, epoch bigint")
    made = {r["user_id"]: r for r in build_feeds(jobs, inputs, lambda: current, lambda: current, seq=1, with_sidecar=True).generations.collect()}
    assert set(made) == {newcomer, old}
    assert made[newcomer]["cold_start"] and not made[newcomer]["candidate_shortage"] and len(made[newcomer]["items"]) == S.feed_size
    assert not made[old]["cold_start"]


def test_profiles_of_newcomers(spark):
    known = P.build_profiles(
        P.history(
            P.signal_pairs(spark.createDataFrame([(1, 7, 10, "like", "2024-01-30")], "event_id bigint, user_id bigint, item_id bigint, type string, at string").withColumn("created_at", F.col("at").cast("timestamp")), S),
            spark.createDataFrame([(10, "a")], "item_id bigint, creator_id string"),
            spark.createDataFrame([(10, [1.0, 0.0])], f"item_id bigint, vector {VEC}"),
        ),
        spark.createDataFrame([(10, [1.0, 0.0])], f"item_id bigint, vector {VEC}"), ["f:x", "f:y"], 1, S,
    )
    users = spark.createDataFrame([(7,), (8,), (8,)], "user_id bigint")
    got = {r["user_id"]: r for r in P.with_cold_users(known, users, ["f:x", "f:y"], 1).collect()}
    assert set(got) == {7, 8} and P.with_cold_users(known, users, ["f:x", "f:y"], 1).columns == known.columns
    assert got[8]["vector"] == [0.0, 0.0] and got[8]["is_cold_start"] and got[8]["interaction_count"] == 0 and got[7]["interaction_count"] == 1
