from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions import hashing as X
from feedloom.functions import media as M
from feedloom.functions import signals as G
from feedloom.functions import vectors as V

S = Settings()


def at(text):
    return F.lit(text).cast("timestamp")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def plain_fnv(text: str) -> float:
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h / 2**32


def test_weights_and_decay(spark):
    row = one(
        spark,
        *[G.event_weight(F.lit(t)).alias(t) for t in ("impression", "view", "watch", "complete", "like", "skip", "dislike", "other")],
        G.decay(F.lit(7.0), 7.0).alias("half"), G.decay(F.lit(3.0), 0.0).alias("off"),
        G.age_days(at("2024-02-05"), at(S.now)).alias("future"),
        G.signal(F.lit("skip"), at("2024-01-24"), at(S.now), 7.0).alias("skip_week"),
        G.is_meaningful(F.lit("impression")).alias("seen_only"),
    )
    assert list(row)[:8] == [0.0, 0.25, 0.25, 0.6, 1.0, -0.5, -1.0, 0.0]
    assert row["half"] == 0.5 and row["off"] == 1.0 and row["future"] == 0.0 and row["seen_only"] is False
    assert row["skip_week"] == pytest.approx(-0.25)


def test_freshness_and_recency(spark):
    week, later, edge, now = at("2024-01-24"), at("2024-02-24"), at("2024-01-28"), at(S.now)
    row = one(
        spark, G.freshness(week, now, 168.0).alias("a"), G.freshness(later, now, 168.0).alias("b"),
        G.window_recency(edge, now, 72).alias("c"), G.window_recency(later, now, 72).alias("d"),
    )
    assert list(row) == [0.5, 1.0, 0.0, 1.0]


def test_cosine_handles_zero_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, V.cosine(a, a).alias("same"), V.cosine(a, z).alias("zero"), V.normalize(a).alias("unit"), V.normalize(z).alias("z"), V.add_scaled(a, a, F.lit(2.0)).alias("sum"))
    assert row["same"] == pytest.approx(1.0) and row["zero"] == 0.0
    assert row["unit"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0, 0.0] and row["sum"] == [9.0, 12.0]


def test_vector_validity(spark):
    ok, nan, short = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(float("nan"))), F.array(F.lit(1.0))
    row = one(spark, *[V.is_valid(v, 2).alias(n) for n, v in (("ok", ok), ("nan", nan), ("short", short), ("null", F.lit(None).cast("array<double>")))])
    assert list(row) == [True, False, False, False]


def test_half_up_differs_from_half_even(spark):
    row = one(spark, V.half_up(F.lit(-0.00005), 4).alias("neg"), V.half_up(F.lit(0.00005), 4).alias("pos"))
    assert row["neg"] == 0.0 and row["pos"] == pytest.approx(0.0001)


def test_named_terms(spark):
    names = ["f:a", "f:b", "f:c"]
    p, v = F.array(F.lit(0.5), F.lit(-0.5), F.lit(0.1)), F.array(F.lit(0.5), F.lit(0.5), F.lit(1.0))
    row = one(spark, V.top_contributions(p, v, names, 5).alias("t"), V.tag_affinity(p, names, 0.2).alias("m"))
    assert [x["dimension"] for x in row["t"]] == ["f:a", "f:c"] and row["m"] == {"f:a": 0.5}


@pytest.mark.parametrize("user,item", [(3, 41), (120, 7), (99999, 123456)])
def test_exploration_hash_equals_plain_loop(spark, user, item):
    row = one(spark, X.exploration_hash(F.lit(user), F.lit(item), "2024-01-31").alias("h"))
    want = plain_fnv(f"{user}|{item}|2024-01-31")
    assert row["h"] == want and 0 <= row["h"] < 1
    grid = X.fnv_grid(X.fnv_states([f"{user}|", "7|"]), [f"{item}|2024-01-31", "5|2024-01-31"])
    assert grid[0, 0] / 2**32 == want and grid[1, 1] / 2**32 == plain_fnv("7|5|2024-01-31")


def test_gradient_hash(spark):
    down = F.array(*[F.lit(72 - i) for i in range(72)])
    flat = F.array(*[F.lit(5) for _ in range(72)])
    row = one(spark, X.long_to_hex(X.gradient_hash(down)).alias("down"), X.long_to_hex(X.gradient_hash(flat)).alias("flat"), X.hamming(X.hex_to_long(F.lit("ffffffffffffffff")), F.lit(0).cast("long")).alias("d"))
    assert row["down"] == "f" * 16 and row["flat"] == "0" * 16 and row["d"] == 64
    with pytest.raises(Exception, match="72 samples"):
        one(spark, X.gradient_hash(F.array(F.lit(1))).alias("x"))


@pytest.mark.parametrize("text,fps", [("30000/1001", 30000 / 1001), ("25", 25.0), ("0/0", None), ("a/b", None), ("", None), ("-5/1", None)])
def test_frame_rate(spark, text, fps):
    got = one(spark, M.frame_rate(F.lit(text)).alias("f"))["f"]
    assert got is None if fps is None else math.isclose(got, fps)


def test_display_and_scaled_size(spark):
    row = one(spark, M.display_size(F.lit(1920), F.lit(1080), F.lit("-90")).alias("d"), M.scaled_size(F.lit(1080), F.lit(1920), 768).alias("s"), M.scaled_size(F.lit(464), F.lit(600), 768).alias("k"))
    assert tuple(row["d"]) == (1080, 1920) and tuple(row["s"]) == (432, 768, True) and tuple(row["k"]) == (464, 600, False)


@pytest.mark.parametrize(
    "text,want",
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure! {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("  plain ", "plain"), ('{"a": 1', '{"a": 1'), ("} {", "} {")],
)
def test_salvage_json(spark, text, want):
    assert one(spark, M.salvage_json(F.lit(text)).alias("j"))["j"] == want


def test_failure_reason_round_trip(spark):
    reason = M.failure_reason(F.lit("timeout"), F.lit("x" * 2000))
    row = one(spark, F.length(reason).alias("n"), M.failure_kind(reason).alias("k"))
    assert row["n"] == 1000 and row["k"] == "timeout"
