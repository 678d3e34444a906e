"""Point-in-time examples, the ridge solution and the metrics of rankers against plain computation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.plans import ranker_eval as RE
from feedloom.plans.queries_feed import tag_inputs

SF = "/root/testdata/sf0.001"
T0, T1 = "2024-01-15 00:00:00", "2024-01-22 00:00:00"


def rows_of(df):
    return sorted((r.user_id, r.item_id, r.label, *(round(r[t], 9) for t in RE.TERMS)) for r in df.collect())


def test_no_later_event_reaches_a_feature(spark):
    """Later events, however many, change labels only; items of later date have no row."""
    i = tag_inputs(spark, SF)
    plain = RE.examples(i, T0, T1)
    later = i.events.where(F.col("created_at") >= F.lit(T1).cast("timestamp"))
    flood = i.events.unionByName(later).unionByName(later.withColumn("type", F.lit("like")))
    again = RE.examples(RE.replace(i, events=flood), T0, T1)
    got = rows_of(plain)
    assert got and got == rows_of(again)
    made = {r.item_id: str(r.created_at) for r in i.items.collect()}
    assert all(made[item] < T0 for _, item, *_ in got)
    first = {r.user_id for r in i.events.where(F.col("created_at") < F.lit(T0).cast("timestamp")).collect()}
    assert {u for u, *_ in got} <= first


def test_outcomes_edges(spark):
    at = ["2024-01-14 23:59:59", T0, "2024-01-16 00:00:00", "2024-01-21 23:59:59", T1]
    rows = [(1, 1, "like", at[0]), (1, 1, "skip", at[1]), (1, 2, "skip", at[2]), (1, 2, "like", at[3]), (1, 3, "like", at[4]), (1, 4, "impression", at[2]), (None, 4, "like", at[2]), (2, None, "like", at[2])]
    events = spark.createDataFrame(rows, "user_id long, item_id long, type string, at string").select("user_id", "item_id", "type", F.col("at").cast("timestamp").alias("created_at"))
    got = {(r.user_id, r.item_id): r.label for r in RE.outcomes(events, T0, T1).collect()}
    assert got[1, 1] == 0 and got[1, 2] == 1 and (1, 3) not in got and all(None not in k for k in got)
    assert RE.outcomes(events.limit(0), T0, T1).count() == 0


def test_ridge_is_the_least_squares_solution(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    x[:, 1] = x[:, 0] * 2  # columns that repeat one another still have a solution
    y = (x[:, 0] > 0.1).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    got = RE.fit_ridge(df, ("a", "b"))
    full = np.c_[x, np.ones(300)]
    want = np.linalg.solve(full.T @ full + np.diag([1, 1, 0]), full.T @ y)
    assert np.allclose(got, want)
    assert RE.fit_ridge(df.limit(0), ("a", "b")) == [0.0, 0.0, 0.0]


def test_judge_by_hand(spark):
    rng = random.Random(2)
    rows = [(u, i, rng.randrange(2), rng.randrange(4) / 4) for u in range(12) for i in range(9)] + [(99, 1, 0, 0.5)]
    got = RE.judge(spark.createDataFrame(rows, "user_id int, item_id int, label int, s double"), "s", 3).first()
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ndcg = []
    for u in {r[0] for r in rows if r[2]}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (-r[3], r[1]))
        ideal = sum(1 / math.log2(k + 2) for k in range(min(3, sum(r[2] for r in mine))))
        ndcg.append(sum(r[2] / math.log2(k + 2) for k, r in enumerate(mine[:3])) / ideal)
    assert got.users == len(ndcg) and got.ndcg == pytest.approx(sum(ndcg) / len(ndcg)) and got.auc == pytest.approx(auc)
