"""Point-in-time comparison of rankers: features as of a moment, labels from what happened after it.

A training period and a test period follow one another. The features of a period come from the log before its start and from items that existed then,
under a clock that stands at its start, so no label reaches a feature. The learned ranker is a ridge regression: its normal equations are
sums over the examples, which combine before the shuffle, and a matrix of as many rows as there are features reaches the driver.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import signals as G
from feedloom.operators import evaluation as Q
from feedloom.operators import history as H
from feedloom.operators import ranking as R
from feedloom.plans.recommend import Inputs
from feedloom.session import materialise, materialise_all

#: What the learned ranker sees; the same terms that the fixed weights combine, with the two halves of affinity apart.
TERMS = ("content_similarity", "tag_affinity", "creator_affinity", "popularity", "freshness", "fatigue", "exploration", "quality")
SCORE_DIGITS = 10


def as_of(inputs: Inputs, moment: str) -> Inputs:
    """The inputs as they were at ``moment``: earlier events, items created before, and a clock that stands there."""
    before = F.col("created_at") < F.lit(moment).cast("timestamp")
    return replace(inputs, events=inputs.events.where(before), items=inputs.items.where(before), s=inputs.s.but(now=moment))


def outcomes(events: DataFrame, start: str, end: str) -> DataFrame:
    """(user_id, item_id, label) of the pairs with a preference-changing event in [start, end): 1 where the weights add up to more than nothing.

    Pairs count whether or not they were seen before ``start``; rows without user or item have no pair and are left out.
    """
    when = F.col("created_at")
    inside = events.where((when >= F.lit(start).cast("timestamp")) & (when < F.lit(end).cast("timestamp")) & G.is_meaningful(F.col("type")))
    known = inside.where("user_id IS NOT NULL AND item_id IS NOT NULL")
    return known.groupBy("user_id", "item_id").agg((F.round(F.sum(G.event_weight(F.col("type"))), 9) > 0).cast("int").alias("label"))


def examples(inputs: Inputs, start: str, end: str) -> DataFrame:
    """(user_id, item_id, label, base_score, the terms) of outcomes in [start, end), with features as of ``start``.

    Users without history before ``start`` and items that were not eligible then have no features and no row.
    """
    then = as_of(inputs, start)
    then.pairs, items = materialise_all(then.pairs, then.ranking_items)
    profiles = materialise(then.profiles)
    labels = materialise(outcomes(inputs.events, start, end))
    pairs = labels.select("user_id", "item_id", F.array(F.lit("logged")).alias("sources"))
    scored = R.score_candidates(pairs, items, profiles, then.creator_affinity, H.recent_repetition(then.recent, items, then.tax.dim), then.s)
    return scored.select("user_id", "item_id", "base_score", *TERMS).join(labels, ["user_id", "item_id"])


def fit_ridge(rows: DataFrame, terms: tuple[str, ...] = TERMS, label: str = "label", ridge: float = 1.0) -> list[float]:
    """The weights of ``terms`` and the constant, last, that minimise squared error plus ``ridge`` times the squared weights. Without rows all are zero."""
    xs = [F.col(t) for t in terms] + [F.lit(1.0)]
    k = len(xs)
    sums = [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = rows.agg(*sums, *[F.sum(x * F.col(label)).alias(f"b{i}") for i, x in enumerate(xs)]).first()
    if row[f"g{k - 1}_{k - 1}"] is None:
        return [0.0] * k
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], np.float64)
    gram += np.diag([ridge] * (k - 1) + [0.0])
    return [float(w) for w in np.linalg.solve(gram, np.array([row[f"b{i}"] for i in range(k)], np.float64))]


def learned_score(weights: list[float], terms: tuple[str, ...] = TERMS) -> Column:
    total = F.lit(weights[-1])
    for w, t in zip(weights, terms):
        total = total + F.lit(w) * F.col(t)
    return F.round(total, SCORE_DIGITS)


def judge(rows: DataFrame, score: str, k: int) -> DataFrame:
    """One row: users with something to find, their mean NDCG, recall and hit rate at ``k``, and the AUC over all examples."""
    order = Window.partitionBy("user_id").orderBy(F.desc(score), "item_id")
    ranked = rows.select("user_id", "item_id", F.row_number().over(order).alias("rank"))
    per_user = Q.ranking_quality(ranked, rows.where("label = 1"), k)
    means = per_user.agg(F.count(F.lit(1)).alias("users"), *[F.avg(c).alias(c) for c in ("ndcg", "recall", "hit")]).withColumn("_k", F.lit(1))
    area = Q.auc(rows.select(F.col(score).alias("score"), "label")).withColumn("_k", F.lit(1))
    return means.join(F.broadcast(area), "_k").drop("_k")


def compare_rankers(inputs: Inputs, train_from: str, test_from: str, end: str, k: int = 10) -> DataFrame:
    """(ranker, users, ndcg, recall, hit, auc) of the fixed weights and of the learned ones on [test_from, end), learned on [train_from, test_from)."""
    weights = fit_ridge(examples(inputs, train_from, test_from))
    held_out = materialise(examples(inputs, test_from, end).withColumn("learned_score", learned_score(weights)))
    fixed, learned = (judge(held_out, c, k).select(F.lit(name).alias("ranker"), "*") for name, c in (("fixed", "base_score"), ("learned", "learned_score")))
    return fixed.unionByName(learned)
