"""Greedy re-ranking with hard caps. Sequential inside one user, parallel over users.

A group is one user's candidates, at most the sum of the source limits, so it always fits one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings

RESULT = (
    "user_id bigint, item_id bigint, rank int, creator_id string, base_score double, "
    "diversity_penalty double, final_score double, relaxed boolean"
)


def pick(base, vectors, creators, div, edges, limit: int, s: Settings):
    """Greedy selection for many users at once: row, rank, penalty and relaxed flag of every pick, user by user.

    The rows of user ``u`` are ``edges[u]:edges[u + 1]``, sorted by item id (so the first of equal scores is the smaller id). ``creators`` are codes, -1 for
    none, ``div`` slots, filled up with -1. When no row of a user is allowed any more, the rest follows by score.
    """
    sizes = np.diff(edges)
    n, wide = len(sizes), int(sizes.max(initial=0))
    owner, place = np.repeat(np.arange(n), sizes), np.arange(edges[-1]) - np.repeat(edges[:-1], sizes)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype="f8"))[:, None]
    unit = np.zeros((n, wide, vectors.shape[1]))
    unit[owner, place] = np.divide(vectors, norms, out=np.zeros(vectors.shape), where=norms > 0)
    score, creator, open_ = np.full((n, wide), -np.inf), np.full((n, wide), -1), np.zeros((n, wide), dtype=bool)
    score[owner, place], creator[owner, place], open_[owner, place] = base, creators, True
    rows, cols = np.nonzero(div >= 0)
    names, slot = np.unique(div[rows, cols], return_inverse=True)
    tags = np.zeros((n, wide, len(names)), dtype=bool)
    tags[owner[rows], place[rows], slot] = True
    tag_used, creator_used, closest = np.zeros((n, len(names)), dtype=int), np.zeros((n, wide), dtype=int), np.zeros((n, wide))
    relaxed, everyone, found = np.zeros(n, dtype=bool), np.arange(n), []
    for step in range(min(limit, wide)):
        allowed = open_ & (creator_used < s.max_same_creator)
        if step < s.tag_cap_window:
            full = tag_used >= s.max_same_tag
            if full.any():
                allowed &= ~(tags & full[:, None, :]).any(axis=2)
        relaxed |= ~allowed.any(axis=1)
        penalty = s.diversity_lambda * closest
        worth = np.where(allowed, score - penalty, -np.inf)
        if relaxed.any():
            worth[relaxed] = np.where(open_[relaxed], score[relaxed], -np.inf)
        best = worth.argmax(axis=1)
        valid = open_[everyone, best]
        found.append((edges[:-1] + best, np.full(n, step + 1, dtype=np.int32), penalty[everyone, best], relaxed.copy(), valid))
        if step < s.tag_cap_window:
            tag_used += tags[everyone, best] & valid[:, None]
        chosen = creator[everyone, best]
        creator_used += (creator == chosen[:, None]) & (chosen >= 0)[:, None]
        open_[everyone, best] = False
        np.maximum(closest, np.einsum("ucd,ud->uc", unit, unit[everyone, best]), out=closest)
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0), np.zeros(0, bool)
    *columns, valid = (np.stack(x, axis=1).ravel() for x in zip(*found))
    return [c[valid] for c in columns]


def rerank(scored: DataFrame, limit: int, s: Settings) -> DataFrame:
    """``scored`` needs user_id, item_id, base_score, creator_id, div_slots, vector. For candidates that name items of a table, ``user_slices`` moves less."""

    def one_user(t: pa.Table) -> pa.Table:
        t = t.sort_by("item_id")
        vec = t["vector"].combine_chunks()
        matrix = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
        base = t["base_score"].to_numpy()
        names = t["creator_id"].to_pylist()
        code = {c: j for j, c in enumerate(sorted({n for n in names if n}))}
        creators = np.array([code.get(n, -1) for n in names])
        slots = t["div_slots"].combine_chunks()
        sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
        div = np.full((len(slots), int(sizes.max(initial=0))), -1)
        div[np.repeat(np.arange(len(slots)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = slots.flatten().to_numpy(zero_copy_only=False)
        at, rank, penalty, relaxed = pick(base, matrix, creators, div, np.array([0, len(base)]), limit, s)
        picked = t.select(["user_id", "item_id", "creator_id", "base_score"]).take(pa.array(at, pa.int64()))
        return pa.table(
            {
                "user_id": picked["user_id"],
                "item_id": picked["item_id"],
                "rank": pa.array(rank, pa.int32()),
                "creator_id": picked["creator_id"],
                "base_score": picked["base_score"],
                "diversity_penalty": pa.array(penalty, pa.float64()),
                "final_score": pa.array(base[at] - penalty, pa.float64()),
                "relaxed": pa.array(relaxed, pa.bool_()),
            }
        )

    return (
        scored.select("user_id", "item_id", "base_score", "creator_id", "div_slots", "vector")
        .groupBy("user_id")
        .applyInArrow(one_user, RESULT)
    )


def relaxation(selected: DataFrame) -> DataFrame:
    return selected.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if("relaxed").alias("relaxed_count"),
        F.bool_or("relaxed").alias("diversity_relaxed"),
    )
