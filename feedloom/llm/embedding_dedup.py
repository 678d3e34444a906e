"""Near-duplicate vectors by counting collisions on sorted one-dimensional projections.

Unit vectors of one label are projected on the axes of a random rotation. For every query each sorted projection is searched for the window of half
width w around the query's own value, and a pair's collisions are counted over all projections. The count that a pair must reach
is calibrated so that no pair is lost: differences over orthonormal axes square-sum to the squared distance, so a pair at the cosine threshold
cannot fall outside more than ``2 (1 - cosine) / w^2`` windows. Among all widths the one is taken that lets the fewest unrelated
pairs through. Pairs that reach the count are verified in double precision.

Equal vectors are one class with a multiplicity. The classes of a label are cut into blocks of bounded size; each pair of blocks is a task of its
own, and only link counts and a spanning forest leave it. The work within one label grows with the square of its different vectors: windows
that keep every pair at such a threshold hold a fixed share of them.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import merge_labels
from feedloom.llm.components import components
from feedloom.session import materialise

#: Different vectors of one label in a block; two blocks are what a task holds.
BLOCK_ROWS = 32_768
#: Links held before they are merged into the classes of a task.
HELD_LINKS = 1 << 20


def calibrate(cosine: float, axes: int, dim: int) -> tuple[float, int]:
    """(half width, least count): every pair at ``cosine`` or more reaches the count, and unrelated unit vectors rarely do."""
    squared = 2 * (1 - cosine) + 1e-9
    best = (-np.inf, sqrt(squared), axes)
    for misses in range(axes):
        width = sqrt(squared / (misses + 1)) * (1 + 1e-9)  # misses + 1 differences over this width would exceed the distance
        p = min(max(erf(width / (2 / sqrt(dim))), 1e-12), 1 - 1e-12)
        far = ((axes - misses) - axes * p) / sqrt(axes * p * (1 - p))
        best = max(best, (far, width, axes - misses))
    return best[1], best[2]


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def count_links(vectors: np.ndarray, weights: np.ndarray, asks: np.ndarray, cosine: float):
    """(links, labels) of rows: links adds up the weights of the other rows within ``cosine``; labels are their classes.

    With rows that only ask (another block), rows are compared across the two kinds alone, otherwise all with all.
    """
    n, dim = vectors.shape
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norms[:, None]
    projected = unit @ rotation(dim)
    width, least = calibrate(cosine, dim, dim)
    links, labels = np.zeros(n, np.int64), np.arange(n)
    two = bool(asks.any())
    sides = [(np.flatnonzero(asks), np.flatnonzero(~asks)), (np.flatnonzero(~asks), np.flatnonzero(asks))] if two else [(np.arange(n), np.arange(n))]
    first = min(dim, -(-dim // 2))  # after these axes most unrelated pairs can no longer reach the count
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for queries, nodes in sides:
        if not len(queries) or not len(nodes):
            continue
        there = projected[nodes]
        order = np.argsort(there[:, :first], axis=0, kind="stable").astype(np.int32)
        value = np.take_along_axis(there[:, :first], order, axis=0)
        order, value = np.ascontiguousarray(order.T), np.ascontiguousarray(value.T)
        here = projected[queries]
        low = np.stack([np.searchsorted(value[j], here[:, j] - width) for j in range(first)], axis=1)
        high = np.stack([np.searchsorted(value[j], here[:, j] + width, side="right") for j in range(first)], axis=1)
        for i, q in enumerate(queries):
            hits = np.zeros(len(nodes), np.int16)
            for j in range(first):
                hits[order[j, low[i, j] : high[i, j]]] += 1
            near = np.flatnonzero(hits >= least - (dim - first))
            near = near[nodes[near] != q]
            total = hits[near] + (np.abs(there[near, first:] - here[i, first:]) <= width).sum(1)
            near = nodes[near[total >= least]]
            if len(near):
                exact = (vectors[near] @ vectors[q]) / (norms[near] * norms[q])
                near = near[exact >= cosine]
                links[q] += weights[near].sum()
                held.append((np.full(len(near), q), near))
                size += len(near)
                if size >= HELD_LINKS:
                    labels = merge_labels(labels, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
    if held:
        labels = merge_labels(labels, *map(np.concatenate, zip(*held)))
    return links, labels


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(label, dim, h1, h2, vector, first_id, n, cls): the different usable vectors of rows (vec_id, vector, label, h1, h2)."""
    usable = vectors.where("usable")
    grouped = usable.groupBy("label", "dim", "h1", "h2").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return materialise(grouped.withColumn("cls", F.monotonically_increasing_id()))


def embedding_components(
    rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows link where labels are equal and not null, vectors equally long and their cosine in double precision is ``cosine`` or more. A vector that is null,
    empty, zero, or holds a null or a number that is not finite links with nothing: it has no links, is its own component and kept. Equal vectors
    and rows that repeat an id are rows of their own and link like any others. ``component_id`` is the smallest id that links reach; it is null, and the
    row kept, only where no reachable row has an id. Other columns are not read; an empty table gives an empty result.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector"), F.col(f"`{label_col}`").alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    keyed = plain.withColumns({"usable": usable, "dim": F.size("vector"), "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(77), "vector")})
    classes = vector_classes(keyed)

    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod("h1", F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("asks"), "cls", "n", "vector")

    def link(table: pa.Table) -> pa.Table:
        vectors = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        cls, weights = table.column("cls").to_numpy(), table.column("n").to_numpy()
        links, labels = count_links(vectors, weights, table.column("asks").to_numpy().astype(bool), cosine)
        found = np.flatnonzero(links)
        return pa.table({"cls": cls[found], "links": links[found], "root": cls[labels[found]]})

    linked = materialise(met.groupBy("label", "dim", "low", "high").applyInArrow(link, "cls bigint, links bigint, root bigint"))
    counts = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    joined = classes.select("label", "dim", "h1", "h2", "first_id", "n", "cls").join(counts, "cls", "left").join(roots, "cls", "left")
    joined = joined.withColumns({"root": F.coalesce("root", "cls"), "links": F.coalesce("links", F.lit(0)) + F.col("n") - 1})
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("low_id"))
    known = joined.join(lowest, "root").select("label", "dim", "h1", "h2", "links", "low_id")
    bare = keyed.select("vec_id", "label", "dim", "h1", "h2", "usable")
    out = bare.where("usable").join(known, ["label", "dim", "h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), F.col("low_id").alias("component_id"))
    alone = bare.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
