"""SimHash fingerprints and near-duplicate components, searched with sharded BK-trees.

A fingerprint has 64 bits for each lane. Its bits are cut into blocks; fingerprints that agree in a block meet in that block's
bucket. With more blocks than the radius has bits this misses nothing (two fingerprints within the radius leave one block
untouched). Buckets become BK-trees, many per task as one forest, and a bucket larger than a shard is cut into shards whose trees are
sent to every other shard of the bucket. A search follows only the edges within the radius. What leaves a task is a
spanning forest of the links it found, never all pairs of a group.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_text, merge_labels, set_aside, text_key
from feedloom.llm.components import components
from feedloom.session import materialise

#: Distinct fingerprints of one bucket that share a tree.
SHARD_ROWS = 8192
#: Texts and shingles of one candidate group that are compared in one task; larger groups are cut.
GROUP_ROWS, GROUP_SHINGLES = 4096, 1 << 22
#: Sets up to this size also meet by equal shingles: with so few, the spread of the estimate is wider.
SMALL_SET = 40
#: Query-node pairs that a search holds at a time.
FRONTIER = 1 << 21


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, lower-cased A-Z and joined by spaces; a shorter text is one run."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(found) - words]]
    return np.fromiter((digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[words - 1 :])), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian bits that more than half the hashes have set; lane 0 takes the hashes as they are, the others remix them."""
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = hashes[at : at + (1 << 16)]
            if lane:
                h = (h ^ np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(32)
            counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _key, fp binary), one row per input row. A text without words, or null, has all bits zero."""
    source = id_text(docs, id_col, text_col).withColumn("_key", text_key("text"))
    kind = source.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words), lanes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(fps, pa.binary())], ["doc_id", "_key", "fp"])

    return source.select("doc_id", "_key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, _key bigint, fp binary")


# ---- BK-trees, many at a time ----


def build_forest(fps: np.ndarray, tree: np.ndarray):
    """BK-trees of the distinct rows of ``fps`` (n, lanes), one per value of ``tree`` (sorted).

    Returns roots (first row of each tree) and the edges sorted by (parent, distance): keys ``parent * span + distance`` and child rows.
    """
    n, span = len(fps), fps.shape[1] * 64 + 1
    first = np.r_[True, tree[1:] != tree[:-1]]
    roots = np.flatnonzero(first)
    at = roots[np.cumsum(first) - 1]  # the node that each row has come down to
    rows = np.flatnonzero(~first)
    at = at[rows]
    keys, children = [], []
    while len(rows):
        edge = at * span + np.bitwise_count(fps[rows] ^ fps[at]).sum(1, dtype=np.int64)
        key, where, back = np.unique(edge, return_index=True, return_inverse=True)
        keys.append(key)
        children.append(rows[where])
        at = rows[where][back]
        stays = np.ones(len(rows), bool)
        stays[where] = False
        rows, at = rows[stays], at[stays]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    return roots, key[order], child[order], n


def search_forest(forest, fps: np.ndarray, queries: np.ndarray, roots: np.ndarray, radius: int):
    """(query row, node row) of every node within ``radius`` of a query, starting from the query's own root."""
    _, key, child, _ = forest
    span = fps.shape[1] * 64 + 1
    q, node = np.arange(len(queries)), roots
    found_q, found_n = [], []
    while len(q):
        d = np.bitwise_count(queries[q] ^ fps[node]).sum(1, dtype=np.int64)
        hit = d <= radius
        found_q.append(q[hit])
        found_n.append(node[hit])
        low = np.searchsorted(key, node * span + np.maximum(d - radius, 0))
        high = np.searchsorted(key, node * span + np.minimum(d + radius, span - 1), side="right")
        width = high - low
        q = np.repeat(q, width)
        node = child[np.repeat(low - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())] if width.sum() else np.zeros(0, np.int64)
    return np.concatenate(found_q) if found_q else q, np.concatenate(found_n) if found_n else q


def _link_group(fps: np.ndarray, tree: np.ndarray, asks: np.ndarray, radius: int):
    """Spanning links of rows sorted by tree. ``asks`` marks rows that only search (the other shard); trees are made of the rest.

    Where a tree has no asking rows, its own rows search it.
    """
    kept = np.flatnonzero(~asks)
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forest = build_forest(fps[kept], tree[kept])
    roots = forest[0]
    mixed = np.zeros(int(tree[-1]) + 1, bool)
    mixed[tree[asks]] = True
    search = np.flatnonzero(asks | ~mixed[tree])
    root_of = np.full(int(tree[-1]) + 1, -1)
    root_of[tree[kept][roots]] = roots
    search = search[root_of[tree[search]] >= 0]
    sizes = np.bincount(tree[kept], minlength=int(tree[-1]) + 1)
    cost = np.cumsum(sizes[tree[search]])
    labels = np.arange(len(fps))
    start = 0
    while start < len(search):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + FRONTIER, side="right")))
        part = search[start:stop]
        q, node = search_forest(forest, fps[kept], fps[part], root_of[tree[part]], radius)
        a, b = part[q], kept[node]
        other = a != b
        labels = merge_labels(labels, a[other], b[other])
        start = stop
    rows = np.flatnonzero(labels != np.arange(len(fps)))
    return rows, labels[rows]


def block_bounds(bits: int, blocks: int, width: int | None = None) -> list[tuple[int, int]]:
    """(start, width) of the blocks: all bits dealt evenly, or the first ``blocks`` runs of ``width`` bits."""
    if width:
        return [(i * width, width) for i in range(min(blocks, bits // width))]
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(distinct: DataFrame, radius: int, bounds: list[tuple[int, int]], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) binary: links between distinct fingerprints (column fp) that join the same pairs as all links within ``radius``."""

    def route(batches):
        for batch in batches:
            fps = batch.column(0)
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1)
            keys = [(bits[:, s : s + w].astype(np.int64) @ (1 << np.arange(w, dtype=np.int64)[::-1])) | (i << 40) for i, (s, w) in enumerate(bounds)]
            for key in keys:
                yield pa.RecordBatch.from_arrays([fps, pa.array(key)], ["fp", "bucket"])

    routed = distinct.select("fp").mapInArrow(route, "fp binary, bucket bigint")
    hot = routed.groupBy("bucket").count().where(F.col("count") > shard_rows).select(F.col("bucket").alias("_b"), F.ceil(F.col("count") / shard_rows).cast("int").alias("n"))
    sharded = routed.join(hot, routed.bucket == hot["_b"], "left").select("fp", "bucket", F.coalesce("n", F.lit(1)).alias("n"))
    sharded = sharded.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    met = sharded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("fp", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("asks"))
    met = met.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def link(batches):
        waiting: list[pa.Table] = []

        def work(rows: pa.Table):
            fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(rows.num_rows, -1)
            marks = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("bucket", "low", "high")])
            new = np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(0)]
            a, b = _link_group(fps, np.cumsum(new) - 1, rows.column("asks").to_numpy().astype(bool), radius)
            fp = rows.column("fp").combine_chunks()
            return pa.RecordBatch.from_arrays([fp.take(pa.array(a)), fp.take(pa.array(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(waiting)
            marks = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("bucket", "low", "high")])
            last = int(np.flatnonzero((marks != marks[:, -1:]).any(0))[-1]) + 1 if (marks != marks[:, -1:]).any() else 0
            if last:  # the group that the batch ends in may go on in the next
                yield work(rows.slice(0, last))
            waiting = [rows.slice(last)]
        if waiting and sum(t.num_rows for t in waiting):
            yield work(pa.concat_tables(waiting))

    return met.mapInArrow(link, "a binary, b binary").distinct()


def simhash_components(
    docs: DataFrame,
    words: int = 5,
    radius: int = 4,
    lanes: int = 1,
    blocks: int | None = None,
    block_bits: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, _key, fp binary, component_id), one row per input row, in any order; ``_key`` is a hash of the text.

    ``component_id`` is the smallest doc_id among all rows that links reach, the row's own included; it is null only where
    no reachable row has an id. Texts that are null, empty or without words share the fingerprint zero and are linked like any others.
    Repeated rows share a fingerprint and so a component; other columns of the input are not read. An empty table gives an empty result.

    By default ``radius + 1`` blocks cover all bits and the search is exact. With ``block_bits`` the first ``blocks`` runs of so many
    bits are taken and a pair is found with the probability that one of them is equal.
    """
    bits = 64 * lanes
    bounds = block_bounds(bits, blocks or radius + 1, block_bits)
    marked = materialise(fingerprints(docs, words, lanes, id_col, text_col))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(distinct, radius, bounds, shard_rows))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(by_fp, marked.fp == by_fp["_fp"]).select("doc_id", "_key", "fp", "component_id")


def similarity_radius(lanes: int, similarity: float) -> int:
    """Differing bits to expect of two texts of equal length whose shingle sets have this Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return round(64 * lanes * math.acos(cosine) / math.pi)


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` has in common with any other at ``similarity`` or more, at least."""
    return max(math.ceil(n * similarity - 1e-9), 1)


def set_fingerprints(source: DataFrame, words: int, lanes: int, similarity: float) -> DataFrame:
    """(doc_id, _key, fp, small): fingerprints over different shingles, and of small sets the lowest shingles, one of which every similar set has among its own."""

    def run(batches):
        for batch in batches:
            fps, small = [], []
            for text in batch.column("text").to_pylist():
                found = np.unique(shingle_hashes(text, words))
                fps.append(fingerprint(found, lanes))
                prefix = found[: len(found) - least_overlap(len(found), similarity) + 1] if 0 < len(found) <= SMALL_SET / similarity else found[:0]
                small.append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(fps, pa.binary()), pa.array(small, pa.list_(pa.int64()))], ["doc_id", "_key", "fp", "small"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", "_key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, _key bigint, fp binary, small array<bigint>")


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of sorted shingles the first set that links of Jaccard ``similarity`` or more reach; empty sets are alike."""
    sizes, labels = np.array([len(x) for x in sets]), np.arange(len(sets))

    def alike(x, y):
        low, high = sorted((sizes[x], sizes[y]))
        if low < least_overlap(high, similarity) and high:
            return False
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return both >= similarity * (low + high - both) - 1e-9

    def join(x, y):
        low, high = sorted((labels[x], labels[y]))
        labels[labels == high] = low

    leaders: list[int] = []  # most of a group is settled by its first few texts
    for x in range(len(sets)):
        hit = next((y for y in leaders if alike(x, y)), None)
        if hit is not None:
            join(x, hit)
        elif len(leaders) < 8:
            leaders.append(x)
    # What is left: pairs of different labels, of which one at least is outside the largest. They share one of their rarest shingles.
    most = np.bincount(labels).argmax()
    outside = np.flatnonzero(labels != most)
    if not len(outside):
        return labels
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings: dict[int, list[int]] = {}
    prefixes = []
    for x, ids in enumerate(np.split(back, np.cumsum(sizes)[:-1])):
        rare = ids[np.lexsort((ids, count[ids]))][: sizes[x] - least_overlap(sizes[x], similarity) + 1]
        prefixes.append(rare.tolist())
        for i in prefixes[-1]:
            postings.setdefault(i, []).append(x)
    for x in outside:
        near = np.unique(np.fromiter((y for i in prefixes[x] for y in postings[i]), np.int64))
        for y in near[labels[near] != labels[x]]:
            if labels[x] != labels[y] and alike(x, y):
                join(x, y)
    return labels


def similar_texts(groups: DataFrame, similarity: float, words: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between the nodes of ``groups`` (root, node, text) that join the same nodes as all pairs of a root at Jaccard ``similarity`` or more."""

    def shingle(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            columns = [batch.column("root"), batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["root", "node", "shingles"])

    sets = groups.select("root", "node", F.col("text").cast("binary").alias("text")).mapInArrow(shingle, "root binary, node binary, shingles binary")
    sets = materialise(sets.dropDuplicates(["node"]))
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / group_rows, F.sum(F.length("shingles")) / (8 * GROUP_SHINGLES))).cast("int")
    shards = sets.groupBy("root").agg(F.greatest(cuts, F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("root").alias("_r"), "n")
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    met = sets.join(shards, sets.root == shards["_r"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("n = 1 or own != other")
    met = met.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")
    met = met.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")

    def link(batches):
        def work(nodes, sets):
            labels = similar_sets(sets, similarity)
            rows = np.flatnonzero(labels != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in rows], pa.binary()), pa.array([nodes[labels[i]] for i in rows], pa.binary())], ["a", "b"])

        group, nodes, sets = None, [], []
        for batch in batches:
            for *key, node, content in zip(*(c.to_pylist() for c in batch.columns)):
                if key != group and nodes:
                    yield work(nodes, sets)
                    nodes, sets = [], []
                group = key
                nodes.append(node)
                sets.append(np.frombuffer(content, np.uint64))
        if nodes:
            yield work(nodes, sets)

    return met.mapInArrow(link, "a binary, b binary")


def keep_one_of_each(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, lanes: int = 8, blocks: int = 39, block_bits: int = 13,
    id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose id is the smallest the group's links reach. Columns stay as they are.

    A link is a pair of texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more. Fingerprints only
    propose groups: they join where no more bits differ than that similarity makes expect plus three spreads, small sets also by
    common shingles, and every group is then compared on the shingles themselves. A pair at just 0.8 shares one of 39
    blocks of 13 bits with probability 0.984, a closer one almost surely; small sets miss none.
    Rows that repeat id and text leave one; rows without id stay where no row with an id is in their group. Texts without words are one group.
    """
    docs, restore = set_aside(docs, "_llm_key", "_llm_id", "_llm_k")
    keyed = docs.withColumn("_llm_key", text_key(f"`{text_col}`"))
    source = id_text(docs, id_col, text_col).withColumn("_key", text_key("text"))
    marked = materialise(set_fingerprints(source, words, lanes, similarity))
    classes = materialise(marked.groupBy("fp", "_key").agg(F.min("doc_id").alias("first_id"), F.first("small").alias("small")))
    bits, expected = 64 * lanes, similarity_radius(lanes, similarity)
    radius = expected + math.ceil(3 * math.sqrt(expected * (1 - expected / bits)))
    shared = classes.select("fp", F.explode("small").alias("h")).distinct()
    lowest = shared.groupBy("h").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("_h"), "b")
    small = shared.join(lowest, shared.h == lowest["_h"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    proposed = components(links(classes.select("fp").distinct(), radius, block_bounds(bits, blocks, block_bits)).union(small))
    node = F.concat("fp", F.unhex(F.lpad(F.hex("_key"), 16, "0")))
    rooted = classes.join(proposed, classes.fp == proposed.node, "left").select(node.alias("node"), "_key", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    crowded = rooted.groupBy("root").count().where("count > 1").select(F.col("root").alias("_r"))
    asked = rooted.join(crowded, rooted.root == crowded["_r"], "left_semi").select("root", "node", "first_id", F.col("_key").alias("_k"))
    texts = source.join(asked, source.doc_id.eqNullSafe(asked.first_id) & (source["_key"] == asked["_k"])).select("root", "node", "text")
    found = components(similar_texts(texts, similarity, words, group_rows)).select(F.col("node").alias("_n"), F.col("root").alias("_to"))
    grouped = rooted.join(found, rooted.node == found["_n"], "left").select("_key", "first_id", F.coalesce("_to", "node").alias("head"))
    kept = grouped.groupBy("head").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id")).alias("low")).select(F.col("head").alias("_t"), "low.first_id")
    kept = grouped.join(kept.withColumnRenamed("first_id", "component_id"), grouped["head"] == kept["_t"]).where(F.col("first_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("first_id").alias("_llm_id"), F.col("_key").alias("_llm_k")).distinct()
    staying = keyed.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_k")), "left_semi")
    return restore(staying.dropDuplicates([id_col, "_llm_key"]).select(*[f"`{c}`" for c in docs.columns]))
