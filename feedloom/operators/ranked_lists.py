"""Ranked lists shared by many users, and taking "the first K I have not seen" from them.

Trending, newest-first and per-tag lists are the same for everybody; only the seen filter differs. A user
who has seen ``s`` items needs at most the first ``K + s`` rows of a list, so the work is linear in users and
events and never users x items. Positions come from one distributed sort, with no single-task window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.session import materialise

_TASK_USERS = 1024
_ROW_BITS = 33
_POS_BITS = 48  # list positions stay below 2^48, priorities above


def list_positions(rows: DataFrame, order: list[Column], longest: int | None = None, bound: int = 0) -> DataFrame:
    """Number the rows of each ``list_key`` 1, 2, ... in ``order`` (which must be a total order).

    Global sort, then ``monotonically_increasing_id`` (partition, row) plus one offset per (list, partition).
    The sorted rows are written once, so offsets and rows come from the same partitions even if an executor is
    lost. One list may hold any share of the rows: the sort splits inside a list. The offset table has at most
    one row per list and per sort partition; its measured size decides how it is joined. When ``longest`` (no list is longer) is within ``bound``, a window per
    list is safe and saves the write.
    """
    if longest is not None and longest <= bound:
        whole = Window.partitionBy("list_key")
        return rows.select(
            "list_key", F.row_number().over(whole.orderBy(*order)).cast("bigint").alias("pos"), "item_id",
            F.count(F.lit(1)).over(whole).alias("list_size"),
        )
    placed = materialise(rows.orderBy("list_key", *order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_m", _ROW_BITS))
    runs = placed.groupBy("list_key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    earlier = Window.partitionBy("list_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "list_key",
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("list_key")).alias("list_size"),
    )
    return placed.join(offsets, ["list_key", "_part"]).select(
        "list_key", (F.col("_m") + F.col("_shift")).alias("pos"), "item_id", "list_size"
    )


def take_unseen(
    requests: DataFrame, lists: DataFrame, seen: DataFrame, n_lists: int, longest: int, limits: dict[str, int], s: Settings, n_users: int | None = None
) -> DataFrame:
    """First K unseen items per (user, source).

    ``requests``: (user_id, source, list_key, priority, seen_count); a source may name several lists, tried in
    ``priority`` order. ``n_lists`` bounds the number of lists (vocabulary size plus a constant) and ``longest``
    the length of any of them (the item count). Requests marked ``alone`` (optional column) are the only one of their user and source:
    with nothing seen the head of their list is the answer, and no row of it is moved. ``n_users`` (optional) fixes how many tasks share the work: requests are
    few bytes, by which Spark would choose few tasks, but each pulls hundreds of rows.

    A list is skipped when an earlier one alone is long enough to fill the user's limit.

    The head of every list is at most ``n_lists * list_head`` rows and is broadcast when that bound fits;
    beyond the head only users with long histories remain, and those rows join by shuffle.
    """
    if n_users is not None:
        requests = requests.repartition(max(1, math.ceil(n_users / _TASK_USERS)), "user_id")
    if "alone" not in requests.columns:
        requests = requests.withColumn("alone", F.lit(False))
    chunk = F.floor((F.col("pos") - 1) / s.list_chunk)
    chunked = lists.withColumn("chunk", chunk)
    head_chunks = s.list_head // s.list_chunk
    sizes = lists.where(F.col("pos") == 1).select("list_key", "list_size")
    limit_of = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in limits.items()])
    earlier = Window.partitionBy("user_id", "source").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    full = limit_of + F.col("seen_count")
    wanted = (
        requests.join(F.broadcast(sizes), "list_key")
        .withColumn("_before", F.when(~F.col("alone"), F.max("list_size").over(earlier)))
        .where(F.col("_before").isNull() | (F.col("_before") < full))
        .withColumn("need", F.least(full, F.col("list_size")))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("need") - 1) / s.list_chunk))))
        .select("user_id", "source", "list_key", "priority", "need", "chunk", (F.col("alone") & (F.col("seen_count") == 0)).alias("settled"))
    )
    rows = chunked.select("list_key", "chunk", "pos", "item_id")
    head = rows.where(F.col("chunk") < head_chunks)
    if n_lists * min(longest, s.list_head) <= s.broadcast_rows:
        head = F.broadcast(head)

    def pull(asked: DataFrame) -> DataFrame:
        got = asked.where(F.col("chunk") < head_chunks).join(head, ["list_key", "chunk"])
        if longest > s.list_head:
            tail = rows.where(F.col("chunk") >= head_chunks)
            got = got.unionByName(asked.where(F.col("chunk") >= head_chunks).join(tail, ["list_key", "chunk"]))
        return got.where(F.col("pos") <= F.col("need")).select("user_id", "source", "item_id", "priority", "pos")

    unseen = pull(wanted.where(~F.col("settled"))).join(seen, ["user_id", "item_id"], "left_anti")
    place = F.shiftleft(F.col("priority").cast("bigint"), _POS_BITS) + F.col("pos")
    best = unseen.groupBy("user_id", "item_id", "source").agg(F.min(place).alias("place"))
    order = Window.partitionBy("user_id", "source").orderBy("place", "item_id")
    chosen = (
        best.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= max(limits.values())) & (F.col("rank") <= limit_of))
        .select("user_id", "item_id", "source", "rank")
    )
    heads = pull(wanted.where(F.col("settled"))).select("user_id", "item_id", "source", F.col("pos").cast("int").alias("rank"))
    return chosen.unionByName(heads)
