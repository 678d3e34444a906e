"""Removal of repeated line runs, from a suffix array over line ids built by distributed prefix doubling.

A document is its sequence of lines with words. Lines that occur once anywhere cut it into segments; only lines that repeat take part
further on. Prefix doubling names the first 1, 2, 4, ... lines of every suffix by their place in sorted order, so suffixes with equal names at a
level are one interval of the suffix array whose common prefix has at least that many lines. A run of n lines belongs to the interval
given by the names of its first and last 2^k lines (2^k <= n < 2^(k+1)): that is its longest-common-prefix interval, and its members
are the copies of the run.

Of a repeated run of at least ``min_words`` words all copies but the first lose their lines. To find every such run it is enough to
look at the shortest ones that start, and those that end, at each line: their union is the union of the maximal ones.
The shortest have at most ``min_words`` lines, which bounds the number of doubling rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import set_aside, text_key
from feedloom.session import materialise

MIN_WORDS = 50
_DOC = ("doc_id", "_key")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, line, h1, h2, words) for every line with words, written once; documents that repeat id and text count once.

    From here on lines are hashes: the texts themselves are neither shuffled nor read again before the final cut.
    """
    split = docs.select(*_DOC, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    words = F.size(F.regexp_extract_all("content", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    hashed = split.select(*_DOC, "line", F.xxhash64("content").alias("h1"), F.xxhash64(F.concat("content", F.lit("\n"))).alias("h2"), words.alias("words")).where("words > 0")
    return materialise(hashed.dropDuplicates([*_DOC, "line"]))


def _names(pairs: DataFrame, *columns: str) -> DataFrame:
    """Distinct ``columns`` with ``name``, a number that ascends in their sorted order over all partitions."""
    ordered = pairs.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialise(ordered.withColumn("name", F.monotonically_increasing_id()))


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_k"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _key, first, last): maximal stretches of lines to delete, counted from 0, of documents (doc_id, _key, text).

    A run is deleted where the same lines occur earlier: in a smaller doc_id (nulls last, then by text key) or further up in the same document.
    Lines without words are passed over in comparing runs; those inside a deleted stretch go with it.
    """
    lines = _lines(docs)
    repeats = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    ids = _names(repeats, "h1", "h2")
    by_doc = Window.partitionBy(*_DOC).orderBy("line")
    # Unique lines stay until segments are cut; they get no name.
    named = lines.join(ids, ["h1", "h2"], "left").select(*_DOC, "line", "words", F.col("name").alias("c0"))
    cut = named.withColumn("segment", F.sum(F.col("c0").isNull().cast("int")).over(by_doc)).where("c0 is not null")
    spot = Window.partitionBy(*_DOC, "segment").orderBy("line")
    walked = cut.withColumn("spot", F.row_number().over(spot)).withColumn("after", F.sum("words").over(spot))
    walked = walked.withColumn("before", F.col("after") - F.col("words"))
    in_segment = Window.partitionBy(*_DOC, "segment")
    ahead, behind = in_segment.orderBy("before").rangeBetween(0, min_words - 1), in_segment.orderBy("after").rangeBetween(1 - min_words, 0)
    n_ahead, n_behind = F.count(F.lit(1)).over(ahead), F.count(F.lit(1)).over(behind)
    sized = walked.select(
        *_DOC, "segment", "spot", "line", "c0",
        F.when(F.max("after").over(ahead) - F.col("before") >= min_words, n_ahead).alias("forward"),
        F.when(F.col("after") - F.min("before").over(behind) >= min_words, n_behind).alias("backward"),
    )
    places = materialise(sized)
    longest = places.agg(F.max(F.greatest("forward", "backward"))).first()[0] or 0

    level = 1
    while 2**level <= longest:
        half, column, was = 2 ** (level - 1), f"c{level}", f"c{level - 1}"
        # A suffix that ends within its segment sorts before all that go on.
        paired = places.withColumn("_next", F.coalesce(F.lead(was, half).over(in_segment.orderBy("spot")), F.lit(-1)))
        names = _names(paired, was, "_next").withColumnRenamed("name", column)
        places = materialise(paired.join(names, [was, "_next"]).drop("_next"))
        level += 1

    at = in_segment.orderBy("spot")
    rows = []
    for k in range(level):
        low, high = 2**k, 2 ** (k + 1) - 1
        for kind in ("forward", "backward"):
            # The run is the ``size`` lines from here on, or up to here; its names are those of its first and its last 2^k lines.
            near = places.where(F.col(kind).between(low, high)).select(*_DOC, "segment", "spot", F.col(kind).alias("size"))
            start = F.col("spot") if kind == "forward" else F.col("spot") - F.col("size") + 1
            near = near.withColumn("start", start).withColumn("tail", F.col("start") + F.col("size") - low)
            rows.append(near.select(*_DOC, "segment", "start", "size", F.lit(k).alias("level"), "tail"))
    if not rows:
        return places.select(*_DOC, F.col("line").alias("first"), F.col("line").alias("last")).limit(0)
    runs = rows[0]
    for more in rows[1:]:
        runs = runs.unionByName(more)
    runs = runs.distinct()
    # All names of a place as one array: level k is its k-th element.
    named_at = places.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("segment").alias("_s"), F.col("spot").alias("_p"), "line", F.array(*[f"c{k}" for k in range(level)]).alias("names"))
    here = named_at.select("_id", "_k", "_s", "_p", F.col("line").alias("first"), F.col("names").alias("start_names"))
    there = named_at.select("_id", "_k", "_s", "_p", F.col("names").alias("tail_names"))
    runs = runs.join(here, _same_doc(runs, here) & (runs["segment"] == here["_s"]) & (runs["start"] == here["_p"])).drop("_id", "_k", "_s", "_p")
    runs = runs.join(there, _same_doc(runs, there) & (runs["segment"] == there["_s"]) & (runs["tail"] == there["_p"])).drop("_id", "_k", "_s", "_p")
    runs = runs.select(
        *_DOC, "segment", "start", "size", "first",
        F.element_at("start_names", F.col("level") + 1).alias("x"), F.element_at("tail_names", F.col("level") + 1).alias("y"),
    )
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "first")
    runs = materialise(runs.withColumn("place", place))
    copies = runs.groupBy("size", "x", "y").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = runs.join(copies, ["size", "x", "y"]).where("place != first_place")
    spans = later.select(*_DOC, "segment", "start", (F.col("start") + F.col("size") - 1).alias("stop")).distinct()
    # Overlapping and touching runs of a segment become one.
    order = Window.partitionBy(*_DOC, "segment").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) + 1 < F.col("start")).cast("int")).withColumn("island", F.sum("new").over(order))
    merged = grouped.groupBy(*_DOC, "segment", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    first_line = places.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("segment").alias("_s"), F.col("spot").alias("_p"), "line")
    last_line = first_line
    merged = merged.join(first_line, _same_doc(merged, first_line) & (merged["segment"] == first_line["_s"]) & (merged["start"] == first_line["_p"]))
    merged = merged.select(*_DOC, "segment", "stop", F.col("line").alias("first"))
    merged = merged.join(last_line, _same_doc(merged, last_line) & (merged["segment"] == last_line["_s"]) & (merged["stop"] == last_line["_p"]))
    return merged.select(*_DOC, "first", F.col("line").alias("last"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs taken out of the text; one row per input row, columns as before.

    ``count_col`` names a column that is set to the new text's length. The earliest copy stays: smallest doc_id, null ids last. Rows
    that repeat id and text are one document and get the same text. A text may become empty; null texts stay null. Lines without words
    go only where they lie inside a deleted stretch. A run must be the same lines, whole and byte for byte; runs of under ``min_words`` words are left alone.
    """
    docs, restore = set_aside(docs, "_llm_key", "_llm_id", "_llm_k", "_llm_cuts")
    keyed = docs.withColumn("_llm_key", text_key(f"`{text_col}`"))
    plain = keyed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("_llm_key").alias("_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    runs = repeated_runs(plain, min_words)
    cuts = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "last")).alias("_llm_cuts"))  # at most the lines of one document
    cuts = cuts.select(F.col("doc_id").alias("_llm_id"), F.col("_key").alias("_llm_k"), "_llm_cuts")
    joined = keyed.join(cuts, F.col(f"`{id_col}`").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_k")), "left")
    kept = F.filter(F.split(f"`{text_col}`", "\n"), lambda line, i: ~F.exists("_llm_cuts", lambda c: i.between(c["first"], c["last"])))
    text = F.when(F.col("_llm_cuts").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == count_col else F.col(f"`{c}`") for c in docs.columns]
    return restore(joined.select(*out))
