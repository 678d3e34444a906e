"""Exact order statistics by selection: histogram passes narrow to the interval that holds the wanted rank, and only that interval is sorted.

A pass is one aggregation with at most ``BINS`` rows per wanted interval and task. The bin of a value is monotone in the value, so the bin that
holds the rank, with its own minimum and maximum, is the next interval. No pass moves or writes the rows. A pass narrows the range of values by the number
of bins, so few are needed unless values spread over hundreds of orders of magnitude.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import materialise

BINS = 4096
#: An interval of at most this many rows is sorted.
SORT_ROWS = 10_000

_INF = float("inf")


def _narrow(values: DataFrame, asked: DataFrame) -> DataFrame:
    """One pass: ``asked`` (g, name, r, lo, hi, n) with each interval replaced by the bin of it that holds rank ``r`` (from 0) of it."""
    v, lo, hi = F.col("v") * 0.5, F.col("lo") * 0.5, F.col("hi") * 0.5  # halves: the widest interval must not overflow
    bin_ = F.least(F.lit(BINS - 1), F.floor((v - lo) / (hi - lo) * BINS).cast("int"))
    intervals = asked.select("g", "lo", "hi").distinct()
    binned = values.join(intervals, "g").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy("g", "lo", "hi", bin_.alias("bin"))
    bins = binned.agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    before = F.sum("m").over(Window.partitionBy("g", "lo", "hi").orderBy("bin")) - F.col("m")  # at most BINS rows
    placed = asked.join(bins.withColumn("before", before), ["g", "lo", "hi"])
    placed = placed.where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("m")))
    return placed.select("g", "name", (F.col("r") - F.col("before")).alias("r"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("m").alias("n"))


def select_ranks(rows: DataFrame, group: str, value: str, ranks) -> DataFrame:
    """(g, name, v): the values at the wanted ranks (from 0) of each group's sorted values. ``ranks(n)`` gives {name: rank column} for a count column.

    Null values do not count; NaN sorts above everything, as in Spark. Groups without a value have no rows. A null group is a group.
    """
    # A null group travels as an array without elements, which equals itself.
    values = rows.where(F.col(value).isNotNull()).select(F.array_compact(F.array(F.col(group))).alias("g"), F.col(value).cast("double").alias("v"))
    v = F.col("v")
    finite = ~F.isnan(v) & (F.abs(v) < _INF)
    sizes = values.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v == -_INF).alias("below"), F.count_if(finite).alias("n_finite"), F.count_if(v == _INF).alias("above"),
        F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"),
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("r")) for name, rank in ranks(F.col("n")).items()])
    asked = sizes.select("g", "below", "n_finite", "above", "lo", "hi", F.inline(wanted))
    r = F.col("r") - F.col("below")
    special = F.when(r < 0, F.lit(-_INF)).when(r >= F.col("n_finite") + F.col("above"), F.lit(float("nan"))).when(r >= F.col("n_finite"), F.lit(_INF))
    asked = materialise(asked.select("g", "name", r.alias("r"), "lo", "hi", F.col("n_finite").alias("n"), special.alias("v")))
    done = asked.where("v is not null or lo = hi").select("g", "name", F.coalesce("v", "lo").alias("v"))
    parts = [done]
    asked = asked.where("v is null and lo < hi").drop("v")
    values = values.where(finite)
    small, large = asked.where(F.col("n") <= SORT_ROWS), asked.where(F.col("n") > SORT_ROWS)
    left = large.agg(F.sum("n")).first()[0]
    while left is not None:
        narrowed = materialise(_narrow(values, large))
        parts.append(narrowed.where("lo = hi").select("g", "name", F.col("lo").alias("v")))
        narrowed = narrowed.where("lo < hi")
        last, left = left, narrowed.where(F.col("n") > SORT_ROWS).agg(F.sum("n")).first()[0]
        if left == last:  # intervals too narrow to halve: the values in them are sorted
            small, left = small.unionByName(narrowed), None
        else:
            small, large = small.unionByName(narrowed.where(F.col("n") <= SORT_ROWS)), narrowed.where(F.col("n") > SORT_ROWS)
    intervals = small.select("g", "lo", "hi").distinct()
    inside = values.join(intervals, "g").where((v >= F.col("lo")) & (v <= F.col("hi")))
    placed = inside.withColumn("r", F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")) - 1)
    out = placed.join(small, ["g", "lo", "hi", "r"]).select("g", "name", "v")
    for part in parts:
        out = out.unionByName(part)
    return out


def _columns(found: DataFrame, rows: DataFrame, group: str, names: list[str]) -> DataFrame:
    key = F.get("g", F.lit(0)).cast(rows.schema[group].dataType).alias(group)
    return found.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])


def nearest_rank(rows: DataFrame, group: str, value: str, key: str, percents: tuple[float, ...]) -> DataFrame:
    """``sorted[min(n - 1, floor(p / 100 * n))]`` per group, one column per percentile. Ties need no ``key``: equal values are one value."""
    names = [f"p{p:g}" for p in percents]
    found = select_ranks(rows, group, value, lambda n: {name: F.least(n - 1, F.floor(F.lit(p / 100.0) * n)) for name, p in zip(names, percents)})
    return _columns(found, rows, group, names)


def interpolated(rows: DataFrame, group: str, value: str, key: str, fraction: float, name: str) -> DataFrame:
    """Linear interpolation between the two closest ranks (the continuous percentile)."""
    rank = lambda n: F.lit(fraction) * (n - 1)
    found = select_ranks(rows, group, value, lambda n: {"_lo": F.floor(rank(n)), "_hi": F.ceil(rank(n))})
    counts = rows.groupBy(group).agg(F.count(value).alias("_n"))
    share = rank(F.col("_n")) - F.floor(rank(F.col("_n")))
    both = _columns(found, rows, group, ["_lo", "_hi"])
    counts = counts.withColumnRenamed(group, f"{group}_of_count")
    return both.join(counts, both[group].eqNullSafe(counts[f"{group}_of_count"])).select(group, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias(name))
