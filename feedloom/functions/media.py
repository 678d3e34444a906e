"""Probe-record arithmetic and model-text salvage as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_rate(text: Column) -> Column:
    """``"30000/1001"`` or ``"25"`` as a positive double, else null."""
    parts = F.split(text, "/")
    top = F.get(parts, F.lit(0)).try_cast("double")
    bottom = F.when(F.size(parts) == 1, F.lit(1.0)).otherwise(F.get(parts, F.lit(1)).try_cast("double"))
    fps = F.try_divide(top, bottom)
    ok = fps.isNotNull() & ~F.isnan(fps) & (F.abs(fps) < F.lit(float("inf"))) & (fps > 0)
    return F.when(ok, fps)


def stated_rotation(side_data: Column, stream: Column, tag: Column) -> Column:
    """The rotation a probe record states: the first in its side data that has one, else the stream's own, else its tag; null without any."""
    return F.coalesce(F.get(F.filter(side_data, lambda r: r.isNotNull()), F.lit(0)).cast("string"), stream.cast("string"), tag.cast("string"))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width by height as doubles; null without a height."""
    return F.try_divide(width.cast("double"), height.cast("double"))


def rotation(degrees: Column) -> Column:
    d = F.coalesce(degrees.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0)).otherwise(
        F.pmod(F.floor(d + F.lit(0.5)).cast("int"), F.lit(360))
    )


def display_size(width: Column, height: Column, degrees: Column) -> Column:
    turned = rotation(degrees).isin(90, 270)
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"),
        F.when(turned, width).otherwise(height).alias("height"),
    )


def scaled_size(width: Column, height: Column, long_edge: int) -> Column:
    """Even dimensions with the longer edge at most ``long_edge``; never enlarged."""
    longest = F.greatest(width, height)
    factor = F.lit(float(long_edge)) / longest

    def even(x: Column) -> Column:
        return F.greatest(F.lit(2), (F.floor(x * factor / 2 + F.lit(0.5)) * 2).cast("int"))

    fits = longest <= long_edge
    return F.struct(
        F.when(fits, width.cast("int")).otherwise(even(width)).alias("width"),
        F.when(fits, height.cast("int")).otherwise(even(height)).alias("height"),
        (~fits).alias("scaled"),
    )


def salvage_json(text: Column) -> Column:
    """The JSON object inside a model answer: fenced block, else outermost braces, else the text itself."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(trimmed, r"(?s)```(?:json)?\s*(.*?)```", 1)
    first = F.locate("{", trimmed)
    last = F.length(trimmed) - F.locate("}", F.reverse(trimmed)) + 1
    has_pair = (first > 0) & (F.locate("}", trimmed) > 0) & (last > first)
    return (
        F.when(F.length(fenced) > 0, F.regexp_replace(fenced, r"^\s+|\s+$", ""))
        .when(has_pair, F.substring(trimmed, first, last - first + 1))
        .otherwise(trimmed)
    )


def failure_reason(kind: Column, message: Column) -> Column:
    return F.substring(F.concat(F.lit("["), kind, F.lit("] "), message), 1, 1000)


def failure_kind(reason: Column) -> Column:
    return F.regexp_extract(reason, r"^\[(.*?)\]", 1)
