"""Event weights, decay and recency as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.config import EVENT_WEIGHTS, Settings

US_PER_DAY = 86_400_000_000.0
US_PER_HOUR = 3_600_000_000.0


def now_col(s: Settings) -> Column:
    return F.lit(s.now).cast("timestamp")


def event_weight(event_type: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in EVENT_WEIGHTS.items()))
    return F.coalesce(F.try_element_at(table, event_type), F.lit(0.0))


def is_meaningful(event_type: Column) -> Column:
    return event_weight(event_type) != 0


def invalidates_feed(event_type: Column) -> Column:
    """Same rule as :func:`is_meaningful` today; kept apart because the two answer different questions."""
    return event_weight(event_type) != 0


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(US_PER_DAY))


def decay(days: Column, halflife_days: float) -> Column:
    if halflife_days <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days) / F.lit(float(halflife_days)))


def signal(event_type: Column, at: Column, now: Column, halflife_days: float) -> Column:
    return event_weight(event_type) * decay(age_days(at, now), halflife_days)


def freshness(created_at: Column, now: Column, halflife_hours: float) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(created_at)) / F.lit(US_PER_HOUR))
    return F.pow(F.lit(0.5), hours / F.lit(float(halflife_hours)))


def window_recency(at: Column, now: Column, window_hours: int) -> Column:
    """Linear position in the window. Rows dated after ``now`` count in full."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(US_PER_HOUR)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - age / F.lit(float(window_hours))))
