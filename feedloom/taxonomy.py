"""The closed vocabulary as a table.

The engine treats the vocabulary as data: ``taxonomy(field, kind, value, slot, weight, diversity)``.
The neutral fixture below is the one bound to the test tables; any other vocabulary with the same
columns can be passed instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feedloom.schemas import TAXONOMY

# Field, kind, weight, counts for diversity, values in slot order.
NEUTRAL_FIELDS: tuple[tuple[str, str, float, bool, tuple[str, ...]], ...] = (
    ("size_band", "single", 0.6, True, ("none", "small", "medium", "large", "unknown")),
    ("finish", "single", 0.8, True, ("economy", "promo", "small", "medium", "large", "other")),
    ("grade", "single", 0.3, False, ("low", "high", "unknown")),
    ("trait", "multi", 1.2, True, ("blue", "cold", "hot", "large", "new", "old", "red", "small")),
    ("object", "multi", 0.5, False, ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")),
)
NEUTRAL_VERSION = 1
UNINFORMATIVE = ("unknown",)
NOT_A_PREFERENCE = ("unknown", "none")


@dataclass(frozen=True)
class Taxonomy:
    """A frozen slot layout. ``rows`` are (field, kind, value, slot, weight, diversity)."""

    rows: tuple[tuple[str, str, str, int, float, bool], ...]
    version: int

    @property
    def dim(self) -> int:
        return len(self.rows)

    @property
    def slot_names(self) -> list[str]:
        return [f"{field}:{value}" for field, _, value, *_ in sorted(self.rows, key=lambda r: r[3])]

    @property
    def fields(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys((field, kind) for field, kind, *_ in self.rows))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([list(r) for r in self.rows], TAXONOMY)


def neutral() -> Taxonomy:
    rows, slot = [], 0
    for field, kind, weight, diversity, values in NEUTRAL_FIELDS:
        for value in values:
            rows.append((field, kind, value, slot, weight, diversity))
            slot += 1
    return Taxonomy(tuple(rows), NEUTRAL_VERSION)
