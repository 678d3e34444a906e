"""Explicit schemas. Nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*cols: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in cols])


S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
VECTOR = T.ArrayType(D, containsNull=False)

TAXONOMY = _struct(("field", S), ("kind", S), ("value", S), ("slot", I), ("weight", D), ("diversity", B))
INTERACTION = _struct(
    ("event_id", S), ("user_id", S), ("item_id", S), ("type", S),
    ("watch_ratio", D), ("watch_ms", L), ("occurred_at", TS),
)
EVENT = _struct(("event_id", L), ("user_id", L), ("item_id", L), ("type", S), ("created_at", TS))
FEED_ITEM = _struct(("item_id", L), ("rank", I), ("creator_id", S))
FEED_GENERATION = _struct(
    ("feed_id", S), ("user_id", L), ("epoch", L), ("published_seq", L), ("generated_at", TS), ("expires_at", TS),
    ("cold_start", B), ("candidate_shortage", B), ("diversity_relaxed", B), ("items", T.ArrayType(FEED_ITEM)),
)
USER_PROFILE = _struct(
    ("user_id", L), ("taxonomy_version", I), ("vector", VECTOR), ("tag_affinity", T.MapType(S, D)),
    ("interaction_count", L), ("effective", L), ("positive_signal", D), ("negative_signal", D),
    ("skipped_no_features", L), ("is_cold_start", B),
)
FRAME = _struct(("item_id", L), ("ts_sec", D), ("hash", L))
