"""From closed-vocabulary features to tags and content vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.taxonomy import NOT_A_PREFERENCE, UNINFORMATIVE, Taxonomy

DEFAULT_CONFIDENCE = 0.5


def item_tags(features: DataFrame, tax: Taxonomy, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot a features table to distinct ``(item_id, field, value)`` rows in one scan."""
    per_field = [
        F.struct(
            F.lit(field).alias("field"),
            (F.array(F.col(field)) if kind == "single" else F.array_distinct(F.col(field))).alias("values"),
        )
        for field, kind in tax.fields
    ]
    return (
        features.select("item_id", *carry, F.explode(F.array(*per_field)).alias("f"))
        .select("item_id", *carry, F.col("f.field").alias("field"), F.explode("f.values").alias("value"))
        .where(F.col("value").isNotNull())
    )


def with_slots(tags: DataFrame, tax: Taxonomy) -> DataFrame:
    """Attach slot, weight and policy columns. The vocabulary is a fixed, small table."""
    dim = tax.frame(tags.sparkSession).select("field", "value", "kind", "slot", "weight", "diversity")
    return tags.join(F.broadcast(dim), ["field", "value"])


def preference_tags(tags: DataFrame) -> DataFrame:
    """Values a user can hold a preference about."""
    return tags.where(~F.col("value").isin(*NOT_A_PREFERENCE))


def _has(field: str, kind: str, value: str) -> str:
    return f"({field} <=> '{value}')" if kind == "single" else f"coalesce(array_contains({field}, '{value}'), false)"


def encode_features(features: DataFrame, tax: Taxonomy) -> DataFrame:
    """``(item_id, taxonomy_version, vector)``: confidence-weighted multi-hot, unit length.

    The vocabulary is closed and known when the plan is built, so every slot is one expression over the
    row itself: no explode, no shuffle, one scan. A field spreads ``weight * confidence / sqrt(n)`` over its n
    informative values, so it adds exactly ``(weight * confidence)^2`` to the squared norm when n > 0.
    """
    rows = sorted(tax.rows, key=lambda r: r[3])
    informative: dict[str, list[str]] = {}
    for field, kind, value, *_ in rows:
        if value not in UNINFORMATIVE:
            informative.setdefault(field, []).append(f"int({_has(field, kind, value)})")
    weight = {r[0]: r[4] for r in rows}
    counted = features.select(
        "*",
        *[F.expr(f"{' + '.join(terms)} AS _n_{f}") for f, terms in informative.items()],
        *[F.expr(f"{weight[f]}D * coalesce(try_element_at(confidence, '{f}'), {DEFAULT_CONFIDENCE}D) AS _c_{f}") for f in informative],
    )
    square = " + ".join(f"if(_n_{f} > 0, _c_{f} * _c_{f}, 0D)" for f in informative)
    shared = counted.select(
        "*",
        F.expr(f"sqrt({square}) AS _norm"),
    ).select("*", *[F.expr(f"if(_n_{f} > 0 AND _norm > 0, _c_{f} / sqrt(double(_n_{f})) / _norm, 0D) AS _w_{f}") for f in informative])
    slots = ", ".join(
        "0D" if value in UNINFORMATIVE else f"if({_has(field, kind, value)}, _w_{field}, 0D)" for field, kind, value, *_ in rows
    )
    return shared.select("item_id", "taxonomy_version", F.expr(f"array({slots}) AS vector"))


def tag_columns(features: DataFrame, tax: Taxonomy) -> DataFrame:
    """Per item, without a shuffle: slots of its preference tags, its diversity tags and their slots."""
    usable = [r for r in sorted(tax.rows, key=lambda r: r[3]) if r[2] not in NOT_A_PREFERENCE]

    def pick(rows, out) -> str:
        return "array_compact(array(" + ", ".join(f"if({_has(r[0], r[1], r[2])}, {out(r)}, null)" for r in rows) + "))"

    diverse = [r for r in usable if r[5]]
    return features.select(
        "item_id",
        F.expr(pick(usable, lambda r: r[3]) + " AS tag_slots"),
        F.expr(pick(diverse, lambda r: f"'{r[0]}:{r[2]}'") + " AS div_tags"),
        F.expr(pick(diverse, lambda r: r[3]) + " AS div_slots"),
    )


def reencode(features: DataFrame, tax: Taxonomy) -> DataFrame:
    """Append-only vocabulary change: encode again from stored features of the current version."""
    return encode_features(features.where(F.col("taxonomy_version") == tax.version), tax)


def retire_version(
    items: DataFrame, features: DataFrame, vectors: DataFrame, profiles: DataFrame, current: int
) -> dict[str, DataFrame]:
    """Structural change: drop rows of older versions and send their items back to ``ingested``."""
    stale = features.where(F.col("taxonomy_version") < current).select("item_id").withColumn("_stale", F.lit(True))
    return {
        "items": items.join(stale, "item_id", "left")
        .withColumn("status", F.when(F.col("_stale"), "ingested").otherwise(F.col("status")))
        .drop("_stale"),
        "features": features.where(F.col("taxonomy_version") >= current),
        "vectors": vectors.where(F.col("taxonomy_version") >= current),
        "profiles": profiles.where(F.col("taxonomy_version") >= current),
    }
