"""Contracts on incoming rows: interactions, features, model answers, vocabulary integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.config import ACCEPTED_EVENT_TYPES
from feedloom.functions.media import salvage_json
from feedloom.operators.encoding import item_tags
from feedloom.session import materialise
from feedloom.taxonomy import Taxonomy

ID_PATTERN = r"^[0-9]+$"


def _reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of the broken rules, in rule order. A rule that evaluates to null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def check_interactions(raw: DataFrame, id_pattern: str = ID_PATTERN) -> DataFrame:
    """Adds ``reasons``; an empty array means the row is accepted."""
    ratio, ms, key = F.col("watch_ratio"), F.col("watch_ms"), F.col("event_id")
    rules = [
        ("event_id", key.isNull() | F.length(key).between(1, 200)),
        ("user_id", F.col("user_id").rlike(id_pattern)),
        ("item_id", F.col("item_id").rlike(id_pattern)),
        ("type", F.col("type").isin(*ACCEPTED_EVENT_TYPES)),
        ("watch_ratio", ratio.isNull() | ratio.between(0.0, 1.0)),
        ("watch_ms", ms.isNull() | ((ms >= 0) & (ms == F.floor(ms)))),
    ]
    return raw.withColumn("reasons", _reasons(rules))


def check_references(rows: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``reference_error``: unknown user, then unknown item, else null."""
    u = users.select("user_id").distinct().withColumn("_u", F.lit(True))
    i = items.select("item_id").distinct().withColumn("_i", F.lit(True))
    return (
        rows.join(u, "user_id", "left")
        .join(i, "item_id", "left")
        .withColumn(
            "reference_error",
            F.when(F.col("_u").isNull(), "unknown_user").when(F.col("_i").isNull(), "unknown_item"),
        )
        .drop("_u", "_i")
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine)."""
    ok = F.size("reasons") == 0
    return checked.where(ok).drop("reasons"), checked.where(~ok)


def feature_issues(features: DataFrame, tax: Taxonomy) -> DataFrame:
    """``(item_id, field, issue, value)`` for everything the vocabulary does not allow.

    Membership is an anti-join against the vocabulary table, which is small by construction.
    """
    sizes = {f: sum(r[0] == f for r in tax.rows) for f, _ in tax.fields}
    allowed = tax.frame(features.sparkSession).select("field", "value")
    unknown = (
        item_tags(features, tax)
        .join(F.broadcast(allowed), ["field", "value"], "left_anti")
        .select("item_id", "field", F.lit("not_in_vocabulary").alias("issue"), "value")
    )
    shape = []
    for field, kind in tax.fields:
        missing = F.col(field).isNull()
        shape.append(F.when(missing, F.struct(F.lit(field).alias("field"), F.lit("required").alias("issue"), F.lit(None).cast("string").alias("value"))))
        if kind == "multi":
            shape.append(
                F.when(
                    F.size(field) > sizes[field],
                    F.struct(F.lit(field).alias("field"), F.lit("too_many").alias("issue"), F.size(field).cast("string").alias("value")),
                )
            )
    if "aesthetic" in features.columns:
        score = F.col("aesthetic")
        shape.append(
            F.when(
                ~F.coalesce(score.between(0.0, 1.0), F.lit(False)),
                F.struct(F.lit("aesthetic").alias("field"), F.lit("out_of_range").alias("issue"), score.cast("string").alias("value")),
            )
        )
    if "caption" in features.columns:
        size = F.coalesce(F.length("caption"), F.lit(0))
        shape.append(
            F.when(
                ~size.between(1, 300),
                F.struct(F.lit("caption").alias("field"), F.lit("bad_length").alias("issue"), size.cast("string").alias("value")),
            )
        )
    if "confidence" in features.columns:
        bad = F.filter(F.map_values("confidence"), lambda x: ~x.between(0.0, 1.0))
        shape.append(
            F.when(
                F.size(bad) > 0,
                F.struct(F.lit("confidence").alias("field"), F.lit("out_of_range").alias("issue"), F.size(bad).cast("string").alias("value")),
            )
        )
    rest = features.select("item_id", F.explode(F.array_compact(F.array(*shape))).alias("i")).select("item_id", "i.*")
    return unknown.unionByName(rest)


def features_from_json(text: Column, tax: Taxonomy) -> Column:
    fields = ", ".join(f"{f} {'STRING' if k == 'single' else 'ARRAY<STRING>'}" for f, k in tax.fields)
    return F.from_json(text, f"{fields}, aesthetic DOUBLE, caption STRING, confidence MAP<STRING, DOUBLE>")


def ingest_answers(answers: DataFrame, tax: Taxonomy) -> tuple[DataFrame, DataFrame]:
    """Model answers ``(item_id, answer, frames_used)`` -> (accepted features, repair list).

    The repair list carries the failure kind and the messages a second attempt would be shown. Parsed answers are written once: read from the plan, every
    field of every branch would salvage and parse the text again.
    """
    salvaged = answers.withColumn("json", salvage_json(F.col("answer")))
    parsed = salvaged.withColumn("valid_json", F.try_parse_json("json").isNotNull()).withColumn(
        "features", F.when(F.col("valid_json"), features_from_json(F.col("json"), tax))
    )
    parsed = materialise(parsed.select("item_id", "frames_used", "valid_json", "features"))
    usable = parsed.where((F.col("frames_used") > 0) & F.col("valid_json")).select("item_id", "features.*")
    issues = (
        feature_issues(usable, tax)
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.concat_ws(": ", "field", "issue", "value"))).alias("messages"))
    )
    judged = parsed.select("item_id", "frames_used", "valid_json").join(issues, "item_id", "left")
    kind = (
        F.when(F.col("frames_used") <= 0, "no_frames")
        .when(~F.col("valid_json"), "invalid_json")
        .when(F.col("messages").isNotNull(), "schema_validation")
    )
    judged = judged.withColumn("kind", kind)
    accepted = usable.join(judged.where(F.col("kind").isNull()).select("item_id"), "item_id", "left_semi")
    return accepted, judged.where(F.col("kind").isNotNull()).select("item_id", "kind", "messages")


def vocabulary_mismatch(vocabulary: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows present on one side only, and slots or tags that occur twice."""
    key = ["field", "value"]
    parts = [
        vocabulary.join(layout, key, "left_anti").select(*key, F.lit("no_slot").alias("problem")),
        layout.join(vocabulary, key, "left_anti").select(*key, F.lit("not_in_vocabulary").alias("problem")),
        layout.groupBy(*key).count().where("count > 1").select(*key, F.lit("duplicate_tag").alias("problem")),
        layout.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("field").alias("field"), F.min("value").alias("value"))
        .where("n > 1").select(*key, F.lit("duplicate_slot").alias("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unclassified_fields(vocabulary: DataFrame, diversity_fields: DataFrame, excluded_fields: DataFrame) -> DataFrame:
    covered = diversity_fields.select("field").unionByName(excluded_fields.select("field"))
    return vocabulary.select("field").distinct().join(covered, "field", "left_anti")


def dimension_report(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows per stored dimension. Healthy means exactly one row, with ``expected`` true."""
    return vectors.groupBy(F.size("vector").alias("dimension")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "expected", F.col("dimension") == dim
    )


def require_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors as they are; fails at once on an empty table or on any vector of another length or null."""
    report = dimension_report(vectors, dim).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("expected"), F.col("n"))).alias("good")).first()
    if not report.n or report.n != report.good:
        raise ValueError(f"expected vectors of length {dim}: {report.good or 0} of {report.n or 0} rows have it")
    return vectors


def require_one_version(rows: DataFrame, expected: int) -> DataFrame:
    """Fails the job on the first row of another taxonomy version."""
    ok = F.col("taxonomy_version") == expected
    message = F.concat(F.lit(f"expected taxonomy version {expected}, found "), F.col("taxonomy_version").cast("string"))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def contradictions(features: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``rules``: (name, condition that must not hold). One row per item and broken rule."""
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return features.select("item_id", F.explode(hits).alias("rule"))
