"""File sources: media discovery, attribution manifest, reviewed labels, saved predictions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted media extensions.
MEDIA_EXTENSIONS = ("mp4", "mov", "m4v", "webm")


def discover(spark: SparkSession, directory: str, limit: int | None = None) -> DataFrame:
    """Media files of a folder in byte order of their names.

    ``path``/``length`` come from the listing; the content column is pruned unless a later step asks for it.
    """
    files = spark.read.format("binaryFile").load(directory)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = (
        files.withColumn("file_name", name)
        .where(F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).isin(*MEDIA_EXTENSIONS))
        .withColumn("external_id", F.regexp_replace("file_name", r"\.[^.]+$", ""))
        .select("file_name", "external_id", "path", F.col("length").alias("size_bytes"), "content")
        .orderBy("file_name")
    )
    return found if limit is None else found.limit(limit)


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("checksum", F.sha2("content", 256)).drop("content")


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, creator_id, creator_handle``. No file is an empty table; a malformed or ambiguous one fails."""
    try:
        raw = spark.read.schema("file STRING, creatorId STRING, creatorHandle STRING").json(path, multiLine=True, mode="FAILFAST")
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], "file_name STRING, creator_id STRING, creator_handle STRING")
    named = raw.select(
        F.when(F.length("file") > 0, F.col("file")).otherwise(F.raise_error(F.lit("manifest row without a file"))).alias("file_name"),
        F.col("creatorId").alias("creator_id"),
        F.col("creatorHandle").alias("creator_handle"),
    )
    once = named.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("creator_id").alias("creator_id"), F.min("creator_handle").alias("creator_handle")
    )
    repeated = F.raise_error(F.concat(F.lit("manifest lists a file more than once: "), "file_name"))
    return once.select(F.when(F.col("n") == 1, F.col("file_name")).otherwise(repeated).alias("file_name"), "creator_id", "creator_handle")


def _checked_version(found, expected: int, what: str):
    message = F.concat(F.lit(f"{what} have taxonomy version "), found.cast("string"), F.lit(f", expected {expected}"))
    return F.when(found == expected, F.lit(expected)).otherwise(F.raise_error(message).cast("int"))


def gold_labels(spark: SparkSession, path: str, label_schema: str, version: int) -> DataFrame:
    """Reviewed labels, one row per item. Another taxonomy version fails the read."""
    schema = (
        "taxonomyVersion INT, reviewedBy STRING, reviewedAt STRING, "
        f"items ARRAY<STRUCT<videoId: STRING, note: STRING, labels: STRUCT<{label_schema}>>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    guarded = raw.withColumn("taxonomy_version", _checked_version(F.col("taxonomyVersion"), version, "gold labels"))
    return guarded.select("taxonomy_version", "reviewedBy", F.explode("items").alias("i")).select(
        F.col("i.videoId").alias("item_id"), "taxonomy_version", F.col("reviewedBy").alias("reviewed_by"), F.col("i.note").alias("note"), "i.labels.*"
    )


def predictions(spark: SparkSession, path: str, label_schema: str, version: int) -> DataFrame:
    """Saved predictions, to score again without running a model. A file without a version is accepted."""
    schema = (
        "model STRING, modelVersion STRING, taxonomyVersion INT, promptVersion INT, generatedAt STRING, "
        f"items ARRAY<STRUCT<videoId: STRING, features: STRUCT<{label_schema}>>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    ok = F.coalesce("taxonomyVersion", F.lit(version))
    guarded = raw.withColumn("taxonomy_version", _checked_version(ok, version, "predictions"))
    return guarded.select(F.coalesce("model", F.lit("unknown")).alias("model"), "taxonomy_version", F.explode("items").alias("i")).select(
        "model", "taxonomy_version", F.col("i.videoId").alias("item_id"), "i.features.*"
    )


def validate_gold(labels: DataFrame) -> DataFrame:
    bad = F.length("item_id") == 0
    return labels.where(F.when(bad, F.raise_error(F.lit("gold label without an item")).cast("boolean")).otherwise(F.lit(True)))


