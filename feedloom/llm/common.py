"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads, under fixed names; a null text counts as empty.

    Whatever else the input carries, also under names that the operators use themselves, is left behind here.
    """
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def text_key(text: Column | str) -> Column:
    """64 bits of a text. Always used together with doc_id: rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def set_aside(docs: DataFrame, *taken: str):
    """(docs, restore): columns of ``docs`` that have one of the names ``taken``, in any case, go under other names until ``restore`` gives them theirs back.

    So do names with a dot, which Arrow jobs would read as a field of a column.
    """
    lower = {c.lower() for c in docs.columns}
    names = {}
    for c in docs.columns:
        if "." in c or c.lower() in {t.lower() for t in taken}:
            free = f"{c.replace('.', '_')}_kept"
            while free.lower() in lower:
                free += "_"
            lower.add(free.lower())
            names[c] = free
    back = {v: k for k, v in names.items()}
    return docs.withColumnsRenamed(names), lambda df: df.withColumnsRenamed(back)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants, made by the plan itself."""
    if not rows:
        return spark.sql("select 1 as one").select(F.explode(F.array().cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")).alias("r")).select("r.*")
    types = [c.strip().split(" ") for c in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, types)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def share(spark: SparkSession, value):
    """Broadcast a value of bounded size; returns a function that gives it in a task. Classes of this package travel along."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of linked positions. ``labels[i]`` is the smallest position known to be in the class of i."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        changed = (labels[a] != low) | (labels[b] != low)
        if not changed.any():
            break
        a, b, low = a[changed], b[changed], low[changed]
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels
