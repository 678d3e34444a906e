"""Named queries over the test tables, each paired with the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.plans.oracles import final, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Output types that compare across engines: bigint, six-digit doubles, strings."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def query(sql: str | None = None, extra: dict[str, str] | None = None, **shape: str):
    """Register a query under its function name. ``shape`` lists keys/ints/nums of the SQL result."""

    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_tables(final(sql, **shape) if shape else sql, extra)
        return fn

    return add
