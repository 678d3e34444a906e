"""Every registered query against its SQL, on the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_recommended_respects_caps(spark):
    rows = QUERIES["recommended"](spark, SF)
    pdf = rows.toPandas()
    assert (pdf.groupby("user_id")["rank"].max() <= 50).all() and not pdf.duplicated(["user_id", "item_id"]).any()
    strict = pdf[~pdf.relaxed]
    assert strict.dropna(subset=["creator_id"]).groupby(["user_id", "creator_id"]).size().max() <= 2
