"""Every query with a SQL statement gives the statement's rows on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from footfall.plans.catalog import CATALOG as QUERIES
from oracles import statements
from tests.compare import connect, differences

STATEMENTS = statements()


@pytest.fixture(scope="module")
def sf_dir(testdata):
    return f"{testdata}/sf0.001"


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_same_rows(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    rows = [tuple(row) for row in df.collect()]
    cursor = duck.execute(STATEMENTS[key])
    names = [d[0] for d in cursor.description]
    assert differences(df.columns, rows, names, cursor.fetchall()) is None


def test_entry(spark):
    assert entry(spark).count() > 0
