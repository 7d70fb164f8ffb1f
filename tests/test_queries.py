"""Every registered query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from workload import registry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def comparable(rows):
    return sorted([tuple((v is not None, type(v).__name__, repr(v)) for v in row) for row in rows])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(registry.QUERIES) - len(registry.ORACLES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert comparable(got) == comparable(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
