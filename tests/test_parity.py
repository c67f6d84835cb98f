"""Every registered query at the smallest scale against its SQL; queries without SQL must give rows."""

import pytest
from parity import compare, duck

from cohortlens import plans

QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, folder, name):
    problem, count = compare(spark, con, name, QUERIES[name], ORACLES.get(name), folder)
    assert problem is None, problem
    assert count > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "item_id" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
