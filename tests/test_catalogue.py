"""Every core query against its SQL."""

import pytest

from voxloom.plans.catalogue import ORACLES, QUERIES

from .compare import FOLDER, connection, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, rows = rows_of_spark(QUERIES[name](spark, FOLDER))
    assert name in ORACLES
    expected_columns, expected = rows_of_sql(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
