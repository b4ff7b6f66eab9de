"""Every registered query against its SQL, on the small driver tables."""

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries
from mixedframe.plans import oracles, registered


@pytest.mark.parametrize("name", sorted(oracles()))
def test_matches_sql(spark, data_dir, name):
    got = queries()[name](spark, data_dir).toPandas()
    want = duck(data_dir).execute(oracle_sql()[name]).df()
    assert difference(got, want) is None


def test_every_query_has_its_sql():
    assert set(registered()) == set(oracles())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark, data_dir):
    assert entry(spark).count() > 0
