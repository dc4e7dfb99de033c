"""Every registered query of the core library against its SQL, and the entry points."""

import pytest

import __spark_entry__
from cutflow.queries import ORACLE_SQL, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, data):
    same(QUERIES[name], ORACLE_SQL[name], spark, data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
