"""Every registered query against its SQL on the smallest test tables."""

import pytest
from claimlab.plans.registry import ALL
from oracle import connect, differences


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", [key for key, query in ALL.items() if query.sql])
def test_query_matches_sql(key, spark, sf_dir, duck):
    query = ALL[key]
    assert differences(query.run(spark, sf_dir), duck, query.oracle()) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:3] == ["STATE", "PERIOD_10Y", "PAYMENT_MODE"]
