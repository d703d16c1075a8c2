"""Every query of the catalogue against its oracle, on the smallest tables."""

import pytest

from oremill.plans import catalogue

from .compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_oracle(spark, name):
    got, want = both(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_flagship_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 9
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
