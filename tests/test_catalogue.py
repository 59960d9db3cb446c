"""Every query of the catalogue against its SQL, on whole tables."""

import pytest
from oracle import differences

from graphloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.SQL:
        assert differences(df, catalogue.SQL[name], sf) == ""
    else:
        assert df.count() > 0


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_flagship_gives_at_most_nine(spark, sf):
    assert 0 < catalogue.flagship(spark, sf).count() <= 9
