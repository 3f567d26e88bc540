"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from compare import assert_same
from conftest import DATA
from ethoframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, str(DATA)), duck.sql(catalog.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, duck, name):
    """Those that SQL can't express; test_learned and test_folds hold them to known answers."""
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_flagship(spark, duck):
    df = catalog.flagship(spark, str(DATA))
    assert df.columns[:2] == ["t0", "t1"] and df.count() == 10
