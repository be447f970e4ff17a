"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference, entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    """All but those of the optional subpackage, which has its own tests for what SQL can't express."""
    own = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert difference(spark, duck, SF, name) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[0] == "account_id" and result.count() > 0
