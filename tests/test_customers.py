"""Queries of customers on rows of their own: names come along, nulls and repeated keys too."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from terrace.plans import workload as w

ROWS = [
    (1, "Ann", 3, 10.5, "MACHINERY"),
    (2, None, None, -0.01, "BUILDING"),
    (2, "Bo", 4, -7.0, None),
    (None, "Cy", 5, 0.0, "BUILDING"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    kinds = {"c_custkey": pa.int64(), "c_name": pa.string(), "c_nationkey": pa.int32(), "c_acctbal": pa.float64(), "c_mktsegment": pa.string()}
    path = tmp_path_factory.mktemp("customers")
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*ROWS), kinds.values())], names=list(kinds)), f"{path}/customer.parquet")
    return str(path)


def found(df):
    names = ["account_id", "account_name", "nation_id", "segment", "balance"]
    assert df.columns[:5] == names
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def wanted(keep=lambda balance: True):
    return sorted(((k, name, nation, segment, balance) for k, name, nation, balance, segment in ROWS if keep(balance)), key=repr)


def test_staged_customers_have_names(spark, folder):
    assert found(w.stage_customers(spark, folder)) == wanted()


def test_quarantined_customers_have_names(spark, folder):
    assert found(w.quarantine_customers(spark, folder)) == wanted(lambda balance: balance < 0)


def test_clean_customers_have_names(spark, folder):
    assert found(w.clean_customers(spark, folder)) == wanted(lambda balance: balance >= 0)
