"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
import verify

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    good, text = verify.compare(spark, con, name, SF)
    assert good, text


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "answer" in df.columns
