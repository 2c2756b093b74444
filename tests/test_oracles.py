"""Every query against its SQL twin."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from quern.plans.oracles import ORACLES
from quern.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    problems, n, _, _ = differences(spark, con, name, SF_DIR, QUERIES, ORACLES)
    assert not problems, "\n".join(problems)
    assert n > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "engineered_context", "final_response"]
    assert df.count() > 0
