"""Queries of the subpackage that SQL can express, against it."""

import pytest
from oracle_check import connect, differences

from quern.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    problems, n, _, _ = differences(spark, connect(SF_DIR), name, SF_DIR, QUERIES, ORACLES)
    assert not problems, "\n".join(problems)
    assert n > 0
