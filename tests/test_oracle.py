"""Every catalogue query against its SQL at the smallest scale."""

import pytest
from conftest import TESTDATA

from compare import compare, duck
from newsloom.queries import catalogue

QUERIES, ORACLES = catalogue()


@pytest.fixture(scope="module")
def con():
    return duck(f"{TESTDATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    problems = compare(con, QUERIES[name](spark, f"{TESTDATA}/sf0.001"), ORACLES[name])
    empty = con.execute(f"SELECT count(*) FROM ({ORACLES[name].rstrip('; ')})").fetchone()[0] == 0
    assert not [p for p in problems if p != "no rows" or not empty]
