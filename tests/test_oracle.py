"""Every query with a check query gives the same rows as DuckDB."""

import pytest
from compare import connect, mismatch

from ebbtide.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, folder, duck, name):
    assert mismatch(QUERIES[name](spark, folder), duck, ORACLE[name]) is None


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
