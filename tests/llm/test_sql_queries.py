"""Queries with SQL give the same rows in DuckDB; the others run on the test tables."""

import oracle_check
import pytest

from slotweave.llm.queries import QUERIES
from slotweave.llm.sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, folder, name):
    assert oracle_check.differences(QUERIES[name](spark, folder), oracle_check.connect(folder), ORACLE_SQL[name]) == []


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 14))
