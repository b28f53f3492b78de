"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import os

import pytest

import __spark_entry__ as driver
import oracle_check
from slotweave.plans import oracle, registry

FOLDER = "/root/testdata/sf0.001"
TRAINED = ["forest_predict", "forest_predict_onehot", "forest_report", "score_saved_model"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def base():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_same_rows_as_sql(spark, base, name):
    result = driver.queries()[name](spark, FOLDER)
    assert oracle_check.differences(result, base, driver.oracle_sql()[name]) == []


def test_every_statement_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(registry.QUERIES) - set(oracle.ORACLE_SQL) == {*TRAINED, "forecast_predict"}
    assert set(registry.QUERIES) <= set(driver.queries())


def test_forecast_shape(spark):
    rows = driver.queries()["forecast_predict"](spark, FOLDER).collect()
    assert len(rows) == 15 * 24 == len({(r.device, r.time) for r in rows})
    assert {r.activation_predicted1 for r in rows} <= {0, 1}


def test_stored_model_shape(spark):
    rows = driver.queries()["score_saved_model"](spark, FOLDER).collect()
    assert len(rows) == 15 * 24 == len({(r.device, r.time) for r in rows})
    assert [(r.device, r.time) for r in rows] == sorted((r.device, r.time) for r in rows)
    assert {r.activation_predicted for r in rows} <= {0, 1}


def test_entry(spark):
    table = driver.entry(spark)
    assert table.count() == 15 * 744
