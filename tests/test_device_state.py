"""Scoring from a state equals scoring from the history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotweave.operators import device_state, forest
from slotweave.operators.day_features import next_day_features
from slotweave.plans import jobs

COLUMNS = [
    "device",
    "hour_slot",
    "hour_of_day",
    "hour_of_week",
    "day_num",
    "week_num",
    "day_of_week",
    "is_active",
    "type",
    "is_active_last_week",
    "is_active_yesterday",
    "daily_activation_rate",
    "weekly_activation_rate",
    "device_rate_so_far",
]


def wanted(log, start):
    whole = next_day_features(log, start, device_day_rates=False, fleet_day_rates=False, device_rate=True)
    return sorted(map(str, whole.where("type = 'predict'").select(*COLUMNS).collect()))


def found(state, log, start):
    return sorted(map(str, device_state.features_from_state(state, log, start, device_rate=True)[0].select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def log(spark, planted_log):
    """Some devices end early, some begin late, one only after the time to predict."""
    number = F.regexp_extract("device", "[0-9]+", 0).cast("int")
    shaped = planted_log.where(((number % 5 != 1) | (F.col("time") < "2024-03-20")) & ((number % 5 != 2) | (F.col("time") > "2024-04-02")))
    late = spark.createDataFrame([(dt.datetime(2024, 4, 28, 7), "late", 1)], planted_log.schema)
    return jobs.write_stage(shaped.unionByName(late), "shaped")


@pytest.mark.parametrize("start", ["2024-04-10 10:20:00", "2024-04-25 03:00:00"])
def test_features_equal_those_of_the_history(log, start):
    assert found(device_state.build_state(log, "2024-04-10"), log, start) == wanted(log, start)


def test_states_brought_forward(spark, log, tmp_path):
    state = device_state.build_state(log, "2024-03-06")
    for day in ("2024-03-06", "2024-03-25", "2024-04-05"):
        state = device_state.advance(state, log, day)
    device_state.save_state(state, str(tmp_path))
    loaded = device_state.load_state(spark, str(tmp_path))
    whole = device_state.build_state(log, "2024-04-05")
    assert sorted(map(str, loaded.rows.collect())) == sorted(map(str, whole.rows.collect()))
    assert loaded.span.collect() == whole.span.collect() and loaded.until == dt.date(2024, 4, 5)
    assert found(loaded, log, "2024-04-08 12:00:00") == wanted(log, "2024-04-08 12:00:00")
    with pytest.raises(ValueError, match="already covers"):
        device_state.advance(state, log, "2024-04-01")
    with pytest.raises(ValueError, match="cannot score"):
        device_state.features_from_state(state, log, "2024-04-04 12:00:00")


def test_state_before_all_events_and_empty_logs(spark, log):
    assert found(device_state.build_state(log, "2024-01-01"), log, "2024-02-10 05:00:00") == wanted(log, "2024-02-10 05:00:00")
    nothing = log.limit(0)
    assert found(device_state.build_state(nothing, "2024-02-01"), nothing, "2024-02-10 05:00:00") == []
    # Nothing new since the state.
    old = log.where("time < '2024-04-01'")
    assert found(device_state.build_state(old, "2024-04-01"), nothing, "2024-04-01 00:00:00") == wanted(old, "2024-04-01 00:00:00")


def test_only_later_events_are_read(spark, log, tmp_path):
    """The state's last day is a filter of the scan."""
    path = str(tmp_path / "log.parquet")
    log.write.parquet(path)
    state = device_state.build_state(spark.read.parquet(path), "2024-04-20")
    since = spark.read.parquet(path).where(F.col("time") >= device_state._midnight(state.until))
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(time,2024-04-20T00:00" in plan


def test_model_stored_with_its_state(spark, planted_log):
    start = "2024-04-20 08:15:00"
    run = jobs.run_forest(planted_log, start, forest.ForestSettings(trees=10, depth=5))
    state = jobs.state_after(run, start)
    assert state.until == dt.date(2024, 4, 20)
    later = "2024-04-26 08:15:00"
    whole = jobs.run_scoring(planted_log, later, run.model).collect()
    assert jobs.run_scoring_from_state(planted_log, later, run.model, state).collect() == whole
