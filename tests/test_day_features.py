import re

import pytest
from pyspark.sql import functions as F

from slotweave.operators import day_features, panel as panels, rates


@pytest.fixture(scope="module")
def log(spark):
    """Three weeks of scattered events; the log starts and ends within a day."""
    start = F.lit("2024-01-03 05:20:00").cast("timestamp_ntz")
    return spark.range(4_000).select(
        F.timestamp_add("MINUTE", F.pmod(F.xxhash64("id"), F.lit(21 * 1440)), start).alias("time"),
        F.concat(F.lit("device_"), F.floor(F.sqrt(F.col("id") % 300)).cast("string")).alias("device"),
        F.lit(1).alias("device_activated"),
    ).cache()


@pytest.mark.parametrize(
    "start, frame",
    [
        ("2024-01-24 05:30:00", "rows"),  # right after the last event
        ("2024-01-24 00:00:00", "rows"),  # midnight
        ("2024-01-15 13:59:59", "rows"),  # inside the history
        ("2024-01-03 09:00:00", "rows"),  # four hours of history
        ("2024-01-24 23:30:00", "rows"),  # hours between history and future
        ("2024-02-02 11:00:00", "rows"),  # days between history and future
        ("2024-02-02 11:00:00", "range"),
    ],
)
def test_equal_to_the_hourly_windows(log, start, frame):
    fast = day_features.next_day_features(log, start, device_rate=True, frame=frame)
    panel = panels.modelling_panel(log, start)
    plain = rates.model_features(panel, device_rate=True, frame=frame).select(*fast.columns)
    assert [f.dataType for f in fast.schema] == [f.dataType for f in plain.schema]
    rounded = [F.round(name, 9).alias(name) if kind == "double" else name for name, kind in fast.dtypes]
    left, right = sorted(fast.select(*rounded).collect(), key=by_key), sorted(plain.select(*rounded).collect(), key=by_key)
    assert len(left) > 24 and left == right


def by_key(row):
    return row.device, row.hour_slot


def test_optional_features_can_be_left_out(log):
    slim = day_features.next_day_features(log, "2024-01-24 06:00:00", device_day_rates=False, fleet_day_rates=False)
    assert [name for name in slim.columns if name in rates.FEATURES] == rates.FEATURES[:4]


def test_plan_shuffles_the_rollup_only(log):
    # A literal span keeps the subquery for it out of the printed plan.
    first, last = (F.lit(text).cast("timestamp_ntz") for text in ("2024-01-03 05:20:00", "2024-01-24 05:19:00"))
    extent = F.struct(first.alias("first"), last.alias("last"))
    days = day_features.device_days(day_features.day_rollup(log), extent, "2024-01-24 06:00:00")
    table = day_features.features_from_days(days, fleet_day_rates=False)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text


def test_log_is_scanned_once(spark, log, tmp_path):
    """The span and the fleet rates read the exchanges of the days."""
    path = str(tmp_path / "log.parquet")
    log.write.parquet(path)
    table = day_features.next_day_features(spark.read.parquet(path), "2024-01-24 06:00:00")
    table.collect()
    text = table._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReusedExchange \[device#\d+, \S+, bit_or", text)
    assert re.search(r"ReusedExchange \[device#\d+, day_index#\d+, active_hours#\d+\]", text)
