"""The compat form on device-days equals the same form on the hourly panel."""

import pytest
from pyspark.sql import functions as F

from slotweave.operators import overlap_features, panel, rates

COLUMNS = ["device", "hour_slot", "hour_of_day", "hour_of_week", "day_num", "week_num", "day_of_week", "is_active", "type"]


def rows(table):
    rounded = table.withColumns({name: F.round(name, 9) for name in rates.FEATURES})
    return sorted(map(str, rounded.select(*COLUMNS, *rates.FEATURES).collect()))


@pytest.mark.parametrize("start, frame", [("2024-03-20 10:15:00", "rows"), ("2024-03-20 10:15:00", "range"), ("2024-05-20 07:00:00", "rows"), ("2024-02-20 07:00:00", "rows")])
def test_equals_the_hourly_form(planted_log, start, frame):
    """Inside the log, after a gap and before its first event."""
    few = planted_log.where(F.regexp_extract("device", "[0-9]+", 0).cast("int") < 3).where("device <> 'device_2' or day(time) <> 12")
    hourly = panel.modelling_panel(few, start, grid="compat", cut_history=False, future_flag="active")
    wanted = rates.model_features(hourly, rates="latest_only", frame=frame)
    assert rows(overlap_features.overlap_features(few, start, frame)) == rows(wanted)


def test_grid_that_ends_before_the_last_event(make_log):
    """Whole days are counted from event to event, so the last hours can fall off the grid."""
    log = make_log(("2024-01-01 20:00:00", "a", 1), ("2024-01-02 05:00:00", "b", 1), ("2024-01-03 19:30:00", "a", 1), ("2024-01-03 19:40:00", "c", 1))
    hourly = panel.modelling_panel(log, "2024-01-03 10:00:00", grid="compat", cut_history=False, future_flag="active")
    wanted = rates.model_features(hourly, rates="latest_only")
    assert rows(overlap_features.overlap_features(log, "2024-01-03 10:00:00")) == rows(wanted)
