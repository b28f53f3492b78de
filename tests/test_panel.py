import re

import pytest
from pyspark.sql import functions as F

from slotweave.operators import panel as panels
from slotweave.operators.day_features import next_day_features
from slotweave.operators.panel import hourly_panel, modelling_panel
from slotweave.operators.rates import model_features
from slotweave.sources.activations import unusable_counts

SHORT = (
    ("2022-07-01 04:50:00", "A", 1),
    ("2022-07-01 04:55:00", "A", 0),
    ("2022-07-02 06:00:00", "B", None),
    ("2022-07-03 04:10:00", "A", 1),
)
LONG = (("2022-07-01 04:10:00", "A", 1), ("2022-07-03 23:50:00", "A", 1))


def shape(panel):
    row = panel.agg(F.min("hour_slot"), F.max("hour_slot"), F.count("*"), F.sum("is_active")).first()
    return tuple(row)


def test_rollup(make_log):
    rows = panels.hourly_rollup(make_log(*SHORT)).orderBy("hour_index").collect()
    found = [(r.device, r.total_activations, str(r.earliest_activation)[11:16], str(r.latest_activation)[11:16]) for r in rows]
    assert found == [("A", 1, "04:50", "04:55"), ("B", 0, "06:00", "06:00"), ("A", 1, "04:10", "04:10")]


@pytest.mark.parametrize(
    "rows, grid, expected",
    [
        (SHORT, "compat", (4, 51, 96, 2)),
        (SHORT, "span", (4, 52, 98, 3)),
        (LONG, "compat", (4, 75, 72, 2)),
        (LONG, "span", (4, 71, 68, 2)),
    ],
)
def test_grid_length(make_log, rows, grid, expected):
    assert shape(panels.hourly_panel(make_log(*rows), grid=grid)) == expected


def test_device_beyond_the_grid_still_gets_rows(make_log):
    rows = SHORT[:3] + (("2022-07-03 04:10:00", "C", 1),)
    panel = panels.hourly_panel(make_log(*rows), grid="compat").where("device = 'C'")
    assert shape(panel) == (4, 51, 48, 0)


def test_panel_matches_a_brute_force_grid(make_log):
    rows = [
        ("2022-07-01 22:10:00", "A", 2),
        ("2022-07-01 22:40:00", "A", 3),
        ("2022-07-02 01:00:00", "A", 1),
        ("2022-07-02 00:30:00", "B", 1),
        ("2022-07-02 03:59:59", "C", 5),
    ]
    active = {("A", 22): 5, ("A", 25): 1, ("B", 24): 1, ("C", 27): 5}
    expected = {(d, s): active.get((d, s)) for d in "ABC" for s in range(22, 28)}
    panel = panels.hourly_panel(make_log(*rows)).collect()
    assert {(r.device, r.hour_slot): r.total_activations for r in panel} == expected
    assert len(panel) == len(expected)
    assert all(r.is_active == (r.total_activations is not None) for r in panel)


def test_unusable_rows_are_dropped_and_counted(make_log):
    log = make_log(*SHORT, ("2022-07-01 05:00:00", None, 1), (None, "A", 1))
    assert tuple(unusable_counts(log).first()) == (1, 1, 6)
    assert shape(panels.hourly_panel(log)) == (4, 52, 98, 3)


def test_fused_panel_equals_the_union(make_log):
    log = make_log(*SHORT)
    for flag in ("null", "active"):
        fused = panels.modelling_panel(log, "2022-07-03 05:30:00", future_flag=flag)
        future = panels.future_panel(panels.devices(log), "2022-07-03 05:30:00", panels.first_day(log), flag)
        union = panels.append(panels.hourly_panel(log), future)
        assert fused.schema.simpleString() == union.schema.simpleString()
        assert fused.count() == union.count() == 98 + 48
        assert fused.exceptAll(union).count() == 0


def test_history_is_cut_at_the_first_future_hour(make_log):
    log = make_log(*SHORT)
    cut = panels.modelling_panel(log, "2022-07-02 06:30:00")
    # The event at 06:00 is before 07:00 and stays, the one of the next day is left out.
    assert shape(cut.where("type = 'train'")) == (4, 30, 54, 2)
    assert shape(cut.where("type = 'predict'"))[:3] == (31, 54, 48)


@pytest.mark.parametrize("seen", ["2022-01-05 12:00:00", "2022-01-09 04:00:00", "2022-01-05 23:30:00"])
def test_devices_first_seen_later_get_their_hours(make_log, seen):
    log = make_log(("2022-01-01 05:00:00", "a", 1), ("2022-01-05 03:00:00", "a", 1), (seen, "b", 1), (seen, "a", 1))
    start = "2022-01-05 10:30:00"
    panel = hourly = modelling_panel(log, start)
    assert {r.device: r["count"] for r in panel.where("type = 'predict'").groupBy("device").count().collect()} == {"a": 24, "b": 24}
    assert panel.where("type = 'train' and device = 'b'").count() == 0
    keys = ["device", "hour_slot", "type", "is_active"]
    wide = model_features(hourly, device_rate=True)
    names = [*keys, *[c for c in next_day_features(log, start, device_rate=True).columns if c.endswith("rate")]]
    left = sorted(map(str, wide.select(*names).collect()))
    assert sorted(map(str, next_day_features(log, start, device_rate=True).select(*names).collect())) == left
    assert modelling_panel(log, start, devices="history").where("device = 'b'").count() == 0
    assert next_day_features(log, start, devices="history").where("device = 'b'").count() == 0


def test_log_without_history(make_log):
    log = make_log(("2022-01-09 05:00:00", "a", 1))
    for rows in (modelling_panel(log, "2022-01-05 10:30:00"), next_day_features(log, "2022-01-05 10:30:00")):
        found = rows.agg(F.count("*"), F.min("hour_slot"), F.max("hour_slot")).first()
        assert tuple(found) == (24, 11, 34)


def test_log_is_scanned_once(spark, make_log, tmp_path):
    make_log(("2022-01-01 05:00:00", "a", 1), ("2022-01-05 03:00:00", "b", 1)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    for panel in (hourly_panel(log), modelling_panel(log, "2022-01-04 00:00:00")):
        panel.collect()
        text = panel._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"ReusedExchange \[device#\d+, _groupingexpression#\d+, min", text)


def test_empty_log_gives_an_empty_panel(make_log):
    log = make_log(("2022-07-01 04:50:00", "A", 1)).where("device = 'none'")
    assert panels.hourly_panel(log).count() == 0


def test_panel_plan_has_no_join_and_two_wide_exchanges(make_log):
    log = make_log(*SHORT)
    plan = panels.modelling_panel(log, "2022-07-03 05:30:00").drop("earliest_activation")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Cartesian" not in text
    # The third belongs to the span and is reused when it runs (test_log_is_scanned_once).
    assert text.count("Exchange hashpartitioning") == 3


def test_a_device_with_most_of_the_log(spark, make_log):
    """One device holds most events; the panel still has one row per device and hour."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    events = spark.range(60_000).select(
        F.timestamp_add("SECOND", F.col("id") * 7, start).alias("time"),
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 97).cast("string"))).alias("device"),
        F.lit(1).alias("device_activated"),
    )
    panel = panels.hourly_panel(events)
    devices = events.select("device").distinct().count()
    lo, hi, rows, active = shape(panel)
    assert (lo, hi, rows) == (0, 116, devices * 117)
    assert active == panels.hourly_rollup(events).count()
    assert panel.agg(F.sum("total_activations")).first()[0] == 60_000
