import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotweave.functions import clock, scalars
from slotweave.operators.panel import event_clock, future_hours


def test_calendar_columns(make_log):
    log = make_log(("2022-07-03 23:50:00", "A", 1), ("2022-07-09 00:00:00", "A", 1))
    slot = F.col("hour_slot")
    rows = (
        event_clock(log, "2022-07-01")
        .select(
            "hour_slot",
            "hour_of_week",
            clock.slot_hour_of_day(slot),
            clock.slot_hour_of_week(slot),
            clock.slot_day(slot),
            clock.slot_week(slot),
            clock.slot_day_of_week(slot),
        )
        .orderBy("hour_slot")
        .collect()
    )
    assert [tuple(row) for row in rows] == [(71, 167, 23, 71, 2, 0, 2), (192, 120, 0, 24, 8, 1, 1)]


def test_slots_before_the_anchor(spark):
    row = spark.range(1).select(
        clock.slot_hour_of_day(F.lit(-1)), clock.slot_day(F.lit(-1)), clock.slot_day_of_week(F.lit(-1))
    ).first()
    assert tuple(row) == (23, -1, 6)


@pytest.mark.parametrize(
    "start, first, last",
    [
        ("2022-08-31 23:59:59", dt.datetime(2022, 9, 1, 0), dt.datetime(2022, 9, 1, 23)),
        ("2022-08-31 14:00:00", dt.datetime(2022, 8, 31, 14), dt.datetime(2022, 9, 1, 13)),
        ("2022-08-31 14:00:00.000001", dt.datetime(2022, 8, 31, 15), dt.datetime(2022, 9, 1, 14)),
    ],
)
def test_future_hours(spark, start, first, last):
    times = sorted(row.time for row in future_hours(spark, start).collect())
    assert (len(times), times[0], times[-1]) == (24, first, last)


def test_slot_label(spark):
    anchor = clock.as_day("2022-07-01")
    assert spark.range(1).select(clock.slot_label(F.lit(49), anchor)).first()[0] == "2022-07-03 01:00:00"


def test_results_do_not_depend_on_the_session_zone(spark, make_log):
    # 02:30 on 2024-03-10 does not exist in New York.
    log = make_log(("2024-03-10 02:30:00", "A", 1), ("2024-03-10 03:30:00", "A", 1))
    before = spark.conf.get("spark.sql.session.timeZone")
    results = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = event_clock(log).select("hour_slot", clock.ceil_hour(F.col("time")).cast("string")).collect()
            results.append(sorted(map(tuple, rows)))
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
    assert results[0] == results[1] == [(2, "2024-03-10 03:00:00"), (3, "2024-03-10 04:00:00")]


def test_clip_and_label(spark):
    values = spark.createDataFrame([(-0.2,), (0.39,), (0.4,), (1.3,), (None,)], "yhat double")
    clipped = scalars.clip_below(F.col("yhat"))
    rows = values.select(clipped, scalars.to_label(clipped, 0.4)).collect()
    assert [tuple(row) for row in rows] == [(0.0, 0), (0.39, 0), (0.4, 1), (1.3, 1), (None, None)]


def test_device_number(spark):
    names = spark.createDataFrame([("device_12",), ("a_b_7",), ("plain",)], "device string")
    assert [r[0] for r in names.select(scalars.device_number(F.col("device"))).collect()] == ["12", "7", "plain"]
