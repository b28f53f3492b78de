import pytest
from pyspark.sql import functions as F

from slotweave.operators import panel as panels, rates

PANEL = "device string, hour_slot int, is_active int, type string"


def as_panel(spark, rows):
    return panels._with_calendar(
        spark.createDataFrame(rows, PANEL).select(
            "*",
            F.lit(None).cast("timestamp_ntz").alias("earliest_activation"),
            F.lit(None).cast("timestamp_ntz").alias("latest_activation"),
            F.lit(None).cast("bigint").alias("total_activations"),
        )
    )


@pytest.fixture(scope="module")
def panel(spark):
    active = {5, 29, 53, 173}
    return as_panel(spark, [("A", slot, int(slot in active), "train") for slot in range(192)]).cache()


def at(table, slot, *names):
    return tuple(table.where(F.col("hour_slot") == slot).select(*names).first())


def test_features_on_the_planted_device(panel):
    table = rates.model_features(panel, device_rate=True).cache()
    assert at(table, 173, "is_active_yesterday", "is_active_last_week") == (0.0, 1.0)
    assert at(table, 173, "daily_activation_rate", "weekly_activation_rate") == (pytest.approx(3 / 7), 1.0)
    assert at(table, 173, "device_rate_so_far") == (pytest.approx(3 / 173),)
    assert at(table, 170, "yesterdays_device_activation_rate", "last_weeks_device_activation_rate") == (
        0.0,
        pytest.approx(3 / 168),
    )
    assert at(table, 170, "yesterdays_all_device_activation_rate", "last_weeks_all_device_activation_rate") == (
        0.0,
        pytest.approx(3 / 168),
    )
    assert table.where("day_num <= 6 and last_weeks_device_activation_rate <> 0").count() == 0
    assert at(table, 24, "yesterdays_device_activation_rate") == (pytest.approx(1 / 24),)


def test_latest_only(panel):
    table = rates.model_features(panel, rates="latest_only")
    found = {r.hour_slot: r.daily_activation_rate for r in table.where("daily_activation_rate > 0").collect()}
    assert found == {173: pytest.approx(3 / 7)}
    weekly = rates.rate_without_latest(panel, "hour_of_week", "rate")
    assert at(weekly, 173, "rate") == (1.0,)
    assert at(weekly, 100, "rate") == (0.0,)


def test_latest_only_window_equals_the_aggregate(panel):
    for cycle in ("hour_of_day", "hour_of_week"):
        window = panel.select("device", "hour_slot", rates.latest_only_rate(cycle).alias("rate"))
        window = window.na.fill(0.0, ["rate"]).where("rate > 0")
        grouped = rates.rate_without_latest(panel, cycle, "rate").where("rate > 0")
        assert window.collect() == grouped.collect()


def test_daily_rates(panel):
    daily = {r.day_num: r.activation_rate for r in rates.daily_device_rate(panel).collect()}
    assert daily == {d: pytest.approx(1 / 24 if d in (0, 1, 2, 7) else 0.0) for d in range(8)}


def test_overlapping_keys_fan_out_in_the_self_join_only(spark):
    rows = [("A", 10, 0, "train"), ("A", 10, 1, "predict"), ("A", 34, 0, "train")]
    overlap = as_panel(spark, rows)
    joined = rates.lag_by_self_join(overlap, 24, "lag").where("hour_slot = 34").orderBy("lag").collect()
    assert [r.lag for r in joined] == [0.0, 1.0]
    table = overlap.select("hour_slot", rates.lagged_flag(24).alias("lag"))
    assert at(table, 34, "lag") == (1.0,)
    # At one slot the row to predict is the later one and is left out of the mean.
    tied = rates.rate_without_latest(overlap.where("hour_slot = 10"), "hour_of_day", "rate")
    assert [tuple(r) for r in tied.collect()] == [("A", 10, 0.0)]


def test_hole_between_days(spark):
    days = spark.createDataFrame([("A", d, float(d)) for d in (0, 1, 2, 3, 4, 5, 10)], "device string, day_num int, activation_rate double")
    by_rows = rates.rolling_week(days, ["device"]).where("day_num = 10").first()
    assert by_rows.weeks_activation_rate == pytest.approx(25 / 7)
    assert by_rows.lead_day_num == 11
    by_days = rates.rolling_week(days, ["device"], frame="range").where("day_num = 10").first()
    assert by_days.weeks_activation_rate is None


@pytest.mark.parametrize("frame", ["rows", "range"])
def test_day_windows_equal_the_join(spark, frame):
    slots = [s for s in range(5, 400) if not 200 <= s < 250]
    rows = [(d, s, int((s * 7 + len(d)) % 5 == 0), "train") for d in ("A", "BB") for s in slots]
    rows += [(d, s, None, "predict") for d in ("A", "BB") for s in range(410, 434)]
    panel = as_panel(spark, rows)
    windows = rates.with_device_day_rates(panel, frame).select(
        "device", "hour_slot", "yesterdays_device_activation_rate", "last_weeks_device_activation_rate"
    )
    weeks = rates.rolling_week(rates.daily_device_rate(panel), ["device"], frame).select(
        "device", F.col("lead_day_num").alias("day_num"), "activation_rate", "weeks_activation_rate"
    )
    joined = panel.join(weeks, ["device", "day_num"], "left").select(
        "device", "hour_slot", "activation_rate", "weeks_activation_rate"
    )
    left = {tuple(r)[:2]: tuple(r)[2:] for r in windows.collect()}
    right = {tuple(r)[:2]: tuple(r)[2:] for r in joined.collect()}
    assert left.keys() == right.keys()
    for key, values in left.items():
        assert values == pytest.approx(right[key]), key


def test_feature_plan_adds_no_shuffle(make_log):
    log = make_log(("2022-07-01 04:50:00", "A", 1), ("2022-07-09 06:00:00", "B", 1))
    panel = panels.modelling_panel(log, "2022-07-09 07:00:00")
    table = rates.model_features(panel, fleet_day_rates=False).drop(
        "earliest_activation", "latest_activation", "total_activations"
    )
    text = table._jdf.queryExecution().executedPlan().toString()
    # The third belongs to the span and is reused when it runs.
    assert text.count("Exchange hashpartitioning") == 3 and "Join" not in text


def test_fleet_rates_are_broadcast(make_log):
    log = make_log(("2022-07-01 04:50:00", "A", 1), ("2022-07-09 06:00:00", "B", 1))
    panel = panels.modelling_panel(log, "2022-07-09 07:00:00")
    text = rates.model_features(panel)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "NestedLoop" not in text
