"""Lags and activation rates as features of a panel.

The per-device features are windows on the panel's own partitioning by device: no
self-join and no further exchange. A frame never crosses a device, and a device has one
row per hour of the span, so the frames are bounded by the calendar and not by the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotweave.functions import clock

FEATURES = [
    "is_active_last_week",
    "is_active_yesterday",
    "daily_activation_rate",
    "weekly_activation_rate",
    "yesterdays_device_activation_rate",
    "last_weeks_device_activation_rate",
    "yesterdays_all_device_activation_rate",
    "last_weeks_all_device_activation_rate",
]

# A window needs this many days before it yields a rolling rate.
ROLLING_DAYS = 7


def lagged_flag(hours: int) -> Column:
    """``is_active`` exactly ``hours`` earlier, 0 where there is no such cell.

    A range frame looks for the slot itself, so a hole in the grid does not shift it.
    """
    exact = Window.partitionBy("device").orderBy("hour_slot").rangeBetween(-hours, -hours)
    return F.coalesce(F.max("is_active").over(exact), F.lit(0)).cast("double")


def lag_by_self_join(panel: DataFrame, hours: int, name: str) -> DataFrame:
    """The lag as a left self-join on (device, slot).

    Differs from ``lagged_flag`` only when keys repeat: each match then gives its own
    row. Equal rows are dropped.
    """
    earlier = panel.select(
        "device",
        (F.col("hour_slot") + hours).alias("hour_slot"),
        F.col("is_active").alias("earlier_flag"),
    )
    joined = panel.select("device", "hour_slot").join(earlier, ["device", "hour_slot"], "left")
    value = F.coalesce(F.col("earlier_flag"), F.lit(0)).cast("double")
    return joined.select("device", "hour_slot", value.alias(name)).distinct()


def rate_before_now(cycle: str) -> Column:
    """Mean of the earlier cells of the same device and ``cycle`` hour."""
    earlier = Window.partitionBy("device", cycle).orderBy("hour_slot").rangeBetween(Window.unboundedPreceding, -1)
    return F.avg("is_active").over(earlier)


def device_rate_before_now() -> Column:
    """Mean of all earlier cells of the same device, 0 on the first."""
    earlier = Window.partitionBy("device").orderBy("hour_slot").rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.avg("is_active").over(earlier), F.lit(0.0))


def _recency() -> Column:
    """Order of a group's cells; at one slot the cell to predict is the later one."""
    return F.struct("hour_slot", (F.col("type") == "predict").alias("is_predict"))


def _mean_without(last_value: Column, total: Column, cells: Column) -> Column:
    return (total - F.coalesce(last_value, F.lit(0))) / F.nullif(cells - 1, F.lit(0))


def rate_without_latest(panel: DataFrame, cycle: str, name: str) -> DataFrame:
    """Per device and ``cycle`` hour: the mean without the latest cell, and that cell's slot.

    A group of one cell has no mean and yields 0.
    """
    total = F.coalesce(F.sum("is_active"), F.lit(0))
    rate = _mean_without(F.max_by("is_active", _recency()), total, F.count(F.lit(1)))
    groups = panel.groupBy("device", cycle).agg(F.max("hour_slot").alias("hour_slot"), rate.alias(name))
    return groups.select("device", "hour_slot", F.coalesce(F.col(name), F.lit(0.0)).alias(name))


def latest_only_rate(cycle: str) -> Column:
    """``rate_without_latest`` placed on the group's latest slot, null on all other rows."""
    group = Window.partitionBy("device", cycle)
    total = F.coalesce(F.sum("is_active").over(group), F.lit(0))
    latest = F.max_by("is_active", _recency()).over(group)
    rate = _mean_without(latest, total, F.count(F.lit(1)).over(group))
    return F.when(F.col("hour_slot") == F.max("hour_slot").over(group), rate)


def daily_device_rate(panel: DataFrame) -> DataFrame:
    return panel.groupBy("device", "day_num").agg(F.avg("is_active").alias("activation_rate"))


def daily_fleet_rate(panel: DataFrame) -> DataFrame:
    return panel.groupBy("day_num").agg(F.avg("is_active").alias("activation_rate"))


def rolling_week(daily: DataFrame, keys: list[str], frame: str = "rows") -> DataFrame:
    """Seven-day moving mean of daily rates, and the next day, on which it is used.

    ``rows`` takes the last seven days that exist; ``range`` the last seven calendar days.
    Without keys the input has one row per day of the span (365 a year), so the single
    window partition stays small however large the log is.
    """
    days = Window.partitionBy(*keys).orderBy("day_num")
    if frame == "rows":
        week = days.rowsBetween(1 - ROLLING_DAYS, 0)
    elif frame == "range":
        week = days.rangeBetween(1 - ROLLING_DAYS, 0)
    else:
        raise ValueError(f"unknown frame {frame!r}: use 'rows' or 'range'")
    full = F.count("activation_rate").over(week) == ROLLING_DAYS
    return daily.select(
        "*",
        F.when(full, F.avg("activation_rate").over(week)).alias("weeks_activation_rate"),
        (F.col("day_num") + 1).alias("lead_day_num"),
    )


def with_device_day_rates(panel: DataFrame, frame: str = "rows") -> DataFrame:
    """The device's rate of yesterday and its rolling rate up to yesterday, on every row.

    Same values as joining ``rolling_week(daily_device_rate(panel), ['device'])`` on the
    next day, but as windows, so the panel is not shuffled by (device, day).
    """
    of_day = Window.partitionBy("device", "day_num").orderBy("hour_slot", "type")
    whole_day = of_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = Window.partitionBy("device").orderBy("day_num")
    yesterday = days.rangeBetween(-1, -1)

    # One row stands for its day; the rolling mean weighs days equally, not rows.
    rated = panel.withColumn("_day_rate", F.avg("is_active").over(whole_day)).withColumn(
        "_day_once", F.when(F.row_number().over(of_day) == 1, F.col("_day_rate"))
    )
    ranked = rated.withColumns(
        {
            "_day_rank": F.dense_rank().over(days) if frame == "rows" else F.col("day_num"),
            "_had_yesterday": F.count(F.lit(1)).over(yesterday) > 0,
            "yesterdays_device_activation_rate": F.max("_day_rate").over(yesterday),
        }
    )
    week = Window.partitionBy("device").orderBy("_day_rank").rangeBetween(-ROLLING_DAYS, -1)
    full = F.col("_had_yesterday") & (F.count("_day_once").over(week) == ROLLING_DAYS)
    rolling = F.when(full, F.avg("_day_once").over(week))
    return ranked.withColumn("last_weeks_device_activation_rate", rolling).drop(
        "_day_rate", "_day_once", "_day_rank", "_had_yesterday"
    )


def with_fleet_day_rates(rows: DataFrame, panel: DataFrame, frame: str = "rows") -> DataFrame:
    """``rows`` with the fleet's rate of yesterday and its rolling rate up to yesterday.

    The joined side has one row per day of the span. Even the whole range of dates Spark
    can hold is under four million rows of 24 bytes, so it can always be broadcast; a
    shuffle on the day would put the whole fleet's day on one task.
    """
    fleet = rolling_week(daily_fleet_rate(panel), [], frame).select(
        F.col("lead_day_num").alias("day_num"),
        F.col("activation_rate").alias("yesterdays_all_device_activation_rate"),
        F.col("weeks_activation_rate").alias("last_weeks_all_device_activation_rate"),
    )
    return rows.join(F.broadcast(fleet), "day_num", "left")


def previous_day_rates(panel: DataFrame, frame: str = "rows") -> DataFrame:
    """``device, hour_slot`` and the four rates of the days before, of device and fleet.

    Same values as ``with_device_day_rates`` and ``with_fleet_day_rates``, computed on one
    row per device and day; its hours are written out last. The panel's partitioning by
    device carries the aggregation and the windows, so only the fleet's days are shuffled.
    """
    days = panel.groupBy("device", "day_num").agg(
        F.sum("is_active").alias("active"), F.count("is_active").alias("known"), F.collect_list("hour_slot").alias("slots")
    )
    days = days.withColumn("activation_rate", F.col("active") / F.nullif("known", F.lit(0)))
    in_order = Window.partitionBy("device").orderBy("day_num")
    yesterday = in_order.rangeBetween(-1, -1)
    week = in_order.rowsBetween(-ROLLING_DAYS, -1) if frame == "rows" else in_order.rangeBetween(-ROLLING_DAYS, -1)
    full = (F.count(F.lit(1)).over(yesterday) > 0) & (F.count("activation_rate").over(week) == ROLLING_DAYS)
    rated = days.select(
        "device",
        "day_num",
        "slots",
        F.max("activation_rate").over(yesterday).alias("yesterdays_device_activation_rate"),
        F.when(full, F.avg("activation_rate").over(week)).alias("last_weeks_device_activation_rate"),
    )
    daily = days.groupBy("day_num").agg((F.sum("active") / F.nullif(F.sum("known"), F.lit(0))).alias("activation_rate"))
    fleet = rolling_week(daily, [], frame).select(
        F.col("lead_day_num").alias("day_num"),
        F.col("activation_rate").alias("yesterdays_all_device_activation_rate"),
        F.col("weeks_activation_rate").alias("last_weeks_all_device_activation_rate"),
    )
    joined = rated.join(F.broadcast(fleet), "day_num", "left")
    return joined.select("device", F.explode("slots").alias("hour_slot"), *FEATURES[4:])


def model_features(
    panel: DataFrame,
    rates: str = "before_now",
    device_day_rates: bool = True,
    fleet_day_rates: bool = True,
    device_rate: bool = False,
    frame: str = "rows",
) -> DataFrame:
    """The panel with its features; missing values are 0, timestamps are left alone.

    ``rates='before_now'`` gives every row the mean of its past; ``'latest_only'`` gives
    it only to the latest slot of each group and 0 to the others. The day rates are used
    by neither model and can be left out. ``device_rate`` adds a column that stands in
    for the device where a fleet is too large to encode.

    The first windows are keyed by the device alone, so a panel that is not yet
    partitioned by device is shuffled once, and the other windows follow on that.
    """
    if rates == "before_now":
        rate = rate_before_now
    elif rates == "latest_only":
        rate = latest_only_rate
    else:
        raise ValueError(f"unknown rates {rates!r}: use 'before_now' or 'latest_only'")
    added = {
        "is_active_last_week": lagged_flag(clock.HOURS_PER_WEEK),
        "is_active_yesterday": lagged_flag(clock.HOURS_PER_DAY),
    }
    if device_rate:
        added["device_rate_so_far"] = device_rate_before_now()
    features = panel.withColumns(added)
    if device_day_rates:
        features = with_device_day_rates(features, frame)
    features = features.withColumn("daily_activation_rate", rate("hour_of_day"))
    features = features.withColumn("weekly_activation_rate", rate("hour_of_week"))
    if fleet_day_rates:
        features = with_fleet_day_rates(features, panel, frame)
    present = [name for name in FEATURES if name in features.columns]
    ordered = panel.columns + present + (["device_rate_so_far"] if device_rate else [])
    return features.na.fill(0.0, present).select(*ordered)
