"""The feature table computed on one row per device and day.

``model_features`` on an hourly panel sorts every cell several times. The features need
only the activity flag, and a day's 24 flags fit into one integer. So the log is reduced
to a bit mask per device and day, all windows run on those rows (1/24 of the cells), and
the hours are written out in the last step. The result equals ``model_features`` with
``rates='before_now'`` on ``modelling_panel`` with its defaults.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotweave.functions import clock
from slotweave.operators.panel import HORIZON_HOURS, by_device, first_future_hour, history_before, rollup_extent
from slotweave.operators.rates import FEATURES, ROLLING_DAYS, rolling_week
from slotweave.sources.activations import usable

HOURS = range(clock.HOURS_PER_DAY)


def day_rollup(log: DataFrame, start: Column | str | dt.datetime | None = None) -> DataFrame:
    """Per device and day (counted from 1970): the active hours as bits, first and last time.

    The mask is built before the shuffle, which then carries at most one row per device,
    day and task. The filter holds for every row. It makes each reader of the rollup ask
    for the same aggregates, so that the span (times) and the days (masks) share one scan
    and one exchange of the log instead of two.

    With ``start``, masks and times are those before the first hour to predict, and later
    events are put on that hour's day: a row with an empty mask tells that a device exists.
    """
    hour_bit, time, day = F.expr("shiftleft(1, hour(time))"), F.col("time"), F.unix_date(F.to_date("time"))
    if start is not None:
        first = first_future_hour(start)
        before = time < first
        hour_bit, time = F.when(before, hour_bit).otherwise(F.lit(0)), F.when(before, time)
        day = F.least(day, F.unix_date(F.to_date(first)))
    rollup = (
        usable(log)
        .groupBy("device", day.alias("day_index"))
        .agg(
            F.bit_or(hour_bit).alias("active_hours"),
            F.min(time).alias("earliest_activation"),
            F.max(time).alias("latest_activation"),
        )
    )
    ordered = F.coalesce(F.col("earliest_activation") <= F.col("latest_activation"), F.lit(True))
    return rollup.where((F.col("active_hours") >= 0) & ordered)


def flag_of_hour(mask: str, hour: Column) -> Column:
    return F.call_function("shiftright", F.col(mask), hour).bitwiseAND(F.lit(1))


def times_before(first: Column, last: Column, slot: Column, cycle: int) -> Column:
    """How many slots of [first, last] lie before ``slot`` at the same point of the cycle."""
    point = F.pmod(slot, F.lit(cycle))
    top = F.least(last, slot - 1)
    return F.floor((top - point) / cycle) - F.floor((first - 1 - point) / cycle)


def rate_of(active: Column, cells: Column) -> Column:
    return F.when(cells > 0, active / cells).otherwise(F.lit(0.0))


def device_days(
    rollup: DataFrame,
    extent: Column,
    start: Column | str | dt.datetime,
    anchor: Column | str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per device and day of the grid, with the day's mask and its history cells.

    ``first_slot`` to ``last_slot`` is the history, ``future_slot`` the first slot to
    predict; the history must end before it. It is empty for devices that have none.
    """
    in_order = Window.partitionBy("device").orderBy("day_index")
    # One reference to the subquery; everything below reads this column.
    placed = by_device(rollup.select("device", "day_index", "active_hours"), partitions).withColumn("extent", extent)
    first, last = F.col("extent.first"), F.col("extent.last")
    anchor = F.to_date(first) if anchor is None else clock.as_day(anchor)
    # Without any history the calendar begins on the day to predict.
    anchor = F.coalesce(anchor, F.to_date(first_future_hour(start)))
    spans = placed.select(
        "device",
        "active_hours",
        (F.col("day_index") - F.unix_date(anchor)).alias("own_day"),
        F.lag("day_index").over(in_order).isNull().alias("is_first"),
        (F.lead("day_index").over(in_order) - F.unix_date(anchor)).alias("next_day"),
        clock.hour_slot(first, anchor).alias("first_slot"),
        clock.hour_slot(last, anchor).alias("last_slot"),
        (clock.hour_index_ceil(clock.as_time(start)) - clock.anchor_hour(anchor)).cast("int").alias("future_slot"),
    )
    # An empty mask comes last; where it comes first, the device has no history.
    bare = F.col("is_first") & (F.col("active_hours") == 0)
    start_slot = F.coalesce("first_slot", "future_slot")
    spans = spans.withColumns({"first_slot": start_slot, "last_slot": F.when(bare, start_slot - 1).otherwise(F.col("last_slot"))})
    first_day, last_day = clock.slot_day(F.col("first_slot")), clock.slot_day(F.col("last_slot"))
    lower = F.when(F.col("is_first"), first_day).otherwise(F.col("own_day"))
    upper = F.least(F.coalesce(F.col("next_day") - 1, last_day), last_day)
    history = F.when(~bare & (lower <= upper), F.sequence(lower, upper)).otherwise(F.array().cast("array<int>"))
    # Days that hold hours to predict and no history; the first row of a device adds them.
    first_later = clock.slot_day(F.col("future_slot"))
    later = F.sequence(
        F.when(bare, first_later).otherwise(F.greatest(last_day + 1, first_later)),
        clock.slot_day(F.col("future_slot") + HORIZON_HOURS - 1),
    )
    days = F.when(F.col("is_first"), F.concat(history, later)).otherwise(history)
    bounds = ["first_slot", "last_slot", "future_slot"]
    exploded = spans.select("device", "active_hours", "own_day", *bounds, F.explode(days).alias("day_num"))
    midnight = F.col("day_num") * clock.HOURS_PER_DAY
    cells = F.least(F.col("last_slot"), midnight + clock.HOURS_PER_DAY - 1) - F.greatest(F.col("first_slot"), midnight) + 1
    return exploded.select(
        "device",
        "day_num",
        F.when(F.col("day_num") == F.col("own_day"), F.col("active_hours")).otherwise(F.lit(0)).alias("mask"),
        F.greatest(cells, F.lit(0)).alias("cells"),
        *bounds,
    )


def features_from_days(
    days: DataFrame,
    device_day_rates: bool = True,
    fleet_day_rates: bool = True,
    device_rate: bool = False,
    frame: str = "rows",
) -> DataFrame:
    """The feature table, one row per device and hour, from ``device_days``."""
    in_order = Window.partitionBy("device").orderBy("day_num")
    yesterday = in_order.rangeBetween(-1, -1)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)

    def hourly_counts(keys: str) -> Column:
        """For each hour of the day, the earlier days of the group on which it was active."""
        before = f"(PARTITION BY {keys} ORDER BY day_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        counts = [f"sum(shiftright(mask, {hour}) & 1) OVER {before}" for hour in HOURS]
        return F.expr(f"array({', '.join(counts)})")

    rated = days.withColumns(
        {
            "day_of_week": F.pmod("day_num", F.lit(7)).cast("int"),
            "day_rate": F.when(F.col("cells") > 0, F.bit_count("mask") / F.col("cells")),
        }
    )
    added = {
        "mask_yesterday": F.coalesce(F.max("mask").over(yesterday), F.lit(0)),
        "mask_last_week": F.coalesce(F.max("mask").over(in_order.rangeBetween(-7, -7)), F.lit(0)),
        "counts_daily": hourly_counts("device"),
    }
    if device_rate:
        added["active_before"] = F.coalesce(F.sum(F.bit_count("mask")).over(earlier), F.lit(0))
    if device_day_rates:
        if frame == "rows":
            week = in_order.rowsBetween(-ROLLING_DAYS, -1)
        elif frame == "range":
            week = in_order.rangeBetween(-ROLLING_DAYS, -1)
        else:
            raise ValueError(f"unknown frame {frame!r}: use 'rows' or 'range'")
        full = (F.count(F.lit(1)).over(yesterday) > 0) & (F.count("day_rate").over(week) == ROLLING_DAYS)
        added["yesterdays_device_activation_rate"] = F.coalesce(F.max("day_rate").over(yesterday), F.lit(0.0))
        rolling = F.when(full, F.avg("day_rate").over(week))
        added["last_weeks_device_activation_rate"] = F.coalesce(rolling, F.lit(0.0))
    wide = rated.withColumns(added).withColumn("counts_weekly", hourly_counts("device, day_of_week"))
    if fleet_day_rates:
        wide = wide.join(F.broadcast(_fleet_rates(days, frame)), "day_num", "left").na.fill(0.0, FEATURES[6:])

    midnight = F.col("day_num") * clock.HOURS_PER_DAY
    cells = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(clock.HOURS_PER_DAY - 1))).alias("hour_of_day"))
    cells = cells.withColumn("hour_slot", midnight + F.col("hour_of_day"))
    hour, slot, future = F.col("hour_of_day"), F.col("hour_slot"), F.col("future_slot")
    first, last = F.col("first_slot"), F.col("last_slot")
    is_future = slot >= future
    on_grid = slot.between(first, last) | slot.between(future, future + HORIZON_HOURS - 1)
    columns = {
        "is_active_last_week": flag_of_hour("mask_last_week", hour).cast("double"),
        "is_active_yesterday": flag_of_hour("mask_yesterday", hour).cast("double"),
        "daily_activation_rate": rate_of(
            F.get("counts_daily", hour), times_before(first, last, slot, clock.HOURS_PER_DAY)
        ),
        "weekly_activation_rate": rate_of(
            F.get("counts_weekly", hour), times_before(first, last, slot, clock.HOURS_PER_WEEK)
        ),
    }
    if device_rate:
        lower_bits = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), hour) - 1)
        columns["device_rate_so_far"] = rate_of(
            F.col("active_before") + F.bit_count(lower_bits), F.least(last, slot - 1) - first + 1
        )
    day_rates = {name: F.col(name) for name in FEATURES if name in wide.columns}
    found = {**day_rates, **columns}
    features = [found[name].alias(name) for name in [*FEATURES, "device_rate_so_far"] if name in found]
    return cells.where(on_grid).select(
        "device",
        "hour_slot",
        "hour_of_day",
        clock.slot_hour_of_week(slot).alias("hour_of_week"),
        "day_num",
        clock.slot_week(slot).alias("week_num"),
        "day_of_week",
        F.when(~is_future, flag_of_hour("mask", hour)).alias("is_active"),
        F.when(is_future, F.lit("predict")).otherwise(F.lit("train")).alias("type"),
        *features,
    )


def _fleet_rates(days: DataFrame, frame: str) -> DataFrame:
    """Fleet rates keyed by the day they are used on: one row per day, so always broadcast."""
    cells = F.nullif(F.sum("cells"), F.lit(0))
    daily = days.groupBy("day_num").agg((F.sum(F.bit_count("mask")) / cells).alias("activation_rate"))
    return rolling_week(daily, [], frame).select(
        F.col("lead_day_num").alias("day_num"),
        F.col("activation_rate").alias(FEATURES[6]),
        F.col("weeks_activation_rate").alias(FEATURES[7]),
    )


def next_day_features(
    log: DataFrame,
    start: Column | str | dt.datetime,
    device_day_rates: bool = True,
    fleet_day_rates: bool = True,
    device_rate: bool = False,
    frame: str = "rows",
    partitions: int | None = None,
    devices: str = "log",
) -> DataFrame:
    """Features of the history before ``start`` and of the 24 hours from it, from the log.

    Devices come from the whole log; ``devices='history'`` leaves out those first seen at
    or after ``start``, and the time then filters the scan.
    """
    if devices not in ("log", "history"):
        raise ValueError(f"unknown devices {devices!r}: use 'log' or 'history'")
    rollup = day_rollup(history_before(log, start) if devices == "history" else log, start)
    days = device_days(rollup, rollup_extent(rollup), start, partitions=partitions)
    return features_from_days(days, device_day_rates, fleet_day_rates, device_rate, frame)
