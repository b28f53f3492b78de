"""The compat form of the feature table, computed on one row per device and day.

In this form history and hours to predict may share slots: the history is not cut, its grid counts
whole days, every hour to predict counts as active, and a rate is the mean without the latest cell,
on that cell only. A day is four bit masks: hours on the history's grid, active ones among them, and
hours to predict. A slot in both has two cells, so counts add up two masks. The result equals
``model_features`` with ``rates='latest_only'`` on ``modelling_panel`` with ``grid='compat'``,
``cut_history=False`` and ``future_flag='active'``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotweave.functions import clock
from slotweave.operators.day_features import HOURS, day_rollup, flag_of_hour
from slotweave.operators.panel import HORIZON_HOURS, by_device, last_hour, rollup_extent
from slotweave.operators.rates import FEATURES, ROLLING_DAYS, rolling_week


def _hours_between(first: Column, last: Column) -> Column:
    """A mask of the hours of the day from ``first`` to ``last``, as far as they lie on it."""
    low, high = F.greatest(first, F.lit(0)), F.least(last, F.lit(clock.HOURS_PER_DAY - 1))
    bits = F.call_function("shiftleft", F.lit(1), high + 1) - F.call_function("shiftleft", F.lit(1), low)
    return F.when(low <= high, bits).otherwise(F.lit(0))


def overlap_days(
    rollup: DataFrame, extent: Column, start: Column | str | dt.datetime, partitions: int | None = None
) -> DataFrame:
    """device, day_num and the masks grid, active and later of every day that has a cell, from ``day_rollup(log)``."""
    in_order = Window.partitionBy("device").orderBy("day_index")
    placed = by_device(rollup.select("device", "day_index", "active_hours"), partitions).withColumn("extent", extent)
    anchor = F.to_date("extent.first")
    spans = placed.select(
        "device",
        "active_hours",
        (F.col("day_index") - F.unix_date(anchor)).alias("own_day"),
        F.lag("day_index").over(in_order).isNull().alias("is_first"),
        (F.lead("day_index").over(in_order) - F.unix_date(anchor)).alias("next_day"),
        clock.hour_slot(F.col("extent.first"), anchor).alias("first_slot"),
        (last_hour(F.col("extent"), clock.hour_index(F.col("extent.first")), "compat") - clock.anchor_hour(anchor)).alias("last_slot"),
        (clock.hour_index_ceil(clock.as_time(start)) - clock.anchor_hour(anchor)).cast("int").alias("future_slot"),
    )
    # Every row of a device covers the days up to its next one, the first also those before.
    end = F.col("future_slot") + HORIZON_HOURS - 1
    first_day = clock.slot_day(F.least("first_slot", "future_slot"))
    last_day = F.greatest(clock.slot_day(F.greatest(F.col("last_slot"), end)), F.col("own_day"))
    lower = F.when(F.col("is_first"), F.least(first_day, F.col("own_day"))).otherwise(F.col("own_day"))
    upper = F.coalesce(F.col("next_day") - 1, last_day)
    days = spans.select("*", F.explode(F.sequence(lower, upper)).alias("day_num"))
    midnight = F.col("day_num") * clock.HOURS_PER_DAY
    grid = _hours_between(F.col("first_slot") - midnight, F.col("last_slot") - midnight)
    seen = F.when(F.col("day_num") == F.col("own_day"), F.col("active_hours")).otherwise(F.lit(0))
    masks = days.select(
        "device",
        "day_num",
        grid.alias("grid"),
        seen.bitwiseAND(grid).alias("active"),
        _hours_between(F.col("future_slot") - midnight, end - midnight).alias("later"),
    )
    return masks.where(F.col("grid").bitwiseOR(F.col("later")) != 0)


def _latest_only(keys: str) -> dict[str, Column]:
    """For each hour of the group: active cells, cells, and twice the last day that has one plus its flag."""
    over = f"OVER (PARTITION BY {keys})"
    bit = lambda mask, hour: f"(shiftright({mask}, {hour}) & 1)"
    by_hour = lambda text: F.expr(f"array({', '.join(text(hour) for hour in HOURS)})")
    return {
        "total": by_hour(lambda h: f"sum({bit('active', h)} + {bit('later', h)}) {over}"),
        "cells": by_hour(lambda h: f"sum({bit('grid', h)} + {bit('later', h)}) {over}"),
        "last": by_hour(
            lambda h: f"max(CASE WHEN {bit('grid | later', h)} = 1 THEN day_num * 2 + {bit('active | later', h)} END) {over}"
        ),
    }


def overlap_features(
    log: DataFrame, start: Column | str | dt.datetime, frame: str = "rows", partitions: int | None = None
) -> DataFrame:
    """The feature table in the compat form, one row per device, slot and type, from the log."""
    rollup = day_rollup(log)
    return features_from_overlap(overlap_days(rollup, rollup_extent(rollup), start, partitions), frame)


def features_from_overlap(days: DataFrame, frame: str = "rows", day_rates: bool = True) -> DataFrame:
    """As ``overlap_features``, from ``overlap_days``."""
    if frame not in ("rows", "range"):
        raise ValueError(f"unknown frame {frame!r}: use 'rows' or 'range'")
    in_order = Window.partitionBy("device").orderBy("day_num")
    yesterday = in_order.rangeBetween(-1, -1)
    week = in_order.rowsBetween(-ROLLING_DAYS, -1) if frame == "rows" else in_order.rangeBetween(-ROLLING_DAYS, -1)
    any_flag = F.col("active").bitwiseOR(F.col("later"))
    known = F.bit_count("grid") + F.bit_count("later")
    rated = days.withColumns(
        {
            "day_of_week": F.pmod("day_num", F.lit(7)).cast("int"),
            "flags": any_flag,
            "n_active": F.bit_count("active") + F.bit_count("later"),
            "n_cells": known,
        }
    ).withColumn("day_rate", F.col("n_active") / F.col("n_cells"))
    added = {
        "mask_yesterday": F.coalesce(F.max("flags").over(yesterday), F.lit(0)),
        "mask_last_week": F.coalesce(F.max("flags").over(in_order.rangeBetween(-7, -7)), F.lit(0)),
        **{f"daily_{name}": column for name, column in _latest_only("device").items()},
    }
    if day_rates:
        full = (F.count(F.lit(1)).over(yesterday) > 0) & (F.count("day_rate").over(week) == ROLLING_DAYS)
        added["yesterdays_device_activation_rate"] = F.coalesce(F.max("day_rate").over(yesterday), F.lit(0.0))
        added["last_weeks_device_activation_rate"] = F.coalesce(F.when(full, F.avg("day_rate").over(week)), F.lit(0.0))
    wide = rated.withColumns(added)
    wide = wide.withColumns({f"weekly_{name}": column for name, column in _latest_only("device, day_of_week").items()})
    if day_rates:
        daily = rated.groupBy("day_num").agg((F.sum("n_active") / F.sum("n_cells")).alias("activation_rate"))
        # One row per day of the span, so always broadcast.
        fleet = rolling_week(daily, [], frame).select(
            F.col("lead_day_num").alias("day_num"),
            F.col("activation_rate").alias(FEATURES[6]),
            F.col("weeks_activation_rate").alias(FEATURES[7]),
        )
        wide = wide.join(F.broadcast(fleet), "day_num", "left").na.fill(0.0, FEATURES[6:])
    cells = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(clock.HOURS_PER_DAY - 1))).alias("hour_of_day"))
    hour = F.col("hour_of_day")
    kinds = F.array(
        F.when(flag_of_hour("grid", hour) == 1, F.struct(F.lit("train").alias("type"), flag_of_hour("active", hour).alias("is_active"))),
        F.when(flag_of_hour("later", hour) == 1, F.struct(F.lit("predict").alias("type"), F.lit(1).alias("is_active"))),
    )
    cells = cells.select("*", F.inline(F.array_compact(kinds)))

    def rate(cycle: str) -> Column:
        total, count, last = (F.get(f"{cycle}_{name}", hour) for name in ("total", "cells", "last"))
        mean = (total - F.pmod(last, F.lit(2))) / F.nullif(count - 1, F.lit(0))
        is_last = F.floor(last / 2) == F.col("day_num")
        return F.coalesce(F.when(is_last, mean), F.lit(0.0))

    slot = F.col("day_num") * clock.HOURS_PER_DAY + hour
    found = {
        "is_active_last_week": flag_of_hour("mask_last_week", hour).cast("double"),
        "is_active_yesterday": flag_of_hour("mask_yesterday", hour).cast("double"),
        "daily_activation_rate": rate("daily"),
        "weekly_activation_rate": rate("weekly"),
        **{name: F.col(name) for name in FEATURES if name in wide.columns},
    }
    return cells.select(
        "device",
        slot.alias("hour_slot"),
        "hour_of_day",
        clock.slot_hour_of_week(slot).alias("hour_of_week"),
        "day_num",
        clock.slot_week(slot).alias("week_num"),
        "day_of_week",
        "is_active",
        "type",
        *[found[name].alias(name) for name in FEATURES if name in found],
    )
