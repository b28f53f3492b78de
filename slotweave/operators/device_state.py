"""What scoring needs of the past, in a few rows per device.

A state covers whole days before ``until``. Per device and weekday it holds how often each hour
was active and the last such day that had any activity; one more row holds the span of the
history. That is all that lags of a day and a week and the mean rates need, so the next day is
scored from the state and the events since, and the history is never read again. A state is
brought forward with the events of the days between, which add up.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotweave.functions import clock
from slotweave.operators.day_features import HOURS, day_rollup, flag_of_hour, rate_of, times_before
from slotweave.operators.panel import HORIZON_HOURS, first_future_hour
from slotweave.operators.rates import FEATURES
from slotweave.session import write_stage

WEEKDAYS = 7
_SPAN = "until date, first timestamp_ntz, last timestamp_ntz"


@dataclass(frozen=True)
class DeviceState:
    """``rows``: device, weekday, counts (24), last_day, last_mask; ``span``: until, first, last (one row)."""

    rows: DataFrame
    span: DataFrame

    @property
    def until(self) -> dt.date:
        return self.span.first()["until"]


def _day(day: dt.date) -> int:
    return (day - dt.date(1970, 1, 1)).days


def _as_date(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def _midnight(day: dt.date) -> Column:
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def _day_rows(rollup: DataFrame) -> DataFrame:
    """A rollup of device days in the form of state rows."""
    bits = [F.getbit(F.col("active_hours").cast("bigint"), F.lit(hour)).cast("bigint") for hour in HOURS]
    return rollup.select(
        "device",
        F.pmod("day_index", F.lit(WEEKDAYS)).cast("int").alias("weekday"),
        F.array(*bits).alias("counts"),
        F.col("day_index").alias("last_day"),
        F.col("active_hours").cast("int").alias("last_mask"),
    )


def _added(rows: DataFrame) -> DataFrame:
    """State rows added up: one per device and weekday."""
    counts = [F.sum(F.get("counts", F.lit(hour))).alias(f"c{hour}") for hour in HOURS]
    summed = rows.groupBy("device", "weekday").agg(*counts, F.max(F.struct("last_day", "last_mask")).alias("last"))
    return summed.select("device", "weekday", F.array(*[f"c{hour}" for hour in HOURS]).alias("counts"), "last.*")


def _span_of(rollup: DataFrame) -> tuple[dt.datetime | None, dt.datetime | None]:
    return tuple(rollup.agg(F.min("earliest_activation"), F.max("latest_activation")).first())


def _state(rows: DataFrame, until: dt.date, first: dt.datetime | None, last: dt.datetime | None) -> DeviceState:
    rows = write_stage(rows, "state")
    return DeviceState(rows, rows.sparkSession.createDataFrame([(until, first, last)], _SPAN))


def state_from_rollup(rollup: DataFrame, until: dt.date | str) -> DeviceState:
    """The state before ``until``, from a ``day_rollup``."""
    until = _as_date(until)
    before = rollup.where((F.col("day_index") < _day(until)) & (F.col("active_hours") != 0))
    return _state(_added(_day_rows(before)), until, *_span_of(before))


def build_state(log: DataFrame, until: dt.date | str) -> DeviceState:
    """The state of a log before ``until``; later events are not read."""
    until = _as_date(until)
    return state_from_rollup(write_stage(day_rollup(log.where(F.col("time") < _midnight(until))), "rollup"), until)


def advance(state: DeviceState, log: DataFrame, until: dt.date | str) -> DeviceState:
    """The state before ``until``, from an earlier state and the events since."""
    until, earlier = _as_date(until), state.span.first()
    if until < earlier["until"]:
        raise ValueError(f"the state already covers the days before {earlier['until']}")
    since = log.where((F.col("time") >= _midnight(earlier["until"])) & (F.col("time") < _midnight(until)))
    rollup = write_stage(day_rollup(since), "rollup")
    first, last = _span_of(rollup)
    rows = _added(state.rows.unionByName(_day_rows(rollup)))
    return _state(rows, until, earlier["first"] or first, last or earlier["last"])


def features_from_state(
    state: DeviceState, log: DataFrame, start: Column | str | dt.datetime, device_rate: bool = False
) -> tuple[DataFrame, Column]:
    """Features of the 24 hours from ``start``, and the calendar's first day.

    Equal to the rows to predict of ``next_day_features`` over the whole log; of the log, only
    events since the state are read.
    """
    spark, kept = log.sparkSession, state.span.first()
    since = log.where(F.col("time") >= _midnight(kept["until"]))
    rollup = write_stage(day_rollup(since, start), "rollup")
    later_first, later_last = _span_of(rollup)
    first, last = kept["first"] or later_first, later_last or kept["last"]
    opening = spark.range(1).select(first_future_hour(start).alias("hour")).first()["hour"]
    if opening < dt.datetime.combine(kept["until"], dt.time()):
        raise ValueError(f"the state covers the days before {kept['until']}; it cannot score {opening}")
    anchor = (first or opening).date()
    today = _day(opening.date())
    future = today * clock.HOURS_PER_DAY + opening.hour - _day(anchor) * clock.HOURS_PER_DAY

    # The hours to predict lie on two days at most; their weekdays and the days before are known.
    rows = state.rows.unionByName(_day_rows(rollup))
    figures: list[Column] = []
    for hour in HOURS:
        count = F.get("counts", F.lit(hour))
        figures.append(F.sum(count).alias(f"daily{hour}"))
        for place in (0, 1):
            same = F.col("weekday") == (today + place) % WEEKDAYS
            figures.append(F.coalesce(F.sum(F.when(same, count)), F.lit(0)).alias(f"weekly{place}_{hour}"))
    for name, day in (("y0", today - 1), ("y1", today), ("w0", today - 7), ("w1", today - 6)):
        figures.append(F.coalesce(F.max(F.when(F.col("last_day") == day, F.col("last_mask"))), F.lit(0)).alias(name))
    devices = rows.groupBy("device").agg(*figures)
    by_hour = lambda name: F.array(*[f"{name}{hour}" for hour in HOURS])
    devices = devices.select(
        "device", "y0", "y1", "w0", "w1", by_hour("daily").alias("daily"), by_hour("weekly0_").alias("weekly0"), by_hour("weekly1_").alias("weekly1")
    )
    slots = F.sequence(F.lit(future), F.lit(future + HORIZON_HOURS - 1))
    cells = devices.select("*", F.explode(slots).alias("hour_slot"))
    slot, hour = F.col("hour_slot"), F.col("hour_of_day")
    cells = cells.withColumns(
        {"hour_of_day": clock.slot_hour_of_day(slot), "is_today": clock.slot_day(slot) == today - _day(anchor)}
    )
    chosen = lambda name: F.when(F.col("is_today"), F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    cells = cells.withColumns({"mask_yesterday": chosen("y"), "mask_last_week": chosen("w"), "weekly": chosen("weekly")})
    if first is None:
        low, high = F.lit(future), F.lit(future - 1)
    else:
        low, high = (F.lit(_day(t.date()) * 24 + t.hour - _day(anchor) * 24) for t in (first, last))
    found = {
        "is_active_last_week": flag_of_hour("mask_last_week", hour).cast("double"),
        "is_active_yesterday": flag_of_hour("mask_yesterday", hour).cast("double"),
        "daily_activation_rate": rate_of(F.get("daily", hour), times_before(low, high, slot, clock.HOURS_PER_DAY)),
        "weekly_activation_rate": rate_of(F.get("weekly", hour), times_before(low, high, slot, clock.HOURS_PER_WEEK)),
    }
    features = [found[name].alias(name) for name in FEATURES if name in found]
    if device_rate:
        active = F.aggregate("daily", F.lit(0).cast("bigint"), lambda total, n: total + n)
        features.append(rate_of(active, F.least(high, slot - 1) - low + 1).alias("device_rate_so_far"))
    table = cells.select(
        "device",
        "hour_slot",
        "hour_of_day",
        clock.slot_hour_of_week(slot).alias("hour_of_week"),
        clock.slot_day(slot).alias("day_num"),
        clock.slot_week(slot).alias("week_num"),
        clock.slot_day_of_week(slot).alias("day_of_week"),
        F.lit(None).cast("int").alias("is_active"),
        F.lit("predict").alias("type"),
        *features,
    )
    return table, F.lit(str(anchor)).cast("date")


def save_state(state: DeviceState, path: str) -> None:
    state.rows.write.mode("overwrite").parquet(f"{path}/rows")
    state.span.coalesce(1).write.mode("overwrite").parquet(f"{path}/span")


def load_state(spark: SparkSession, path: str) -> DeviceState:
    return DeviceState(spark.read.parquet(f"{path}/rows"), spark.read.schema(_SPAN).parquet(f"{path}/span"))
