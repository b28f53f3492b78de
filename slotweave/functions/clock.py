"""The hour-slot calendar as column functions.

Everything runs on TIMESTAMP_NTZ and whole hours counted from 1970-01-01, so no result
depends on the session time zone or on daylight saving.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

HOURS_PER_DAY = 24
HOURS_PER_WEEK = 7 * HOURS_PER_DAY


def as_time(value: Column | str | dt.datetime) -> Column:
    """A literal or column as TIMESTAMP_NTZ; bad text raises under ANSI mode."""
    column = value if isinstance(value, Column) else F.lit(str(value))
    return column.cast("timestamp_ntz")


def as_day(value: Column | str | dt.date) -> Column:
    column = value if isinstance(value, Column) else F.lit(str(value))
    return column.cast("date")


def hour_index(time: Column) -> Column:
    """Whole hours from 1970-01-01 00:00 to the hour that holds ``time``."""
    return (F.unix_date(F.to_date(time)) * HOURS_PER_DAY + F.hour(time)).cast("int")


def hour_index_ceil(time: Column) -> Column:
    """As ``hour_index``, rounded up; a whole hour stays as it is."""
    index = hour_index(time)
    return F.when(time > index_time(index), index + 1).otherwise(index)


def index_time(index: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("HOUR", index, epoch)


def ceil_hour(time: Column) -> Column:
    return index_time(hour_index_ceil(time))


def calendar_hour_of_week(time: Column) -> Column:
    """Monday 00:00 is 0, Sunday 23:00 is 167."""
    return (F.weekday(time) * HOURS_PER_DAY + F.hour(time)).cast("int")


def days_since(time: Column, anchor: Column) -> Column:
    return F.date_diff(F.to_date(time), anchor)


def anchor_hour(anchor: Column) -> Column:
    """``hour_index`` of midnight on the anchor date; slot 0 starts there."""
    return F.unix_date(anchor) * HOURS_PER_DAY


def hour_slot(time: Column, anchor: Column) -> Column:
    return (hour_index(time) - anchor_hour(anchor)).cast("int")


def slot_hour_of_day(slot: Column) -> Column:
    return F.pmod(slot, F.lit(HOURS_PER_DAY)).cast("int")


def slot_hour_of_week(slot: Column) -> Column:
    return F.pmod(slot, F.lit(HOURS_PER_WEEK)).cast("int")


def slot_day(slot: Column) -> Column:
    return F.floor(slot / HOURS_PER_DAY).cast("int")


def slot_week(slot: Column) -> Column:
    return F.floor(slot / HOURS_PER_WEEK).cast("int")


def slot_day_of_week(slot: Column) -> Column:
    """Day number modulo 7; it counts from the anchor date, not from Monday."""
    return F.pmod(slot_day(slot), F.lit(7)).cast("int")


def slot_time(slot: Column, anchor: Column) -> Column:
    return F.timestamp_add("HOUR", slot, anchor.cast("timestamp_ntz"))


def slot_label(slot: Column, anchor: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``: the text form of a whole-hour TIMESTAMP_NTZ."""
    return slot_time(slot, anchor).cast("string")
