"""Small scalar functions shared by the forecasts and the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip_below(value: Column, bound: float = 0.0) -> Column:
    """The value, or the bound where it is lower; null stays null."""
    return F.when(value < bound, F.lit(float(bound))).otherwise(value)


def to_label(value: Column, cut: float) -> Column:
    """1 where the value reaches the cut, else 0."""
    return (value >= F.lit(float(cut))).cast("int")


def device_number(device: Column) -> Column:
    """Text after the last underscore; the whole name when there is none."""
    return F.substring_index(device, "_", -1)


def percent_of(part: Column, total: Column) -> Column:
    return part / F.nullif(total, F.lit(0)) * 100
