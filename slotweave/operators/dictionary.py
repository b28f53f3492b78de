"""Consecutive numbers for ordered rows and distinct values, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotweave.session import write_stage

#: Bits of ``monotonically_increasing_id`` that count the rows of one partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: str | Column, number: str = "number") -> DataFrame:
    """``rows`` with consecutive numbers from 0 in the given order, as a written table.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus
    the rows of all partitions before. Only one count per partition is summed up and broadcast.
    Rows that the order does not tell apart get numbers in any order.
    """
    placed = write_stage(rows.orderBy(*order).withColumn(number, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(number), _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).count()
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col(number).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    found = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return found.withColumn(number, F.col("_start") + place).drop("_part", "_start")


def dictionary(values: DataFrame, column: str, number: str = "number") -> DataFrame:
    """The distinct values of ``column``, numbered from 0 by code point, null last."""
    return numbered(values.select(column).distinct(), F.col(column).asc_nulls_last(), number=number)
