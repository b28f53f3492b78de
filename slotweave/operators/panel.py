"""From the activation log to one row per device and hour.

The log is reduced once to an hourly rollup (partial aggregation runs before the shuffle,
so a device with a third of all events sends at most one row per hour and task). The
rollup is then hash-partitioned by device, and every rollup row writes the empty hours up
to the next one itself. No grid is shuffled and nothing is joined; all later windows are
keyed by device and reuse this partitioning.

A device holds at most one row per hour of the observed span, whatever its event count.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from slotweave.functions import clock
from slotweave.session import device_partitions
from slotweave.sources.activations import usable

HORIZON_HOURS = 24

# Cells of the grid in one partition: some 200 MB of features.
CELLS_PER_PARTITION = 2_000_000

PANEL_COLUMNS = [
    "device",
    "hour_slot",
    "hour_of_day",
    "hour_of_week",
    "day_num",
    "week_num",
    "day_of_week",
    "earliest_activation",
    "latest_activation",
    "total_activations",
    "is_active",
    "type",
]


def event_clock(log: DataFrame, anchor: Column | str | None = None) -> DataFrame:
    """The log with its calendar columns, counted from ``anchor`` (default: first date)."""
    time = F.col("time")
    anchor = first_day(log) if anchor is None else clock.as_day(anchor)
    return log.select(
        "*",
        F.to_date(time).alias("event_date"),
        F.hour(time).alias("hour_of_day"),
        clock.calendar_hour_of_week(time).alias("hour_of_week"),
        clock.days_since(time, anchor).alias("days_since_anchor"),
        clock.hour_slot(time, anchor).alias("hour_slot"),
    )


def time_extent(log: DataFrame) -> Column:
    """``struct(first, last)`` of the log's times, as a scalar subquery over that one column."""
    times = usable(log).agg(F.struct(F.min("time").alias("first"), F.max("time").alias("last")).alias("extent"))
    return times.scalar()


def rollup_extent(rollup: DataFrame, start: Column | str | dt.datetime | None = None) -> Column:
    """As ``time_extent``, read from a rollup; with ``start``, of the hours before it.

    A lazy rollup is computed once: this and its other readers share its exchange.
    """
    times = [F.col("earliest_activation"), F.col("latest_activation")]
    if start is not None:
        times = [F.when(F.col("hour_index") < clock.hour_index_ceil(clock.as_time(start)), time) for time in times]
    first, last = F.min(times[0]), F.max(times[1])
    return rollup.agg(F.struct(first.alias("first"), last.alias("last")).alias("extent")).scalar()


def first_day(log: DataFrame) -> Column:
    return F.to_date(time_extent(log).getField("first"))


def devices(log: DataFrame) -> DataFrame:
    return log.select("device").where(F.col("device").isNotNull()).distinct()


def hourly_rollup(log: DataFrame, start: Column | str | dt.datetime | None = None) -> DataFrame:
    """First and last time and summed value per device and hour.

    The hour counts from 1970, not from an anchor, so rollups of separate loads can be
    kept in one table. With ``start``, all that a device has at or after the first hour to
    predict becomes one row at that hour: it only tells that the device exists.

    The filter holds for every row. It makes each reader ask for the same aggregates, so
    that the readers of a lazy rollup share one scan and one exchange of the log.
    """
    hour = clock.hour_index(F.col("time"))
    if start is not None:
        hour = F.least(hour, clock.hour_index_ceil(clock.as_time(start)))
    rollup = (
        usable(log)
        .groupBy("device", hour.alias("hour_index"))
        .agg(
            F.min("time").alias("earliest_activation"),
            F.max("time").alias("latest_activation"),
            F.coalesce(F.sum("device_activated"), F.lit(0)).cast("bigint").alias("total_activations"),
        )
    )
    ordered = F.col("earliest_activation") <= F.col("latest_activation")
    return rollup.where(ordered & (F.col("total_activations") >= -(1 << 63)))


def history_before(log: DataFrame, start: Column | str | dt.datetime) -> DataFrame:
    """Log rows before the first hour to predict.

    A text or datetime becomes a literal, which reaches the scan as a pushed filter.
    """
    return log.where(F.col("time") < first_future_hour(start))


def first_future_hour(start: Column | str | dt.datetime) -> Column:
    return clock.ceil_hour(clock.as_time(start))


def last_hour(extent: Column, first_hour: Column, grid: str) -> Column:
    """Last hour of the grid.

    ``span`` ends at the last event. ``compat`` counts whole days between the first and
    the last event and so may end too early or too late.
    """
    first, last = extent.getField("first"), extent.getField("last")
    if grid == "span":
        return clock.hour_index(last)
    if grid == "compat":
        whole_days = F.timestamp_diff("DAY", first, last)
        return (first_hour + (whole_days + 1) * clock.HOURS_PER_DAY - 1).cast("int")
    raise ValueError(f"unknown grid {grid!r}: use 'span' or 'compat'")


def by_device(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partition by device.

    The partition count is explicit because the rows multiply after this exchange, and
    adaptive coalescing would size the partitions by the short side of it. Jobs, which have
    written the rollup, take it from ``grid_partitions``.
    """
    return df.repartition(partitions or device_partitions(df.sparkSession), "device")


def grid_partitions(rollup: DataFrame, extent: Column, rows: int = CELLS_PER_PARTITION) -> int:
    """How many partitions the written-out grid needs, from a written rollup's own devices and span.

    Adaptive execution sees the rows before they multiply; this counts the cells they become.
    """
    found = rollup.agg(F.approx_count_distinct("device").alias("devices")).withColumn("extent", extent)
    hours = clock.hour_index(F.col("extent.last")) - clock.hour_index(F.col("extent.first")) + 1 + HORIZON_HOURS
    cells = found.select((F.col("devices") * F.coalesce(hours, F.lit(HORIZON_HOURS))).alias("cells")).first()["cells"]
    return max(1, -(-int(cells) // rows))


def panel_from_rollup(
    rollup: DataFrame,
    extent: Column,
    anchor: Column | str | None = None,
    grid: str = "span",
    start: Column | str | dt.datetime | None = None,
    future_flag: str = "null",
    partitions: int | None = None,
    cut_history: bool = False,
) -> DataFrame:
    """Gap-free panel of the history and, when ``start`` is given, of the hours to predict.

    With ``cut_history``, rows of the rollup at or after ``start`` are no history; their
    devices get the hours to predict. ``future_flag='null'`` leaves ``is_active`` unknown on the hours to predict;
    ``'active'`` treats each of them as one event with the value -1.
    """
    if future_flag not in ("null", "active"):
        raise ValueError(f"unknown future_flag {future_flag!r}: use 'null' or 'active'")
    in_order = Window.partitionBy("device").orderBy("hour_index")
    # One reference to the subquery; everything below reads this column.
    placed = by_device(rollup, partitions).withColumn("extent", extent)
    first = F.col("extent.first")
    anchor = F.to_date(first) if anchor is None else clock.as_day(anchor)
    is_later, next_hour = F.lit(False), F.lead("hour_index").over(in_order)
    if cut_history:
        cut = clock.hour_index_ceil(clock.as_time(start))
        is_later, next_hour = F.col("hour_index") >= cut, F.when(next_hour < cut, next_hour)
        # Without any history the calendar begins on the day to predict.
        anchor = F.coalesce(anchor, F.to_date(first_future_hour(start)))
    spans = placed.select(
        "*",
        F.lag("hour_index").over(in_order).isNull().alias("is_first"),
        is_later.alias("is_later"),
        next_hour.alias("next_hour"),
        clock.hour_index(first).alias("first_hour"),
        last_hour(F.col("extent"), clock.hour_index(first), grid).alias("last_hour"),
        clock.anchor_hour(anchor).alias("anchor_hour"),
    )
    # Each rollup row covers itself and the gap after it; the first also covers the gap
    # before it. The bounds are clamped to the grid, and an empty span yields no row.
    lower = F.when(F.col("is_first"), F.col("first_hour")).otherwise(F.col("hour_index"))
    upper = F.least(F.coalesce(F.col("next_hour") - 1, F.col("last_hour")), F.col("last_hour"))
    upper = F.when(~F.col("is_later"), upper)
    history = F.struct(F.lit("train").alias("type"), lower.alias("lower"), upper.alias("upper"))
    pieces = F.array(history)
    if start is not None:
        future_hour = clock.hour_index_ceil(clock.as_time(start))
        future = F.struct(
            F.lit("predict").alias("type"),
            future_hour.alias("lower"),
            (future_hour + HORIZON_HOURS - 1).alias("upper"),
        )
        pieces = F.when(F.col("is_first"), F.array(history, future)).otherwise(pieces)
    kept = ["device", "hour_index", "earliest_activation", "latest_activation", "total_activations"]
    hours = F.when(F.col("lower") <= F.col("upper"), F.sequence("lower", "upper"))
    carried = [*kept, "anchor_hour"]
    cells = spans.select(*carried, F.inline(pieces)).select(*carried, "type", F.explode(hours).alias("cell_hour"))

    is_history = F.col("type") == "train"
    observed = is_history & (F.col("cell_hour") == F.col("hour_index"))
    earliest, latest, total = (F.when(observed, F.col(name)) for name in kept[2:])
    is_active = F.when(is_history, observed.cast("int"))
    if future_flag == "active":
        cell_time = clock.index_time(F.col("cell_hour"))
        earliest = F.when(is_history, earliest).otherwise(cell_time)
        latest = F.when(is_history, latest).otherwise(cell_time)
        total = F.when(is_history, total).otherwise(F.lit(-1).cast("bigint"))
        is_active = F.coalesce(is_active, F.lit(1))
    slotted = cells.select(
        "device",
        (F.col("cell_hour") - F.col("anchor_hour")).cast("int").alias("hour_slot"),
        earliest.alias("earliest_activation"),
        latest.alias("latest_activation"),
        total.alias("total_activations"),
        is_active.alias("is_active"),
        "type",
    )
    return _with_calendar(slotted)


def _with_calendar(slotted: DataFrame) -> DataFrame:
    slot = F.col("hour_slot")
    return slotted.withColumns(
        {
            "hour_of_day": clock.slot_hour_of_day(slot),
            "hour_of_week": clock.slot_hour_of_week(slot),
            "day_num": clock.slot_day(slot),
            "week_num": clock.slot_week(slot),
            "day_of_week": clock.slot_day_of_week(slot),
        }
    ).select(*PANEL_COLUMNS)


def hourly_panel(
    log: DataFrame,
    anchor: Column | str | None = None,
    grid: str = "span",
    partitions: int | None = None,
) -> DataFrame:
    """The history panel: every device at every hour of the grid."""
    rollup = hourly_rollup(log)
    return panel_from_rollup(rollup, rollup_extent(rollup), anchor, grid, partitions=partitions)


def modelling_panel(
    log: DataFrame,
    start: Column | str | dt.datetime,
    grid: str = "span",
    cut_history: bool = True,
    future_flag: str = "null",
    partitions: int | None = None,
    devices: str = "log",
) -> DataFrame:
    """History and the 24 hours from ``start`` for every device, from one pass over the log.

    Equal to ``append(hourly_panel(...), future_panel(...))``, without the second scan for
    the devices and with the partitioning by device kept. ``cut_history=False`` keeps
    events at or after ``start``, so that history and future may share slots.

    Devices come from the whole log, so the time is no filter of the scan.
    ``devices='history'`` leaves out devices first seen at or after ``start``; then it is.
    """
    if devices not in ("log", "history"):
        raise ValueError(f"unknown devices {devices!r}: use 'log' or 'history'")
    if cut_history and devices == "history":
        log = history_before(log, start)
    cut = start if cut_history else None
    rollup = hourly_rollup(log, cut)
    return panel_from_rollup(
        rollup,
        rollup_extent(rollup, cut),
        grid=grid,
        start=start,
        future_flag=future_flag,
        partitions=partitions,
        cut_history=cut_history,
    )


def future_hours(spark: SparkSession, start: Column | str | dt.datetime) -> DataFrame:
    """The 24 hours from ``start``, rounded up to whole hours."""
    first = first_future_hour(start)
    offsets = F.sequence(F.lit(0), F.lit(HORIZON_HOURS - 1))
    steps = spark.range(1).select(first.alias("first"), F.explode(offsets).alias("step"))
    return steps.select(F.timestamp_add("HOUR", F.col("step"), F.col("first")).alias("time"))


def future_panel(
    device_list: DataFrame,
    start: Column | str | dt.datetime,
    anchor: Column | str,
    future_flag: str = "null",
) -> DataFrame:
    """24 rows per device of ``device_list``, on the calendar of the history's anchor."""
    first = clock.hour_slot(first_future_hour(start), clock.as_day(anchor))
    slots = F.sequence(first, first + HORIZON_HOURS - 1)
    active = future_flag == "active"
    cells = device_list.select("device", F.explode(slots).alias("hour_slot"))
    time = clock.slot_time(F.col("hour_slot"), clock.as_day(anchor))
    no_time = F.lit(None).cast("timestamp_ntz")
    return _with_calendar(
        cells.select(
            "device",
            "hour_slot",
            (time if active else no_time).alias("earliest_activation"),
            (time if active else no_time).alias("latest_activation"),
            F.lit(-1 if active else None).cast("bigint").alias("total_activations"),
            F.lit(1 if active else None).cast("int").alias("is_active"),
            F.lit("predict").alias("type"),
        )
    )


def append(history: DataFrame, future: DataFrame) -> DataFrame:
    return history.unionByName(future)
