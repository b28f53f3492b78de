"""Row selection for training and prediction, and repeatable hold-outs."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from slotweave.functions.clock import HOURS_PER_WEEK
from slotweave.operators.selection import nth_smallest, up_to
from slotweave.session import write_stage

# Slots of the first week have no lag of a week.
FIRST_FULL_SLOT = HOURS_PER_WEEK

# Bits of a draw that put the rows of a hold-out in order; whole hex digits.
DRAW_BITS = 60

# Fixed names: columns of the model's table.
LABEL = "is_active"
MODEL_FEATURES = [
    "device",
    "hour_of_day",
    "hour_of_week",
    "day_of_week",
    "is_active_yesterday",
    "is_active_last_week",
    "daily_activation_rate",
    "weekly_activation_rate",
]


@dataclass(frozen=True)
class Split:
    """One named selection of the modelling table.

    ``devices`` is ``'all'``, a list of names, or a DataFrame with a ``device`` column for
    a long list. A hold-out is given as a share or as a number of rows, not both.
    """

    name: str
    start_hour: int | Column | None = 0
    end_hour: int | Column | None = None
    devices: str | Sequence[str] | DataFrame = "all"
    row_type: str | None = None
    holdout_share: float = 0.0
    holdout_rows: int = 0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.holdout_share and self.holdout_rows:
            raise ValueError("give holdout_share or holdout_rows, not both")
        if not 0.0 <= self.holdout_share <= 1.0:
            raise ValueError("holdout_share lies between 0 and 1")


def default_splits(holdout_share: float = 0.2, holdout_rows: int = 0) -> dict[str, Split]:
    """Training rows from the second week on, and all rows to predict."""
    if holdout_rows:
        holdout_share = 0.0
    return {
        "train": Split(
            "train",
            start_hour=FIRST_FULL_SLOT,
            row_type="train",
            holdout_share=holdout_share,
            holdout_rows=holdout_rows,
        ),
        "predict": Split("predict", row_type="predict"),
    }


def _condition(split: Split) -> Column:
    """Slot range (both ends included), listed devices and row type."""
    tests = [F.lit(True)]
    if split.start_hour is not None:
        tests.append(F.col("hour_slot") >= split.start_hour)
    if split.end_hour is not None:
        tests.append(F.col("hour_slot") <= split.end_hour)
    if not isinstance(split.devices, DataFrame) and split.devices != "all":
        tests.append(F.col("device").isin(list(split.devices)))
    if split.row_type is not None:
        tests.append(F.col("type") == split.row_type)
    return functools.reduce(Column.__and__, tests)


def select_rows(table: DataFrame, split: Split) -> DataFrame:
    """The rows of a split."""
    rows = table.where(_condition(split))
    if isinstance(split.devices, DataFrame):
        rows = rows.join(split.devices.select("device"), "device", "left_semi")
    return rows


def complete_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.na.drop(subset=list(columns))


def draw(seed: int, keys: Sequence[str] = ("device", "hour_slot", "type")) -> Column:
    """A hex text that orders rows at random, fixed by the row's key and the seed alone.

    It does not depend on the partitioning, so a repeated or recomputed task draws the
    same rows, and any engine with MD5 can repeat the split.
    """
    return F.md5(F.concat_ws("|", *[F.col(key).cast("string") for key in keys], F.lit(str(seed))))


def _fold_by_key(split: Split, columns: Sequence[str]) -> Column:
    """The fold of a split that holds out a share or nothing."""
    if not split.holdout_share:
        return F.lit("all")
    if split.holdout_share == 1.0:
        return F.lit("test")
    cut = format(int(split.holdout_share * 16**8), "08x")
    keys = [key for key in ("device", "hour_slot", "type") if key in columns]
    return F.when(F.substring(draw(split.seed, keys), 1, 8) < cut, "test").otherwise("train")


def _fold_by_rows(rows: DataFrame, split: Split) -> DataFrame:
    """The fold of a split that holds out a number of rows: those with the smallest draws.

    The rows are written once with their draws, so that what they are computed from runs once,
    and the cut is found on that column. Repeats of a key draw alike; their place in the
    written table tells them apart at the cut.
    """
    keys = [key for key in ("device", "hour_slot", "type") if key in rows.columns]
    number = F.conv(F.substring(draw(split.seed, keys), 1, DRAW_BITS // 4), 16, 10).cast("bigint")
    drawn = write_stage(rows.withColumns({"_draw": number, "_place": F.monotonically_increasing_id()}), "drawn")
    cut = nth_smallest(drawn, {"_draw": DRAW_BITS, "_place": 63}, split.holdout_rows)
    fold = F.lit("test") if cut is None else F.when(up_to(cut), "test").otherwise("train")
    return drawn.withColumn("fold", fold).drop("_draw", "_place")


def with_fold(rows: DataFrame, split: Split) -> DataFrame:
    """Adds ``fold``: ``train`` or ``test``, or ``all`` where the split holds nothing out."""
    if split.holdout_rows:
        return _fold_by_rows(rows, split)
    return rows.withColumn("fold", _fold_by_key(split, rows.columns))


def _wanted(x_columns: Sequence[str], y_column: str) -> list[str]:
    return list(dict.fromkeys(["device", "hour_slot", *x_columns, y_column]))


def split_rows(
    table: DataFrame,
    split: Split,
    x_columns: Sequence[str] = MODEL_FEATURES,
    y_column: str = LABEL,
) -> DataFrame:
    """Key, features, label, ``split`` and ``fold`` of the rows of one split."""
    rows = with_fold(select_rows(table, split), split)
    return rows.select(*_wanted(x_columns, y_column), F.lit(split.name).alias("split"), "fold")


def split_table(
    table: DataFrame,
    splits: dict[str, Split],
    x_columns: Sequence[str] = MODEL_FEATURES,
    y_column: str = LABEL,
) -> DataFrame:
    """All splits in one table, told apart by ``split``; a row can be in several.

    Splits that a row's own columns decide are found in one pass over the table. A table
    of devices or a hold-out by rows needs a pass for each split.
    """
    plans = list(splits.values())
    if any(plan.holdout_rows or isinstance(plan.devices, DataFrame) for plan in plans):
        return functools.reduce(DataFrame.unionByName, [split_rows(table, plan, x_columns, y_column) for plan in plans])
    members = [
        F.when(_condition(plan), F.struct(F.lit(plan.name).alias("split"), _fold_by_key(plan, table.columns).alias("fold")))
        for plan in plans
    ]
    found = F.explode(F.array_compact(F.array(*members)))
    wanted = _wanted(x_columns, y_column)
    return table.select(*wanted, found.alias("member")).select(*wanted, "member.split", "member.fold")
