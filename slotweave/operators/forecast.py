"""One additive forecast per device, fitted from sums over its rows.

The model follows the published additive form of Taylor and Letham, "Forecasting at
Scale" (2017), with a constant trend: a level, daily and weekly Fourier terms and extra
regressors, all with normal priors, set to their maximum a posteriori values. For this
form that is a ridge regression with a penalty tied to the noise.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from slotweave.functions import additive
from slotweave.functions.scalars import clip_below, to_label

# Executors get the fitting functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(additive)

REGRESSORS = [
    "hour_of_day",
    "hour_of_week",
    "day_num",
    "week_num",
    "is_active_last_week",
    "is_active_yesterday",
    "daily_activation_rate",
    "weekly_activation_rate",
]

LABEL_CUT = 0.4

SUMS = "device string, sums array<double>"

# A task holds the sums of so many devices (5 KB each) before it sends them on. The feature table
# comes device by device, so few are needed.
DEVICES_HELD = 500


def forecast_sums(features: DataFrame, regressors: Sequence[str] = REGRESSORS) -> DataFrame:
    """``device, sums``: all that a fit needs of the labelled rows.

    Every task adds up its own rows; a device sends one row of some 600 numbers per task, however
    long its history is. Sums of other days are added by ``add_days``.
    """
    return add_days(_sums_by_task(features, regressors))


def _sums_by_task(features: DataFrame, regressors: Sequence[str]) -> DataFrame:
    sums, names = additive.partial_sums, list(regressors)
    needed = features.select("device", "hour_slot", "type", "is_active", *names)
    return needed.mapInArrow(lambda rows: sums(rows, names, DEVICES_HELD), SUMS)


def add_days(sums: DataFrame, *more: DataFrame) -> DataFrame:
    """The sums of all rows behind the given ones, one row per device."""
    return functools.reduce(DataFrame.unionByName, more, sums).groupBy("device").applyInArrow(additive.added_sums, SUMS)


def coefficients(sums: DataFrame, regressors: Sequence[str] = REGRESSORS) -> DataFrame:
    """``device, weights, level, residual``: the fit of each device, and how exact it is.

    The sums of a device may come in several rows. A worker sees one device at a time: batches of sums
    would hold more the more devices there are.
    """
    fit, width = additive.fitted_device, len(regressors)
    fits = "device string, weights array<double>, level double, residual double"
    return sums.groupBy("device").applyInArrow(lambda rows: fit(rows, width), fits)


def forecast(features: DataFrame, regressors: Sequence[str] = REGRESSORS, sums: DataFrame | None = None) -> DataFrame:
    """``device, hour_slot, yhat`` for the rows to predict; ``yhat`` is clipped at 0.

    ``sums`` are those of the history, if they are known; then only the rows to predict are read.
    """
    apply, names = additive.predicted, list(regressors)
    sums = _sums_by_task(features, regressors) if sums is None else sums
    rows = features.where(F.col("type") == "predict").select("device", "hour_slot", *names)
    with_fit = rows.join(coefficients(sums, regressors), "device", "left")
    raw = with_fit.mapInArrow(lambda batches: apply(batches, names), "device string, hour_slot int, yhat double")
    return raw.withColumn("yhat", clip_below(F.col("yhat"), 0.0))


def fit_residuals(features: DataFrame, regressors: Sequence[str] = REGRESSORS) -> DataFrame:
    """``device, residual``: how far each device's coefficients are from their equations."""
    found = coefficients(_sums_by_task(features, regressors), regressors).select("device", "residual")
    every = features.select("device").distinct().join(found, "device", "left")
    return every.select("device", F.coalesce("residual", F.lit(0.0)).alias("residual"))


def forecast_labels(forecasts: DataFrame, cut: float = LABEL_CUT) -> DataFrame:
    return forecasts.withColumn("activation_predicted1", to_label(F.col("yhat"), cut))
