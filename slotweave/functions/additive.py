"""The arithmetic of additive models: sums over the rows of a device, and the fit from them.

The sums of two parts of a history add up to those of the whole, so no task needs all rows of
a device. Runs inside Spark tasks. It needs numpy and Arrow only, so it can be sent to the
executors by value and they need no copy of this package.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The published defaults of the additive model.
DAILY_ORDER = 4
WEEKLY_ORDER = 3
LEVEL_SCALE = 5.0
COEFFICIENT_SCALE = 10.0
NOISE_SCALE = 0.5

# Far more than the rounds it takes; running out of them is an error.
NOISE_ROUNDS = 10_000
LEAST_VARIANCE = 1e-9


def seasonal_terms(slots: np.ndarray, period_hours: int, order: int) -> np.ndarray:
    """Sine and cosine columns of the first ``order`` harmonics of the period."""
    angle = 2.0 * np.pi * np.outer(slots / period_hours, np.arange(1, order + 1))
    return np.hstack([np.sin(angle), np.cos(angle)])


def raw_design(slots: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Level, seasonal terms and the regressors as they are."""
    ones = np.ones((len(slots), 1))
    return np.hstack([ones, seasonal_terms(slots, 24, DAILY_ORDER), seasonal_terms(slots, 7 * 24, WEEKLY_ORDER), inputs])


def row_sums(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The sums of some rows as one flat array: products of (design, target), then least, largest and
    numbers of values other than 0 and 1 per column of (design, target)."""
    both = np.column_stack([design, target])
    ends = [both.min(axis=0), both.max(axis=0), ((both != 0.0) & (both != 1.0)).sum(axis=0)]
    return np.concatenate([(both.T @ both).ravel(), *ends])


def add_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sums of the rows of both."""
    total = left + right
    width = _width(left)
    low, high = slice(width**2, width**2 + width), slice(width**2 + width, width**2 + 2 * width)
    total[low], total[high] = np.minimum(left[low], right[low]), np.maximum(left[high], right[high])
    return total


def _width(sums: np.ndarray) -> int:
    """Columns of (design, target): the sums are width * (width + 3) numbers."""
    return round((np.sqrt(9.0 + 4.0 * len(sums)) - 3.0) / 2.0)


def scaling(sums: np.ndarray, regressors: int) -> np.ndarray:
    """The matrix that takes a raw design to the model's: regressors centred and scaled by the training
    rows, 0/1 and constant columns as they are."""
    width = _width(sums)
    products = sums[: width**2].reshape(width, width)
    low, high, other = sums[width**2 :].reshape(3, width)
    count, matrix = products[0, 0], np.eye(width - 1)
    for j in range(width - 1 - regressors, width - 1):
        if other[j] and low[j] != high[j]:
            mean = products[0, j] / count
            spread = np.sqrt((products[j, j] - count * mean**2) / (count - 1.0))
            matrix[j, j], matrix[0, j] = 1.0 / spread, -mean / spread
    return matrix


def fit_sums(sums: np.ndarray, regressors: int) -> np.ndarray | None:
    """Coefficients for the raw design, or None where the target never changes."""
    width = _width(sums)
    low, high = sums[width**2 : width**2 + width], sums[width**2 + width : width**2 + 2 * width]
    if sums[0] < 2 or low[-1] == high[-1]:
        return None
    matrix = scaling(sums, regressors)
    weights = solve_additive(*model_equations(sums, matrix))
    return matrix @ weights


def model_equations(sums: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Gram matrix and moment of the model's design, the target's sum of squares and the rows."""
    width = _width(sums)
    products = sums[: width**2].reshape(width, width)
    gram, moment = matrix.T @ products[:-1, :-1] @ matrix, matrix.T @ products[:-1, -1]
    return gram, moment, float(products[-1, -1]), float(products[0, 0])


def _prior(size: int) -> np.ndarray:
    prior = np.full(size, COEFFICIENT_SCALE**-2)
    prior[0] = LEVEL_SCALE**-2
    return prior


def _noise(squares: float, count: float) -> float:
    """The variance v at v^2 / NOISE_SCALE^2 + count v = squares, in the form without a difference of near equals."""
    return max(2.0 * squares / (count + np.sqrt(count**2 + 4.0 * NOISE_SCALE**-2 * squares)), LEAST_VARIANCE)


def _squares(gram: np.ndarray, moment: np.ndarray, total: float, weights: np.ndarray) -> float:
    return max(total - 2.0 * float(weights @ moment) + float(weights @ gram @ weights), 0.0)


def solve_additive(gram: np.ndarray, moment: np.ndarray, total: float, count: float) -> np.ndarray:
    """Coefficients (the first column is the level) at the posterior mode.

    For a fixed noise the mode is a ridge solution; for fixed coefficients the noise follows
    from the squares that are left. Rounds of both go on until the noise has settled.
    """
    prior = _prior(len(moment))
    variance = max(total / count - (moment[0] / count) ** 2, LEAST_VARIANCE)
    for _ in range(NOISE_ROUNDS):
        weights = np.linalg.solve(gram + np.diag(variance * prior), moment)
        settled = _noise(_squares(gram, moment, total, weights), count)
        if abs(settled - variance) <= 1e-10 * variance:
            return weights
        variance = settled
    raise ArithmeticError("the noise of the additive model did not settle")


def fit_additive(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    """As ``solve_additive``, from the rows; the first column of the design is the level."""
    return solve_additive(design.T @ design, design.T @ target, float(target @ target), len(target))


def largest_residual(gram: np.ndarray, moment: np.ndarray, total: float, count: float, weights: np.ndarray) -> float:
    """How far ``weights`` are from solving the ridge equations at the noise they imply, relative to their size."""
    variance = _noise(_squares(gram, moment, total, weights), count)
    left = moment - gram @ weights - variance * _prior(len(moment)) * weights
    return float(np.abs(left).max() / max(1.0, float(np.abs(moment).max())))


def _values(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False).astype(float)


def design_of(rows: pa.RecordBatch, regressors: list[str]) -> np.ndarray:
    return raw_design(_values(rows, "hour_slot"), np.column_stack([_values(rows, name) for name in regressors]))


def batch_sums(rows: pa.RecordBatch, regressors: list[str]) -> dict[str, np.ndarray]:
    """The sums of each device's labelled rows."""
    target = _values(rows, "is_active")
    usable = np.flatnonzero((rows.column("type").to_numpy(zero_copy_only=False) == "train") & ~np.isnan(target))
    if not len(usable):
        return {}
    rows, target = rows.take(pa.array(usable)), target[usable]
    design = design_of(rows, regressors)
    codes = rows.column("device").dictionary_encode()
    code = codes.indices.to_numpy()
    return {
        device: row_sums(design[code == at], target[code == at]) for at, device in enumerate(codes.dictionary.to_pylist())
    }


def partial_sums(batches, regressors: list[str], held: int):
    """(device, sums) rows for the rows of one task; at most ``held`` devices are kept at a time."""
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        for device, sums in batch_sums(batch, regressors).items():
            if device not in kept and len(kept) >= held:
                yield _sums_batch(kept)
                kept = {}
            kept[device] = add_sums(kept[device], sums) if device in kept else sums
    if kept:
        yield _sums_batch(kept)


def _lists(values: np.ndarray, present: np.ndarray | None = None) -> pa.ListArray:
    """A list per row of a table of numbers, without a Python object per number; null where not ``present``."""
    rows, width = values.shape
    kept = np.ones(rows, dtype=bool) if present is None else present
    offsets = np.append(0, np.cumsum(np.where(kept, width, 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[kept].ravel()), mask=pa.array(~kept))


def _table(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The numbers of lists of equal length, a row per list."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums_batch(kept: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(list(kept), pa.string()), _lists(np.array(list(kept.values())))]
    return pa.RecordBatch.from_arrays(columns, ["device", "sums"])


def added_sums(rows: pa.Table) -> pa.Table:
    """One row of sums for the rows of one device."""
    total = None
    for sums in _table(rows.column("sums")):
        total = sums if total is None else add_sums(total, sums)
    return pa.table({"device": rows.column("device").slice(0, 1), "sums": _lists(total[None, :])})


# Devices whose results are gathered before they are sent on.
FITTED_ROWS = 1_000


def fitted(batches, regressors: int):
    """(device, weights, level, residual) from (device, sums); weights are null where the target never changes."""
    for whole in batches:
        for start in range(0, whole.num_rows, FITTED_ROWS):
            yield _fitted_batch(whole.slice(start, FITTED_ROWS), regressors)


def fitted_device(rows: pa.Table, regressors: int) -> pa.Table:
    """As ``fitted``, from the rows of sums of one device."""
    return pa.Table.from_batches(fitted(added_sums(rows).to_batches(), regressors))


def _fitted_batch(batch: pa.RecordBatch, regressors: int) -> pa.RecordBatch:
    every = _table(batch.column("sums"))
    width = _width(every[0])
    weights, residuals = np.zeros((len(every), width - 1)), np.zeros(len(every))
    present = np.zeros(len(every), dtype=bool)
    for at, sums in enumerate(every):
        found = fit_sums(sums, regressors)
        if found is not None:
            matrix = scaling(sums, regressors)
            weights[at], present[at] = found, True
            residuals[at] = largest_residual(*model_equations(sums, matrix), np.linalg.solve(matrix, found))
    columns = [batch.column("device"), _lists(weights, present), pa.array(every[:, width - 1] / every[:, 0]), pa.array(residuals)]
    return pa.RecordBatch.from_arrays(columns, ["device", "weights", "level", "residual"])


def predicted(batches, regressors: list[str]):
    """(device, hour_slot, yhat) from rows to predict with their device's weights and level."""
    for batch in batches:
        design, level = design_of(batch, regressors), _values(batch, "level")
        weights = batch.column("weights")
        known = weights.is_valid().to_numpy(zero_copy_only=False)
        flat = np.full(design.shape, np.nan)
        flat[known] = weights.flatten().to_numpy(zero_copy_only=False).reshape(-1, design.shape[1])
        yhat = np.where(known, (design * flat).sum(axis=1), level)
        # A device without any labelled row has no forecast.
        columns = [batch.column("device"), batch.column("hour_slot"), pa.array(yhat, mask=np.isnan(yhat))]
        yield pa.RecordBatch.from_arrays(columns, ["device", "hour_slot", "yhat"])
