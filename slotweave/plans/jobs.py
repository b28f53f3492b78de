"""The three batch jobs, for spark-submit or ``python -m slotweave.plans.jobs``.

    forest   TIME LOG OUT [--save-model DIR] [--report DIR]   train a forest, predict 24 hours
    forecast TIME LOG OUT                                     one additive forecast per device
    score    REQUEST LOG MODEL OUT [--from-state]             predict with a stored forest

The raw log is read once: its rollup is written to the shared folder, and span, anchor and
features come from that table.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotweave.functions import clock
from slotweave.operators import forecast as additive, forest, metrics, model_store, splits
from slotweave.operators.day_features import day_rollup, device_days, features_from_days
from slotweave.operators.device_state import DeviceState, features_from_state, load_state, save_state, state_from_rollup
from slotweave.operators.overlap_features import features_from_overlap, overlap_days
from slotweave.operators.panel import first_future_hour, grid_partitions, hourly_rollup, panel_from_rollup, rollup_extent
from slotweave.operators.rates import model_features
from slotweave.session import device_partitions, run_scope, write_stage
from slotweave.sources.activations import quarantine, read_log, request_time
from slotweave.sources.sinks import join_parts, write_csv, write_json, write_json_array


@dataclass(frozen=True)
class Options:
    """How the modelling table is built; the defaults leave no future in the past."""

    grid: str = "span"
    cut_history: bool = True
    future_flag: str = "null"
    rates: str = "before_now"


#: History and hours to predict may share slots, and the latest cell is treated apart.
COMPAT = Options(grid="compat", cut_history=False, future_flag="active", rates="latest_only")


@dataclass(frozen=True)
class Prepared:
    features: DataFrame
    anchor: Column
    rollup: DataFrame | None = None
    """The device days behind the features, where they were made from days."""


def prepare(log: DataFrame, start: str, options: Options = Options(), device_rate: bool = True) -> Prepared:
    """Features of history and future rows, lazily, over a rollup written once."""
    if options == Options():
        rollup = write_stage(day_rollup(log, start), "rollup")
        extent = rollup_extent(rollup)
        features = features_from_days(
            device_days(rollup, extent, start, partitions=_partitions(rollup, extent)),
            device_day_rates=False,
            fleet_day_rates=False,
            device_rate=device_rate,
        )
        return Prepared(features, _anchor(extent, start), rollup)
    if options == COMPAT and not device_rate:
        rollup = write_stage(day_rollup(log), "rollup")
        extent = rollup_extent(rollup)
        days = overlap_days(rollup, extent, start, _partitions(rollup, extent))
        return Prepared(features_from_overlap(days, day_rates=False), _anchor(extent, start))
    # The other forms need the cells themselves.
    cut = start if options.cut_history else None
    rollup = write_stage(hourly_rollup(log, cut), "rollup")
    extent = rollup_extent(rollup, cut)
    panel = panel_from_rollup(
        rollup,
        extent,
        grid=options.grid,
        start=start,
        future_flag=options.future_flag,
        partitions=_partitions(rollup, extent),
        cut_history=options.cut_history,
    )
    features = model_features(
        panel,
        rates=options.rates,
        device_day_rates=False,
        fleet_day_rates=False,
        device_rate=device_rate,
    )
    features = features.drop("earliest_activation", "latest_activation", "total_activations")
    return Prepared(features, _anchor(extent, start))


def _partitions(rollup: DataFrame, extent: Column) -> int:
    """As many partitions as the grid needs, and no fewer than the session's."""
    return max(grid_partitions(rollup, extent), device_partitions(rollup.sparkSession))


def _anchor(extent: Column, start: str) -> Column:
    """The first day of the history, or the day to predict if there is none."""
    return F.coalesce(F.to_date(extent.getField("first")), F.to_date(first_future_hour(start)))


@dataclass(frozen=True)
class ForestRun:
    model: forest.Forest
    predictions: DataFrame
    scored: DataFrame
    """Labelled training and held-out rows with their predictions, told apart by ``fold``."""
    rollup: DataFrame | None = None
    """The device days of the history, for ``state_after``."""


def _prediction_table(predicted: DataFrame, anchor: Column, probability: bool = False) -> DataFrame:
    more = ["activation_probability"] if probability else []
    return predicted.select(
        "activation_predicted", "device", clock.slot_label(F.col("hour_slot"), anchor).alias("time"), *more
    )


def run_forest(
    log: DataFrame,
    start: str,
    settings: forest.ForestSettings = forest.ForestSettings(),
    options: Options = Options(),
    holdout_share: float = 0.2,
    holdout_rows: int = 0,
    plan: dict[str, splits.Split] | None = None,
    x_columns: Sequence[str] = splits.MODEL_FEATURES,
    y_column: str = splits.LABEL,
    probability: bool = False,
    store: str | None = None,
) -> ForestRun:
    """Train on the history and predict the 24 hours from ``start`` for every device.

    ``plan`` replaces the default splits ``train`` and ``predict``; it may narrow slots,
    devices and hold-out. ``x_columns`` and ``y_column`` are the model's columns. With
    ``store``, a folder, a model trained before on the same rows and settings is read from
    there, and a new one is added.
    """
    ready = prepare(log, start, options)
    table = write_stage(ready.features, "features", partition_by="type")
    plan = splits.default_splits(holdout_share, holdout_rows) | (plan or {})
    labelled = labelled_rows(table, plan["train"])
    to_predict = splits.select_rows(table, plan["predict"])
    training = labelled.where(F.col("fold") != "test")

    def train() -> forest.Forest:
        return forest.train_forest(training, settings, x_columns, y_column)

    if store is None:
        model = train()
    else:
        asked = asdict(settings) | {"columns": list(x_columns), "label": y_column, "spark": table.sparkSession.version}
        name = model_store.fingerprint(forest.training_rows(training, settings, x_columns, y_column), asked)
        model = model_store.find_or_train(table.sparkSession, store, name, train)
    return ForestRun(
        model=model,
        predictions=_prediction_table(forest.predict(model, to_predict), ready.anchor, probability),
        scored=forest.predict(model, labelled),
        rollup=ready.rollup,
    )


def state_after(run: ForestRun, start: str) -> DeviceState:
    """The state of the days before the one to predict, from the rollup that the run has written."""
    if run.rollup is None:
        raise ValueError("a state needs the default options: it is made from days, not from cells")
    day = run.rollup.sparkSession.range(1).select(F.to_date(first_future_hour(start)).alias("day")).first()["day"]
    return state_from_rollup(run.rollup, day)


def labelled_rows(table: DataFrame, split: splits.Split) -> DataFrame:
    """The rows of a training split with their fold."""
    return splits.with_fold(splits.select_rows(table, split), split)


def fold_report(run: ForestRun) -> DataFrame:
    """Per device: AUC, accuracy and confusion counts on training and held-out rows.

    The scored rows are written once, so that the trees are not walked for each measure.
    """
    needed = ["device", "fold", splits.LABEL, "activation_probability", "activation_predicted"]
    scored = write_stage(run.scored.select(*needed), "scored")
    names = ("activation_probability", "activation_predicted", splits.LABEL)
    return metrics.device_report(scored, *names, keys=["device", "fold"])


def run_forecast(log: DataFrame, start: str, options: Options = Options()) -> DataFrame:
    """``time, device, activation_predicted1`` from one additive model per device."""
    ready = prepare(log, start, options, device_rate=False)
    labels = additive.forecast_labels(additive.forecast(ready.features))
    return labels.select(
        clock.slot_label(F.col("hour_slot"), ready.anchor).alias("time"), "device", "activation_predicted1"
    )


def run_scoring(log: DataFrame, start: str, model: forest.Forest, options: Options = Options()) -> DataFrame:
    """Predictions of a stored model, ordered by device and time."""
    ready = prepare(log, start, options, device_rate=forest.needs_device_rate(model))
    to_predict = splits.select_rows(ready.features, splits.default_splits()["predict"])
    predicted = forest.predict(model, to_predict)
    return _prediction_table(predicted, ready.anchor).orderBy("device", "time")


def run_scoring_from_state(log: DataFrame, start: str, model: forest.Forest, state: DeviceState) -> DataFrame:
    """As ``run_scoring`` with default options; of the log, only events since the state are read."""
    features, anchor = features_from_state(state, log, start, forest.needs_device_rate(model))
    return _prediction_table(forest.predict(model, features), anchor).orderBy("device", "time")


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="slotweave", description="Hourly activation prediction.")
    jobs = parser.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("forest")
    series = jobs.add_parser("forecast")
    score = jobs.add_parser("score")
    for job in (train, series):
        job.add_argument("time", help="prediction time, yyyy-MM-dd HH:mm:ss")
        job.add_argument("log", help="activation log, CSV or Parquet")
        job.add_argument("out", help="folder for the predictions (CSV)")
    train.add_argument("--trees", type=int, default=forest.ForestSettings.trees)
    train.add_argument("--depth", type=int, default=forest.ForestSettings.depth)
    train.add_argument("--features-per-split", type=int, default=forest.ForestSettings.features_per_split)
    train.add_argument("--encoding", default=forest.ForestSettings.encoding, choices=["rate", "onehot"])
    train.add_argument("--columns", nargs="+", default=splits.MODEL_FEATURES, help="columns of the model")
    train.add_argument("--from-slot", type=int, default=splits.FIRST_FULL_SLOT, help="first hour slot to train on")
    train.add_argument("--to-slot", type=int, help="last hour slot to train on")
    train.add_argument("--devices", nargs="+", help="devices to train on (default: all)")
    train.add_argument("--probability", action="store_true", help="write the probability as well")
    train.add_argument("--holdout-share", type=float, default=0.2)
    train.add_argument("--holdout-rows", type=int, default=0)
    train.add_argument("--model-store", metavar="DIR", help="reuse a model trained on the same rows and settings, or add it")
    train.add_argument("--save-model", metavar="DIR")
    train.add_argument("--report", metavar="DIR")
    score.add_argument("request", help="tab-separated file with time_for_prediction")
    score.add_argument("log", help="activation log, CSV or Parquet")
    score.add_argument("model", help="folder of a saved model")
    score.add_argument("out", help="folder for the predictions (JSON lines)")
    score.add_argument("--json-array", action="store_true", help="one JSON array in parts instead of a record per line")
    score.add_argument("--from-state", action="store_true", help="use the state stored with the model; only later events are read")
    for job in (train, series, score):
        job.add_argument("--grid", default="span", choices=["span", "compat"])
        job.add_argument("--keep-later-events", action="store_true")
        job.add_argument("--future-flag", default="null", choices=["null", "active"])
        job.add_argument("--rates", default="before_now", choices=["before_now", "latest_only"])
        job.add_argument("--single-file", action="store_true", help="one output file, for small results")
        job.add_argument("--log-kind", choices=["csv", "parquet"], help="default: by the path's ending")
        job.add_argument("--source-zone", default="UTC", help="zone of the log's times if they are instants")
        job.add_argument("--rejects", metavar="DIR", help="set unreadable records of a CSV log aside there instead of failing")
        job.add_argument("--partitions", type=int, help="shuffle partitions; devices times hours of the span / 10 million is a start")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName(f"slotweave-{args.job}").getOrCreate()
    with run_scope(spark):
        run_command(argv, spark)


def run_command(argv: Sequence[str] | None, spark: SparkSession) -> None:
    """One job; its stages stay in the shared folder."""
    args = _arguments(argv)
    if args.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", args.partitions)
    if args.rejects:
        log, rejects = quarantine(spark, args.log)
        write_csv(rejects, args.rejects, args.single_file)
    else:
        log = read_log(spark, args.log, args.log_kind, args.source_zone)
    options = Options(args.grid, not args.keep_later_events, args.future_flag, args.rates)
    if args.job == "forest":
        settings = forest.ForestSettings(args.trees, args.depth, args.features_per_split, encoding=args.encoding)
        train = splits.default_splits(args.holdout_share, args.holdout_rows)["train"]
        train = replace(train, start_hour=args.from_slot, end_hour=args.to_slot, devices=args.devices or "all")
        run = run_forest(
            log,
            args.time,
            settings,
            options,
            plan={"train": train},
            x_columns=args.columns,
            probability=args.probability,
            store=args.model_store,
        )
        if args.save_model:
            forest.save_model(run.model, args.save_model)
            if run.rollup is not None:
                save_state(state_after(run, args.time), f"{args.save_model}/state")
        write_csv(run.predictions, args.out, args.single_file)
        if args.report:
            write_csv(fold_report(run), args.report)
    elif args.job == "forecast":
        write_csv(run_forecast(log, args.time, options), args.out, args.single_file)
    else:
        model = forest.load_model(args.model)
        time = request_time(spark, args.request)
        if args.from_state:
            scored = run_scoring_from_state(log, time, model, load_state(spark, f"{args.model}/state"))
        else:
            scored = run_scoring(log, time, model, options)
        if args.json_array:
            write_json_array(scored, args.out, ["device", "time"])
            if args.single_file:
                join_parts(spark, args.out, f"{args.out}/predictions.json")
        else:
            write_json(scored, args.out, args.single_file, ["device", "time"])


if __name__ == "__main__":
    main()
