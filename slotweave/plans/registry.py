"""The registered queries: every operator over the whole ``events`` table.

Each entry takes (spark, folder of Parquet tables) and returns a DataFrame. The SQL they
are compared with is in ``slotweave.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotweave.functions import clock, scalars
from slotweave.operators import day_features, device_state, forecast as additive, forest, metrics, overlap_features, panel as panels, rates, splits
from slotweave.operators.dictionary import numbered
from slotweave.plans import jobs
from slotweave.session import scratch_path, shared_folder
from slotweave.sources import activations, sinks

# Prediction times: one at the end of the log, one inside it.
AT_END = "2024-01-30 23:59:59"
INSIDE = "2024-01-15 13:59:59"

SCORE_CUT = 0.1

# Doubles are compared after rounding to this many places.
DIGITS = 9

FOREST = forest.ForestSettings()

Query = Callable[[SparkSession, str], DataFrame]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return activations.log_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    return panels.hourly_panel(_log(spark, folder))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, DIGITS) for name in names})


def devices(spark: SparkSession, folder: str) -> DataFrame:
    found = panels.devices(_log(spark, folder))
    return found.select("device", scalars.device_number(F.col("device")).alias("device_number"))


def unusable_counts(spark: SparkSession, folder: str) -> DataFrame:
    return activations.unusable_counts(_log(spark, folder))


def event_clock(spark: SparkSession, folder: str) -> DataFrame:
    as_text = _log(spark, folder).withColumn("time", F.col("time").cast("string"))
    return panels.event_clock(activations.parse_time(as_text))


def parse_rejects(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    text = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    parsed = activations.parse_time_lenient(events.select("event_type", text.alias("time")))
    return parsed.groupBy("event_type").agg(
        F.count("time").alias("parsed"),
        F.count_if("time_rejected").alias("rejected"),
        F.max("time").alias("latest"),
    )


def hourly_rollup(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    first_hour = clock.anchor_hour(panels.first_day(log))
    return panels.hourly_rollup(log).select(
        "device",
        (F.col("hour_index") - first_hour).cast("int").alias("hour_slot"),
        "earliest_activation",
        "latest_activation",
        "total_activations",
    )


def hour_labels(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    extent = panels.time_extent(log)
    span = spark.range(1).select(extent.alias("extent")).select("extent.first", "extent.last")
    anchor = F.to_date("first")
    slots = F.sequence(clock.hour_slot(F.col("first"), anchor), clock.hour_slot(F.col("last"), anchor))
    cells = span.select(anchor.alias("anchor"), F.explode(slots).alias("hour_slot"))
    return cells.select("hour_slot", clock.slot_label(F.col("hour_slot"), F.col("anchor")).alias("time"))


def hourly_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _panel(spark, folder)


def hourly_panel_compat(spark: SparkSession, folder: str) -> DataFrame:
    return panels.hourly_panel(_log(spark, folder), grid="compat")


def hourly_panel_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _panel(spark, folder).na.fill(0, ["total_activations"]).drop("earliest_activation", "latest_activation")


def future_panel(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    anchor = panels.first_day(log)
    future = panels.future_panel(panels.devices(log), AT_END, anchor, future_flag="active")
    return future.withColumn("time", clock.slot_label(F.col("hour_slot"), anchor))


def panel_union(spark: SparkSession, folder: str) -> DataFrame:
    """History and future as two tables and their union; all parts share one rollup of the log."""
    rollup = panels.hourly_rollup(_log(spark, folder), AT_END)
    extent = panels.rollup_extent(rollup, AT_END)
    before = rollup.where(F.col("hour_index") < clock.hour_index_ceil(clock.as_time(AT_END)))
    future = panels.future_panel(panels.devices(rollup), AT_END, F.to_date(extent.getField("first")))
    return panels.append(panels.panel_from_rollup(before, extent), future)


def modelling_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panels.modelling_panel(_log(spark, folder), AT_END)


def modelling_panel_inside(spark: SparkSession, folder: str) -> DataFrame:
    return panels.modelling_panel(_log(spark, folder), INSIDE)


def modelling_panel_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return panels.modelling_panel(
        _log(spark, folder), INSIDE, grid="compat", cut_history=False, future_flag="active"
    )


def _cells_with(df: DataFrame, **columns) -> DataFrame:
    return df.select("device", "hour_slot", *[value.alias(name) for name, value in columns.items()])


def lag_yesterday(spark: SparkSession, folder: str) -> DataFrame:
    flag = rates.lagged_flag(clock.HOURS_PER_DAY)
    return _cells_with(modelling_panel(spark, folder), is_active_yesterday=flag)


def lag_last_week(spark: SparkSession, folder: str) -> DataFrame:
    flag = rates.lagged_flag(clock.HOURS_PER_WEEK)
    return _cells_with(modelling_panel(spark, folder), is_active_last_week=flag)


def lag_selfjoin_yesterday(spark: SparkSession, folder: str) -> DataFrame:
    overlap = modelling_panel_overlap(spark, folder)
    return rates.lag_by_self_join(overlap, clock.HOURS_PER_DAY, "is_active_yesterday")


def lag_selfjoin_last_week(spark: SparkSession, folder: str) -> DataFrame:
    overlap = modelling_panel_overlap(spark, folder)
    return rates.lag_by_self_join(overlap, clock.HOURS_PER_WEEK, "is_active_last_week")


def rate_before_now_daily(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(rates.rate_before_now("hour_of_day"), DIGITS)
    return _cells_with(modelling_panel(spark, folder), daily_activation_rate=rate)


def rate_before_now_weekly(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(rates.rate_before_now("hour_of_week"), DIGITS)
    return _cells_with(modelling_panel(spark, folder), weekly_activation_rate=rate)


def device_rate_before_now(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(rates.device_rate_before_now(), DIGITS)
    return _cells_with(modelling_panel(spark, folder), device_rate_so_far=rate)


def rate_latest_only_daily(spark: SparkSession, folder: str) -> DataFrame:
    name = "daily_activation_rate"
    return _rounded(rates.rate_without_latest(modelling_panel(spark, folder), "hour_of_day", name), name)


def rate_latest_only_weekly(spark: SparkSession, folder: str) -> DataFrame:
    name = "weekly_activation_rate"
    return _rounded(rates.rate_without_latest(modelling_panel(spark, folder), "hour_of_week", name), name)


def rate_latest_only_overlap(spark: SparkSession, folder: str) -> DataFrame:
    name = "daily_activation_rate"
    return _rounded(rates.rate_without_latest(modelling_panel_overlap(spark, folder), "hour_of_day", name), name)


def daily_device_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(rates.daily_device_rate(_panel(spark, folder)), "activation_rate")


def daily_fleet_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(rates.daily_fleet_rate(_panel(spark, folder)), "activation_rate")


def rolling7_device(spark: SparkSession, folder: str) -> DataFrame:
    rolling = rates.rolling_week(rates.daily_device_rate(modelling_panel(spark, folder)), ["device"])
    return _rounded(rolling, "activation_rate", "weeks_activation_rate")


def rolling7_fleet(spark: SparkSession, folder: str) -> DataFrame:
    rolling = rates.rolling_week(rates.daily_fleet_rate(modelling_panel(spark, folder)), [])
    return _rounded(rolling, "activation_rate", "weeks_activation_rate")


def rolling7_device_calendar(spark: SparkSession, folder: str) -> DataFrame:
    rolling = rates.rolling_week(rates.daily_device_rate(_panel(spark, folder)), ["device"], frame="range")
    return _rounded(rolling, "activation_rate", "weeks_activation_rate")


def previous_day_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(rates.previous_day_rates(modelling_panel(spark, folder)), *rates.FEATURES[4:])


_FEATURE_OUTPUT = ["device", "hour_slot", "hour_of_day", "hour_of_week", "day_of_week", "type", "is_active"]


def model_features(spark: SparkSession, folder: str) -> DataFrame:
    table = day_features.next_day_features(_log(spark, folder), AT_END)
    return _rounded(table, *rates.FEATURES).select(*_FEATURE_OUTPUT, *rates.FEATURES)


def model_features_inside(spark: SparkSession, folder: str) -> DataFrame:
    table = day_features.next_day_features(_log(spark, folder), INSIDE)
    return _rounded(table, *rates.FEATURES).select(*_FEATURE_OUTPUT, *rates.FEATURES)


def model_features_windows(spark: SparkSession, folder: str) -> DataFrame:
    table = rates.model_features(modelling_panel(spark, folder))
    return _rounded(table, *rates.FEATURES).select(*_FEATURE_OUTPUT, *rates.FEATURES)


def model_features_compat(spark: SparkSession, folder: str) -> DataFrame:
    table = overlap_features.overlap_features(_log(spark, folder), AT_END)
    return _rounded(table, *rates.FEATURES).select(*_FEATURE_OUTPUT, *rates.FEATURES)


def _model_table(spark: SparkSession, folder: str) -> DataFrame:
    return day_features.next_day_features(
        _log(spark, folder), AT_END, device_day_rates=False, fleet_day_rates=False
    )


def _rounded_split(rows: DataFrame) -> DataFrame:
    return _rounded(rows, "daily_activation_rate", "weekly_activation_rate")


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    plan = splits.default_splits(holdout_share=0.0)
    return _rounded_split(splits.split_table(_model_table(spark, folder), plan))


def _busy(log: DataFrame) -> DataFrame:
    """Devices with at least the mean of all devices' activations."""
    totals = panels.hourly_rollup(log).groupBy("device").agg(F.sum("total_activations").alias("total"))
    mean = totals.agg(F.avg("total").alias("mean")).scalar()
    return totals.where(F.col("total") >= mean)


def split_busy_devices(spark: SparkSession, folder: str) -> DataFrame:
    plan = splits.Split(
        "busy", start_hour=splits.FIRST_FULL_SLOT, end_hour=500, row_type="train", devices=_busy(_log(spark, folder))
    )
    return _rounded_split(splits.split_rows(_model_table(spark, folder), plan))


def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    cells = modelling_panel(spark, folder).withColumn(
        "weekly_activation_rate", rates.rate_before_now("hour_of_week")
    )
    kept = splits.complete_rows(cells, ["weekly_activation_rate", "is_active"])
    return _rounded(kept.select("device", "hour_slot", "is_active", "weekly_activation_rate"), "weekly_activation_rate")


def holdout_share(spark: SparkSession, folder: str) -> DataFrame:
    plan = splits.Split("train", start_hour=splits.FIRST_FULL_SLOT, row_type="train", holdout_share=0.2, seed=7)
    rows = splits.with_fold(splits.select_rows(modelling_panel(spark, folder), plan), plan)
    return rows.select("device", "hour_slot", "is_active", "fold")


def holdout_rows(spark: SparkSession, folder: str) -> DataFrame:
    plan = splits.Split("train", start_hour=splits.FIRST_FULL_SLOT, row_type="train", holdout_rows=20, seed=7)
    rows = splits.with_fold(splits.select_rows(modelling_panel(spark, folder), plan), plan)
    return rows.select("device", "hour_slot", "is_active", "fold")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """History rows scored by the weekly rate, which needs no trained model."""
    cells = _panel(spark, folder).withColumn("score", rates.rate_before_now("hour_of_week"))
    return cells.where(F.col("hour_slot") >= splits.FIRST_FULL_SLOT).select(
        "device",
        F.col("is_active").alias("label"),
        F.round("score", DIGITS).alias("score"),
        scalars.to_label(F.col("score"), SCORE_CUT).alias("predicted"),
    )


_ROC_VALUES = ["score_cut", "false_positive_rate", "true_positive_rate"]


def roc_points_by_device(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.roc_points(_scored(spark, folder)), *_ROC_VALUES)


def roc_turning_points(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.roc_points(_scored(spark, folder), drop_collinear=True), *_ROC_VALUES)


def auc_by_device(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.auc_by_device(_scored(spark, folder)), "auc")


def auc_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.auc_pooled(_scored(spark, folder)), "auc")


def accuracy_by_device(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.accuracy(_scored(spark, folder), ["device"]), "accuracy")


def accuracy_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.accuracy(_scored(spark, folder), []), "accuracy")


def confusion_by_device(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.confusion_by_device(_scored(spark, folder))
    return _rounded(report, "tn_percent", "fp_percent", "fn_percent", "tp_percent")


def clipped_labels(spark: SparkSession, folder: str) -> DataFrame:
    cells = _panel(spark, folder).withColumn("rate", rates.rate_before_now("hour_of_week"))
    yhat = scalars.clip_below(F.col("rate") * 2 - F.lit(0.5), 0.0)
    labelled = additive.forecast_labels(cells.select("device", "hour_slot", yhat.alias("yhat")))
    return _rounded(labelled, "yhat")


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "log.csv")
    sinks.write_csv(_log(spark, folder), path)
    return activations.read_log_csv(spark, path)


def _naive_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Hours to predict, labelled by the weekly rate."""
    log = _log(spark, folder)
    cells = panels.modelling_panel(log, AT_END).withColumn("rate", rates.rate_before_now("hour_of_week"))
    return cells.where(F.col("type") == "predict").select(
        scalars.to_label(F.col("rate"), additive.LABEL_CUT).alias("activation_predicted"),
        "device",
        clock.slot_label(F.col("hour_slot"), panels.first_day(log)).alias("time"),
    )


def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "predictions.json")
    sinks.write_json(_naive_predictions(spark, folder).orderBy("device", "time"), path)
    return spark.read.json(path, schema="activation_predicted int, device string, time string")


def json_array_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions with their place in one array, which was written in parts and joined."""
    path = scratch_path(spark, "predictions.array")
    sinks.write_json_array(_naive_predictions(spark, folder), path, ["device", "time"])
    joined = f"{path}/joined.json"
    sinks.join_parts(spark, path, joined)
    # The file has a record per line; its lines keep their order within a file.
    lines = spark.read.text(joined).withColumn("line", F.monotonically_increasing_id())
    record = F.from_json(F.regexp_replace("value", r"^[\[,]|\]$", ""), "activation_predicted int, device string, time string")
    places = numbered(lines, "line", number="place")
    return places.select(record.alias("record"), F.col("place").cast("bigint")).select("record.*", "place")


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Per reason: how many records of a damaged log are set aside; and how many are not."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    time, device = F.col("ts").cast("string"), F.concat(F.lit("device_"), F.col("user_id"))
    kind = F.col("event_id") % 10
    lines = events.select(
        F.when(kind == 1, F.concat_ws(",", F.lit("yesterday"), device, F.lit("1")))
        .when(kind == 2, F.concat_ws(",", time, device, F.lit("one")))
        .when(kind == 3, F.concat_ws(",", time, device))
        .when(kind == 4, F.concat_ws(",", time, device, F.lit("1"), F.lit("more")))
        .when(kind == 5, F.concat_ws(",", F.lit("later"), device, F.lit("2.5")))
        .when(kind == 6, F.concat(time, F.lit(","), device, F.lit(",")))
        .otherwise(F.concat_ws(",", time, device, F.lit("1")))
        .alias("value")
    )
    path = scratch_path(spark, "damaged.csv")
    # Every part file has the header.
    lines.mapInArrow(_with_header, "value string").write.text(path)
    log, rejects = activations.quarantine(spark, path)
    aside = rejects.groupBy("reason").agg(F.count("text").alias("records"), F.count("file").alias("with_file"))
    kept = log.agg(F.count("time").alias("records"), F.count("device_activated").alias("with_file"))
    return aside.unionByName(kept.select(F.lit("none").alias("reason"), "records", "with_file"))


def _with_header(batches):
    header = pa.RecordBatch.from_pydict({"value": ["time,device,device_activated"]})
    first = True
    for batch in batches:
        if first and batch.num_rows:
            yield header
            first = False
        yield batch


def request_time(spark: SparkSession, folder: str) -> DataFrame:
    """The 24 hours after the last event, asked for through a request file."""
    path = scratch_path(spark, "request.tsv")
    last = F.max("time").cast("string")
    request = _log(spark, folder).agg(F.concat(F.lit("'"), last, F.lit("'")).alias("time_for_prediction"))
    request.write.option("sep", "\t").option("header", True).csv(path)
    return panels.future_hours(spark, activations.request_time(spark, path))


def forest_predict(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.run_forest(_log(spark, folder), AT_END, FOREST).predictions


def forest_predict_onehot(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.run_forest(_log(spark, folder), AT_END, replace(FOREST, encoding="onehot")).predictions


def device_flags(spark: SparkSession, folder: str) -> DataFrame:
    return forest.device_flags(panels.devices(_log(spark, folder)))


def _trained(spark: SparkSession, folder: str) -> jobs.ForestRun:
    """The forest of the queries that look at its results from several sides, trained once per store."""
    return jobs.run_forest(_log(spark, folder), AT_END, FOREST, store=f"{shared_folder(spark)}/slotweave-models")


def forest_report(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.fold_report(_trained(spark, folder))


def forest_report_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the report counts per device and fold."""
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return forest_report(spark, folder).select("device", "fold", total.alias("rows"))


def _contract(predictions: DataFrame, label: str) -> DataFrame:
    """Per device: rows, first and last time, and labels that are neither 0 nor 1."""
    odd = F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1))
    return predictions.groupBy("device").agg(
        F.count("*").alias("rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), odd.alias("odd_labels")
    )


def forest_contract(spark: SparkSession, folder: str) -> DataFrame:
    return _contract(_trained(spark, folder).predictions, "activation_predicted")


def score_saved_model(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "model")
    forest.save_model(_trained(spark, folder).model, path)
    return jobs.run_scoring(_log(spark, folder), AT_END, forest.load_model(path))


def score_reload_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per device: rows, and rows on which the stored model says what the trained one said."""
    trained = _trained(spark, folder).predictions.withColumnRenamed("activation_predicted", "trained")
    both = score_saved_model(spark, folder).join(trained, ["device", "time"], "full")
    same = F.count_if(F.col("trained") == F.col("activation_predicted"))
    return both.groupBy("device").agg(F.count("*").alias("rows"), same.alias("agreements"))


#: A state's first days, the day it is brought forward to, and one before the end of the log.
STATE_BEGUN, STATE_FORWARD, STATE_LATE = "2024-01-05", "2024-01-12", "2024-01-20"

STATE_COLUMNS = [
    "device",
    "hour_slot",
    "hour_of_day",
    "hour_of_week",
    "day_of_week",
    "is_active_yesterday",
    "is_active_last_week",
    "daily_activation_rate",
    "weekly_activation_rate",
    "device_rate_so_far",
]


def _state_features(log: DataFrame, state: device_state.DeviceState, start: str) -> DataFrame:
    found, _ = device_state.features_from_state(state, log, start, device_rate=True)
    return _rounded(found.select(*STATE_COLUMNS), *STATE_COLUMNS[7:])


def state_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the hours to predict from a state and the ten days since."""
    log = _log(spark, folder)
    return _state_features(log, device_state.build_state(log, STATE_LATE), AT_END)


def state_features_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The same inside the log and inside a day, from a state that was brought forward and stored between."""
    log = _log(spark, folder)
    state = device_state.advance(device_state.build_state(log, STATE_BEGUN), log, STATE_FORWARD)
    path = scratch_path(spark, "state")
    device_state.save_state(state, path)
    return _state_features(log, device_state.load_state(spark, path), INSIDE)


def score_from_state(spark: SparkSession, folder: str) -> DataFrame:
    """Per device: rows, and rows on which scoring from a state says what scoring from the history says."""
    log, model = _log(spark, folder), _trained(spark, folder).model
    whole = jobs.run_scoring(log, AT_END, model).withColumnRenamed("activation_predicted", "from_history")
    short = jobs.run_scoring_from_state(log, AT_END, model, device_state.build_state(log, STATE_LATE))
    same = F.count_if(F.col("from_history") == F.col("activation_predicted"))
    return short.join(whole, ["device", "time"], "full").groupBy("device").agg(F.count("*").alias("rows"), same.alias("agreements"))


def forest_custom_split(spark: SparkSession, folder: str) -> DataFrame:
    """Training and held-out rows of a narrower split: busy devices, from slot 200 on."""
    log = _log(spark, folder)
    table = jobs.prepare(log, AT_END).features
    plan = splits.Split("train", start_hour=200, row_type="train", devices=_busy(log), holdout_share=0.2)
    rows = jobs.labelled_rows(table, plan)
    return rows.groupBy("device", "fold").agg(F.count("*").alias("rows"), F.min("hour_slot").alias("first_slot"), F.max("hour_slot").alias("last_slot"))


def job_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The forecast job from files to files, through its command line."""
    log, out = scratch_path(spark, "log.csv"), scratch_path(spark, "forecasts")
    sinks.write_csv(_log(spark, folder), log)
    jobs.run_command(["forecast", AT_END, log, out], spark)
    found = spark.read.csv(out, header=True, schema="time string, device string, activation_predicted1 int")
    return _contract(found, "activation_predicted1")


def csv_any_order(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV log with its columns in another order and one more."""
    path = scratch_path(spark, "other.csv")
    log = _log(spark, folder).select("device", F.lit("x").alias("note"), F.col("time").cast("string"), "device_activated")
    log.write.option("header", True).csv(path)
    return activations.read_log_csv(spark, path)


def holdout_rows_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """A hold-out by rows where history and hours to predict share slots."""
    plan = splits.Split("x", start_hour=splits.FIRST_FULL_SLOT, holdout_rows=2000, seed=7)
    rows = splits.with_fold(splits.select_rows(modelling_panel_overlap(spark, folder), plan), plan)
    return rows.groupBy("device", "type", "fold").agg(F.count("*").alias("rows"), F.sum("hour_slot").alias("slots"))


def forecast_contract(spark: SparkSession, folder: str) -> DataFrame:
    return _contract(forecast_predict(spark, folder), "activation_predicted1")


def forecast_normal_equations(spark: SparkSession, folder: str) -> DataFrame:
    """Per device: by how much the fitted coefficients miss their equations, to six places."""
    ready = jobs.prepare(_log(spark, folder), AT_END, device_rate=False)
    return additive.fit_residuals(ready.features).select("device", F.round("residual", 6).alias("residual"))


def forecast_predict(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.run_forecast(_log(spark, folder), AT_END)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        devices,
        unusable_counts,
        event_clock,
        parse_rejects,
        hourly_rollup,
        hour_labels,
        hourly_panel,
        hourly_panel_compat,
        hourly_panel_filled,
        future_panel,
        panel_union,
        modelling_panel,
        modelling_panel_inside,
        modelling_panel_overlap,
        lag_yesterday,
        lag_last_week,
        lag_selfjoin_yesterday,
        lag_selfjoin_last_week,
        rate_before_now_daily,
        rate_before_now_weekly,
        device_rate_before_now,
        rate_latest_only_daily,
        rate_latest_only_weekly,
        rate_latest_only_overlap,
        daily_device_rate,
        daily_fleet_rate,
        rolling7_device,
        rolling7_fleet,
        rolling7_device_calendar,
        previous_day_rates,
        model_features,
        model_features_inside,
        model_features_windows,
        model_features_compat,
        split_rows,
        split_busy_devices,
        complete_rows,
        holdout_share,
        holdout_rows,
        roc_points_by_device,
        roc_turning_points,
        auc_by_device,
        auc_pooled,
        accuracy_by_device,
        accuracy_pooled,
        confusion_by_device,
        clipped_labels,
        csv_roundtrip,
        json_roundtrip,
        json_array_roundtrip,
        csv_rejects,
        request_time,
        csv_any_order,
        holdout_rows_overlap,
        device_flags,
        forest_predict,
        forest_predict_onehot,
        forest_report,
        forest_report_counts,
        forest_contract,
        score_saved_model,
        score_reload_agreement,
        forest_custom_split,
        state_features,
        state_features_forward,
        score_from_state,
        forecast_predict,
        forecast_contract,
        forecast_normal_equations,
        job_roundtrip,
    )
}
