import csv
import glob
import json
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from slotweave import session
from slotweave.functions import additive
from slotweave.operators import forecast, forest, metrics, model_store, splits
from slotweave.plans import jobs
from slotweave.sources import activations, sinks

START = "2024-04-29 23:30:00"
SMALL = forest.ForestSettings(trees=20, depth=6)
OFFICE = set(range(9, 17))


@pytest.fixture(scope="module")
def forest_run(planted_log):
    return jobs.run_forest(planted_log, START, SMALL)


def auc_of(rows):
    return metrics.auc_pooled(rows, "activation_probability", splits.LABEL).first().auc


def labels_by_hour(rows, name):
    found = {}
    for row in rows:
        found.setdefault(int(row["time"][11:13]), set()).add(int(row[name]))
    return found


def test_forest_learns_the_planted_hours(forest_run):
    assert auc_of(forest_run.scored.where("fold = 'test'")) >= 0.9
    rows = forest_run.predictions.collect()
    assert len(rows) == 480 and len({(r.device, r.time) for r in rows}) == 480
    assert min(r.time for r in rows) == "2024-04-30 00:00:00" and max(r.time for r in rows) == "2024-04-30 23:00:00"
    assert labels_by_hour(rows, "activation_predicted") == {h: {int(h in OFFICE)} for h in range(24)}


def test_rows_keep_their_nodes_between_passes_and_trees_stay_the_same(spark, monkeypatch):
    # The passes took most of the time at 512 trees, as each walked all trees from the root.
    assert forest._classifier(forest.ForestSettings(), splits.LABEL).getCacheNodeIds()
    rows = spark.range(400, numPartitions=2).select(
        (F.col("id") % 24).alias("hour_of_day"), (F.col("id") % 7).alias("day_of_week"), (F.col("id") % 5 % 2).alias("is_active")
    )
    settings = forest.ForestSettings(trees=6, depth=4, features_per_split=1)
    real = forest._classifier
    trees = [forest.train_forest(rows, settings, ["hour_of_day", "day_of_week"]).stages[-1].toDebugString]
    monkeypatch.setattr(forest, "_classifier", lambda *a: real(*a).setCacheNodeIds(False))
    trees.append(forest.train_forest(rows, settings, ["hour_of_day", "day_of_week"]).stages[-1].toDebugString)
    assert trees[0].split("\n")[1:] == trees[1].split("\n")[1:]


def test_forest_is_fitted_in_parts_whose_votes_add_up(spark, monkeypatch, tmp_path):
    """One fit of all 512 trees kept a weight and a node per row and tree, and counts of all nodes, at once."""
    assert forest._classifier(forest.ForestSettings(), splits.LABEL).getNumTrees() == forest.TREES_AT_ONCE < 512
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 4)
    rows = spark.range(300, numPartitions=2).select(
        (F.col("id") % 24).alias("hour_of_day"), (F.col("id") % 7).alias("day_of_week"), (F.xxhash64("id") % 3 == 0).cast("int").alias("is_active")
    )
    settings = forest.ForestSettings(trees=10, depth=3, features_per_split=1)
    model = forest.train_forest(rows, settings, ["hour_of_day", "day_of_week"])
    fitted = model.stages[1:]
    assert [m.getNumTrees for m in fitted] == [4, 4, 2]
    assert len({tree.toDebugString.split("\n", 1)[1] for m in fitted for tree in m.trees}) == 10
    forest.save_model(model, str(tmp_path / "model"))
    loaded = forest.load_model(str(tmp_path / "model"))
    for row in forest.predict(loaded, rows.distinct()).collect():
        vector = Vectors.dense(row.hour_of_day, row.day_of_week)
        votes = sum(m.predictRaw(vector).toArray() for m in fitted)
        assert row.activation_probability == pytest.approx(votes[1] / 10)
        assert row.activation_predicted == int(votes[1] > votes[0])


def test_report_has_both_folds(forest_run):
    report = jobs.fold_report(forest_run)
    folds = {r.fold: r for r in report.groupBy("fold").agg(F.count("*").alias("n"), F.min("auc").alias("auc")).collect()}
    assert folds["train"].n == folds["test"].n == 20
    assert folds["train"].auc > 0.8


def test_compat_forms_run_with_an_overlap(planted_log):
    options = jobs.Options(grid="compat", cut_history=False, future_flag="active", rates="latest_only")
    run = jobs.run_forest(planted_log, "2024-04-20 10:15:00", SMALL, options, holdout_rows=20)
    assert run.scored.where("fold = 'test'").count() == 20
    rows = run.predictions.collect()
    assert len(rows) == 480 == len({(r.device, r.time) for r in rows})
    assert min(r.time for r in rows) == "2024-04-20 11:00:00"


def test_encodings_agree(planted_log):
    run = jobs.run_forest(planted_log, START, forest.ForestSettings(trees=20, depth=6, encoding="onehot"))
    assert not forest.needs_device_rate(run.model)
    assert auc_of(run.scored.where("fold = 'test'")) >= 0.9


@pytest.mark.parametrize("fleet", [15, 150, 1500])
def test_inputs_do_not_depend_on_the_number_of_devices(spark, fleet):
    rows = spark.range(fleet * 4).select(
        F.concat(F.lit("d_"), F.col("id") % fleet).alias("device"),
        (F.col("id") % 2).cast("int").alias(splits.LABEL),
        *[F.rand(1).alias(name) for name in [*splits.MODEL_FEATURES[1:], forest.DEVICE_RATE]],
    )
    model = forest.train_forest(rows, forest.ForestSettings(trees=2, depth=2))
    assert model.stages[-1].numFeatures == len(splits.MODEL_FEATURES) and forest.needs_device_rate(model)


def test_device_flags(spark):
    rows = forest.device_flags(spark.createDataFrame([("b",), ("a",), ("c",)], "device string")).orderBy("device").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 1, 4), ("b", 1, 1, 4), ("c", 2, 1, 4)]


def test_flags_of_unknown_devices_and_their_model(spark, tmp_path):
    """The dictionary is a table: a stored model codes known devices alike and others in the last column."""
    rows = spark.createDataFrame([(f"d{i % 7}", i % 24, int(i % 7 < 3)) for i in range(700)], "device string, hour_of_day int, is_active int")
    settings = forest.ForestSettings(trees=12, depth=7, features_per_split=4, encoding="onehot")
    model = forest.train_forest(rows, settings, ["device", "hour_of_day"])
    assert model.stages[-1].numFeatures == 7 + 1 + 1
    forest.save_model(model, str(tmp_path / "model"))
    loaded = forest.load_model(str(tmp_path / "model"))
    asked = rows.select("device", "hour_of_day").union(spark.createDataFrame([("new", 5), (None, 5)], "device string, hour_of_day int"))
    found = [sorted(map(str, forest.predict(m, asked).collect())) for m in (model, loaded)]
    assert found[0] == found[1] and len(found[0]) == 702
    right = forest.predict(loaded, rows).where("activation_predicted = is_active").count()
    assert right > 650


def test_wide_vectors_are_fitted_in_fewer_parts(spark, monkeypatch):
    """Each part of 64 trees found the bins of all columns anew, and two parts side by side held them twice."""
    assert forest._trees_at_once(len(splits.MODEL_FEATURES)) == forest.TREES_AT_ONCE < forest._trees_at_once(1508) < 512
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 1)
    monkeypatch.setattr(forest, "COLUMNS_PER_TREE", 2)
    rows = spark.createDataFrame([(f"d{i % 7}", i % 24, int(i % 7 < 3)) for i in range(700)], "device string, hour_of_day int, is_active int")
    settings = forest.ForestSettings(trees=10, depth=5, features_per_split=4, encoding="onehot")
    model = forest.train_forest(rows, settings, ["device", "hour_of_day"])
    assert [m.getNumTrees for m in model.stages] == [4, 4, 2]
    assert len({tree.toDebugString.split("\n", 1)[1] for m in model.stages for tree in m.trees}) == 10
    assert forest.predict(model, rows).where("activation_predicted = is_active").count() > 650


def test_a_model_just_stored_is_not_read_back(spark, monkeypatch, tmp_path):
    """Reading 512 trees back took as long as storing them, in each query that trains for the store."""
    rows = spark.range(400).selectExpr("cast(id % 24 as int) as hour_of_day", "cast(id % 24 > 9 as int) as is_active")
    loads, real = [], model_store.load_model
    monkeypatch.setattr(model_store, "load_model", lambda path: loads.append(path) or real(path))

    def train():
        return forest.train_forest(rows, forest.ForestSettings(trees=4, depth=3), ["hour_of_day"])

    first = model_store.find_or_train(spark, str(tmp_path), "one", train)
    assert not loads
    second = model_store.find_or_train(spark, str(tmp_path), "one", train)
    assert len(loads) == 1
    found = [sorted(map(str, forest.predict(m, rows).collect())) for m in (first, second)]
    assert found[0] == found[1]


def test_model_store_finds_by_content(spark, planted_log, tmp_path, monkeypatch):
    """The same rows in any order find the stored model; other rows or settings, or a deleted model, train."""
    store = str(tmp_path / "store")
    tiny = forest.ForestSettings(trees=3, depth=3)
    trained = []
    real = forest.train_forest
    monkeypatch.setattr(forest, "train_forest", lambda *a: trained.append(1) or real(*a))
    one, two = (jobs.run_forest(log, START, tiny, store=store) for log in (planted_log, planted_log.repartition(7, "time")))
    assert len(trained) == 1
    assert sorted(map(str, one.predictions.collect())) == sorted(map(str, two.predictions.collect()))
    rows = spark.createDataFrame([(i % 24, i % 2) for i in range(50)], "hour_of_day int, is_active int")
    name = model_store.fingerprint(rows, {"trees": 3})
    assert name == model_store.fingerprint(rows.repartition(5, "is_active"), {"trees": 3})
    others = [rows.where("hour_of_day <> 3"), rows.union(rows.limit(1)), rows.withColumn("hour_of_day", F.lit(None).cast("int"))]
    assert len({name, model_store.fingerprint(rows, {"trees": 4}), *(model_store.fingerprint(r, {"trees": 3}) for r in others)}) == 5
    for folder in (store, store, str(tmp_path / "another")):
        model_store.find_or_train(spark, folder, name, lambda: forest.train_forest(rows, tiny, ["hour_of_day"]))
    assert len(trained) == 3 and not list((tmp_path / "store").glob("making-*"))


def test_a_fresh_process_finds_the_model(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id % 24 as int) as hour_of_day", "cast(id % 24 > 9 as int) as is_active")
    name = model_store.fingerprint(rows, {"trees": 2})
    settings = forest.ForestSettings(trees=2, depth=2)
    model_store.find_or_train(spark, str(tmp_path), name, lambda: forest.train_forest(rows, settings, ["hour_of_day"]))
    script = """
import sys
from slotweave.operators import forest, model_store
from slotweave.session import local_session
spark = local_session(2, 2, "1g")
rows = spark.range(400).selectExpr("cast(id % 24 as int) as hour_of_day", "cast(id % 24 > 9 as int) as is_active")
name = model_store.fingerprint(rows, {"trees": 2})
model = model_store.find_or_train(spark, sys.argv[1], name, lambda: sys.exit("it trains"))
print("right", forest.predict(model, rows).where("activation_predicted = is_active").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", script, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=300)
    assert "right 400" in run.stdout.split("\n")


def test_own_splits_columns_and_probability(planted_log):
    plan = {"train": splits.Split("train", start_hour=300, end_hour=900, row_type="train", devices=["device_1", "device_3"])}
    columns = ["hour_of_day", "is_active_yesterday", "daily_activation_rate"]
    run = jobs.run_forest(planted_log, START, SMALL, plan=plan, x_columns=columns, probability=True)
    assert run.model.stages[-1].numFeatures == 3
    assert run.scored.count() == 2 * 601
    assert run.predictions.count() == 480 and "activation_probability" in run.predictions.columns


def test_shuffled_labels_teach_nothing(spark, planted_log):
    table = jobs.prepare(planted_log, START).features.where("type = 'train' and hour_slot >= 168")
    noise = (F.pmod(F.xxhash64("device", "hour_slot", F.lit(1)), F.lit(2)) == 0).cast("int")
    shuffled = splits.with_fold(table.withColumn("is_active", noise), splits.Split("x", holdout_share=0.3))
    model = forest.train_forest(shuffled.where("fold = 'train'"), SMALL)
    assert 0.4 <= auc_of(forest.predict(model, shuffled.where("fold = 'test'"))) <= 0.6


def test_training_is_repeatable(spark, planted_log):
    table = jobs.write_stage(jobs.prepare(planted_log, START).features, "repeat")
    train = table.where("type = 'train' and hour_slot >= 1200")
    sums = [
        forest.predict(forest.train_forest(train, SMALL), train).agg(F.sum("activation_probability")).first()[0]
        for _ in range(2)
    ]
    assert sums[0] == pytest.approx(sums[1], abs=1e-9)


def test_forecast_recovers_the_planted_hours(planted_log):
    rows = jobs.run_forecast(planted_log, START).collect()
    assert len(rows) == 480 and rows[0].__fields__ == ["time", "device", "activation_predicted1"]
    assert labels_by_hour(rows, "activation_predicted1") == {h: {int(h in OFFICE)} for h in range(24)}


def posterior(weights, variance, design, target):
    """Log posterior of the additive model, up to a constant."""
    prior = np.full(design.shape[1], additive.COEFFICIENT_SCALE)
    prior[0] = additive.LEVEL_SCALE
    squares = np.sum((target - design @ weights) ** 2)
    return (
        -len(target) / 2 * np.log(variance)
        - squares / (2 * variance)
        - variance / (2 * additive.NOISE_SCALE**2)
        - np.sum((weights / prior) ** 2) / 2
    )


def test_fit_is_at_the_posterior_mode():
    random = np.random.default_rng(1)
    design = np.hstack([np.ones((200, 1)), random.normal(size=(200, 4))])
    target = design @ np.array([0.4, 1.0, -0.5, 0.0, 0.2]) + random.normal(scale=0.3, size=200)
    weights = additive.fit_additive(design, target)
    variances = np.linspace(0.05, 0.2, 2_000)
    variance = variances[np.argmax([posterior(weights, v, design, target) for v in variances])]
    best = posterior(weights, variance, design, target)
    for _ in range(300):
        moved = weights + random.normal(scale=1e-3, size=5)
        assert posterior(moved, variance, design, target) <= best + 1e-6


def test_seasonal_terms_span_any_phase():
    slots = np.arange(200.0)
    wave = np.cos(2 * np.pi * 2 * (slots + 5.0) / 24)
    terms = additive.seasonal_terms(slots, 24, 4)
    fitted = terms @ np.linalg.lstsq(terms, wave, rcond=None)[0]
    assert np.abs(fitted - wave).max() < 1e-9


def test_scaling_leaves_flags_and_constants():
    inputs = np.array([[0.0, 3.0, 10.0], [1.0, 3.0, 20.0], [1.0, 3.0, 30.0]])
    design = np.column_stack([np.ones(3), inputs])
    scaled = design @ additive.scaling(additive.row_sums(design, np.array([0.0, 1.0, 1.0])), 3)
    assert scaled[:, 1].tolist() == [0.0, 1.0, 1.0] and scaled[:, 2].tolist() == [3.0] * 3
    assert scaled[:, 3] == pytest.approx([-1.0, 0.0, 1.0])


def test_sums_of_parts_give_the_fit_of_the_whole():
    """Coefficients from added sums equal those from the standardised rows at once."""
    rng = np.random.default_rng(5)
    slots = np.arange(700.0)
    inputs = np.column_stack([slots % 24, slots // 24 + 900, (slots % 3 == 0), np.full(700, 7.0), rng.random(700)])
    target = (rng.random(700) < 0.2 + 0.5 * (slots % 24 > 12)).astype(float)
    design = additive.raw_design(slots, inputs)
    parts = [additive.row_sums(design[a:b], target[a:b]) for a, b in ((0, 1), (1, 240), (240, 700))]
    sums = additive.add_sums(additive.add_sums(parts[2], parts[0]), parts[1])
    weights = additive.fit_sums(sums, 5)

    shift, spread = np.zeros(design.shape[1]), np.ones(design.shape[1])
    for j in (-5, -4, -1):
        shift[j], spread[j] = design[:, j].mean(), design[:, j].std(ddof=1)
    scaled = (design - shift) / spread
    wanted = scaled @ additive.fit_additive(scaled, target)
    assert np.abs(design @ weights - wanted).max() < 1e-8
    equations = additive.model_equations(sums, additive.scaling(sums, 5))
    assert additive.largest_residual(*equations, additive.solve_additive(*equations)) < 1e-8


def test_new_days_add_to_the_sums(spark, planted_log):
    """Sums of earlier days and of later ones give the forecast of all days; tasks may hold few devices."""
    features = jobs.write_stage(jobs.prepare(planted_log, START, device_rate=False).features, "parts")
    whole = forecast.forecast(features)
    early = forecast.forecast_sums(features.where("hour_slot < 800"))
    late = forecast.forecast_sums(features.where("hour_slot >= 800").repartition(5))
    short = forecast.forecast(features.where("type = 'predict'"), sums=forecast.add_days(early, late))
    both = whole.join(short.withColumnRenamed("yhat", "again"), ["device", "hour_slot"])
    assert both.count() == 480
    assert both.agg(F.max(F.abs(F.col("yhat") - F.col("again")))).first()[0] < 1e-8
    plan = forecast.forecast_sums(features)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow")


def test_tasks_hold_few_devices_at_a_time(monkeypatch):
    devices = [f"d{i}" for i in range(7) for _ in range(6)]
    n = len(devices)
    columns = {"device": devices, "type": ["train"] * n, "hour_slot": list(range(n)), "is_active": [i % 2 for i in range(n)], "x": [i % 3 for i in range(n)]}
    sums = list(additive.partial_sums([pa.RecordBatch.from_pydict(columns)], ["x"], 2))
    assert [b.num_rows for b in sums] == [2, 2, 2, 1]
    whole = pa.Table.from_batches(sums).combine_chunks().to_batches()
    once = list(additive.fitted(whole, 1))
    monkeypatch.setattr(additive, "FITTED_ROWS", 3)
    found = list(additive.fitted(whole, 1))
    assert [b.num_rows for b in found] == [3, 3, 1]
    assert pa.Table.from_batches(found).to_pylist() == pa.Table.from_batches(once).to_pylist()


def test_fit_takes_the_sums_of_a_device_in_several_rows(spark):
    """Batches of whole sums went through a second worker of each task and grew with the devices."""
    features = spark.range(3000, numPartitions=3).select(
        F.concat(F.lit("d"), F.col("id") % 10).alias("device"),
        (F.col("id") / 10).cast("int").alias("hour_slot"),
        F.lit("train").alias("type"),
        (F.xxhash64("id") % 2 == 0).cast("int").alias("is_active"),
        (F.col("id") % 11).cast("double").alias("x"),
    )
    added = forecast.forecast_sums(features, ["x"])
    parts = forecast._sums_by_task(features, ["x"])
    assert parts.count() > added.count() == 10
    by_device = [{r.device: r.weights for r in forecast.coefficients(sums, ["x"]).collect()} for sums in (added, parts)]
    assert forecast.coefficients(parts, ["x"]).count() == len(by_device[1]) == 10
    for device, weights in by_device[0].items():
        assert by_device[1][device] == pytest.approx(weights)
    assert forecast.fit_residuals(features, ["x"])._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_device_without_any_change_keeps_its_level(make_log):
    log = make_log(*[(f"2024-01-01 {h:02d}:10:00", "always", 1) for h in range(24)], ("2024-01-01 03:00:00", "once", 1))
    rows = jobs.run_forecast(log, "2024-01-01 23:30:00").collect()
    assert {r.activation_predicted1 for r in rows if r.device == "always"} == {1}
    assert len(rows) == 48


def read_csv_folder(path):
    rows = []
    for part in glob.glob(f"{path}/*.csv"):
        with open(part) as lines:
            rows += list(csv.DictReader(lines))
    return rows


def test_jobs_from_files_to_files(spark, planted_log, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    sinks.write_csv(planted_log, log)
    model, report = str(tmp_path / "model"), str(tmp_path / "report")
    stages = session.stages_made()
    common = ["--trees", "10", "--single-file", "--save-model", model, "--report", report]
    jobs.main(["forest", START, log, out, *common], spark)
    trained = read_csv_folder(out)
    assert len(trained) == 480 and set(trained[0]) == {"activation_predicted", "device", "time"}
    assert len(read_csv_folder(report)) == 40

    request = tmp_path / "request.txt"
    request.write_text(f"time_for_prediction\n'{START}'")
    scored = str(tmp_path / "scored")
    jobs.main(["score", str(request), log, model, scored, "--single-file"], spark)
    records = [json.loads(line) for part in glob.glob(f"{scored}/*.json") for line in open(part)]
    assert [(r["device"], r["time"]) for r in records] == sorted((r["device"], r["time"]) for r in records)
    as_trained = {(r["device"], r["time"]): int(r["activation_predicted"]) for r in trained}
    assert {(r["device"], r["time"]): r["activation_predicted"] for r in records} == as_trained

    jobs.main(["forecast", START, log, out, "--single-file", "--log-kind", "csv"], spark)
    assert session.stages_made() == stages
    forecasts = read_csv_folder(out)
    assert len(forecasts) == 480 and set(forecasts[0]) == {"time", "device", "activation_predicted1"}


def test_request_with_quotes(spark, tmp_path):
    path = tmp_path / "request.txt"
    path.write_text("time_for_prediction\n'2022-08-15 13:59:59'")
    assert activations.request_time(spark, str(path)) == "2022-08-15 13:59:59"


def test_bad_time_stops_the_strict_reader(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("time,device,device_activated\n2022-07-01 04:50:00,A,1\nnot a time,A,1\n")
    with pytest.raises(Exception, match="not a time: not a time"):
        activations.read_log_csv(spark, str(path)).collect()
    raw = spark.read.csv(str(path), header=True)
    rejected = activations.parse_time_lenient(raw).where("time_rejected")
    assert rejected.count() == 1


def test_csv_columns_by_name(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("device,note,time,device_activated\nA,x,2022-07-01 04:50:00,1\nB,y,2022-07-01 05:00:00,\n")
    assert [tuple(map(str, r)) for r in activations.read_log_csv(spark, str(path)).collect()] == [
        ("2022-07-01 04:50:00", "A", "1"),
        ("2022-07-01 05:00:00", "B", "None"),
    ]
    path.write_text("device,time\nA,2022-07-01 04:50:00\n")
    with pytest.raises(ValueError, match="device_activated"):
        activations.read_log_csv(spark, str(path))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_instants_in_parquet_do_not_depend_on_the_session_zone(spark, tmp_path, zone):
    path = str(tmp_path / "log")
    micros = 1656651000123456  # 2022-07-01 04:50:00.123456 UTC
    log = spark.range(1).select(F.timestamp_micros(F.lit(micros)).alias("time"), F.lit("A").alias("device"), F.lit(1).alias("device_activated"))
    log.write.parquet(path)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = [str(activations.read_log(spark, path, "parquet", z).first().time) for z in ("UTC", "Europe/Berlin")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == ["2022-07-01 04:50:00.123456", "2022-07-01 06:50:00.123456"]


def test_solver_raises_when_it_does_not_settle(monkeypatch):
    rng = np.random.default_rng(0)
    design = np.column_stack([np.ones(50), rng.normal(size=(50, 3))])
    target = rng.normal(size=50)
    equations = design.T @ design, design.T @ target, float(target @ target), 50
    assert additive.largest_residual(*equations, additive.solve_additive(*equations)) < 1e-8
    monkeypatch.setattr(additive, "NOISE_ROUNDS", 1)
    with pytest.raises(ArithmeticError):
        additive.fit_additive(design, target)


def test_csv_keeps_microseconds(spark, make_log, tmp_path):
    log = make_log(("2022-07-01 04:50:00.123456", "A,\"b\"", 1))
    sinks.write_csv(log, str(tmp_path / "log"))
    assert activations.read_log_csv(spark, str(tmp_path / "log")).collect() == log.collect()
