import random

import pytest
from pyspark.sql import functions as F

from slotweave.operators import metrics, splits


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"device_{d}", s, "train" if s < 300 else "predict", s % 2) for d in range(4) for s in range(324)]
    return spark.createDataFrame(rows, "device string, hour_slot int, type string, is_active int").cache()


def test_slot_range_devices_and_type(table):
    split = splits.Split("x", start_hour=168, end_hour=310, devices=["device_1", "device_3"], row_type="train")
    found = splits.select_rows(table, split).agg(F.min("hour_slot"), F.max("hour_slot"), F.count("*")).first()
    assert tuple(found) == (168, 299, 2 * 132)


def test_devices_as_a_table(spark, table):
    few = spark.createDataFrame([("device_2",)], "device string")
    assert splits.select_rows(table, splits.Split("x", devices=few)).select("device").distinct().count() == 1


def test_holdout_by_rows(table):
    split = splits.Split("train", row_type="train", holdout_rows=20)
    folds = dict(splits.with_fold(splits.select_rows(table, split), split).groupBy("fold").count().collect())
    assert folds == {"test": 20, "train": 1180}


@pytest.mark.parametrize("n", [1, 20, 999, 2592, 5000])
def test_holdout_by_rows_on_repeated_keys(table, n):
    """Shared slots of history and future, and whole rows that repeat: nothing is added or lost."""
    both = table.unionByName(table.withColumn("type", F.lit("predict")))
    split = splits.Split("x", holdout_rows=n)
    marked = splits.with_fold(both.unionByName(both.where("hour_slot < 5")), split)
    total = 2 * 1296 + 40
    assert marked.count() == total
    assert marked.where("fold = 'test'").count() == min(n, total)
    text = marked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "TakeOrdered" not in text


def test_holdout_by_share_does_not_depend_on_partitioning(table):
    split = splits.Split("train", holdout_share=0.2, seed=3)
    held = [
        sorted(tuple(r) for r in splits.with_fold(rows, split).where("fold = 'test'").select("device", "hour_slot").collect())
        for rows in (table, table.repartition(7, "hour_slot"))
    ]
    assert held[0] == held[1]
    assert 0.15 < len(held[0]) / table.count() < 0.25
    other = splits.with_fold(table, splits.Split("train", holdout_share=0.2, seed=4)).where("fold = 'test'")
    assert sorted(tuple(r) for r in other.select("device", "hour_slot").collect()) != held[0]


def test_share_bounds(table):
    everything = splits.with_fold(table, splits.Split("x", holdout_share=1.0))
    assert everything.where("fold = 'train'").count() == 0
    with pytest.raises(ValueError):
        splits.Split("x", holdout_share=0.2, holdout_rows=20)


def test_split_table_in_one_pass_equals_the_union(table):
    plan = {
        "late": splits.Split("late", start_hour=100, row_type="train", holdout_share=0.25),
        "some": splits.Split("some", end_hour=150, devices=["device_0", "device_2"]),
        "predict": splits.Split("predict", row_type="predict"),
    }
    columns = ["hour_slot"]
    one_pass = splits.split_table(table, plan, columns)
    union = [splits.split_rows(table, split, columns) for split in plan.values()]
    expected = sorted(tuple(row) for part in union for row in part.collect())
    assert sorted(tuple(row) for row in one_pass.collect()) == expected
    assert {row[-1] for row in expected} == {"train", "test", "all"}
    assert "Union" not in one_pass._jdf.queryExecution().executedPlan().toString()
    by_rows = splits.split_table(table, {**plan, "few": splits.Split("few", holdout_rows=5)}, columns)
    assert by_rows.where("split = 'few' and fold = 'test'").count() == 5


def test_complete_rows(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None)], "a int, b double")
    assert splits.complete_rows(rows, ["b"]).count() == 1


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("d_1", 0.9, 1), ("d_1", 0.8, 0), ("d_1", 0.8, 1), ("d_1", 0.1, 0), ("d_2", 0.7, 1), ("d_2", 0.2, 1)]
    frame = spark.createDataFrame(rows, "device string, score double, label int")
    return frame.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).cache()


def test_device_report(scored):
    rows = {r.device: r for r in metrics.device_report(scored).collect()}
    one, two = rows["d_1"], rows["d_2"]
    assert (one.auc, one.accuracy, one.device_number) == (0.875, 0.75, "1")
    assert (one.tn, one.fp, one.fn, one.tp) == (1, 1, 0, 2)
    assert (one.tn_percent, one.fp_percent, one.fn_percent, one.tp_percent) == (25.0, 25.0, 0.0, 50.0)
    assert (two.auc, two.accuracy) == (None, 0.5)
    assert (two.tn, two.fp, two.fn, two.tp) == (0, 0, 1, 1)


def test_roc_points(scored):
    points = metrics.roc_points(scored).where("device = 'd_1'").orderBy(F.col("score_cut").desc()).collect()
    assert [tuple(p)[1:] for p in points] == [
        (float("inf"), 0.0, 0.0),
        (0.9, 0.0, 0.5),
        (0.8, 0.5, 1.0),
        (0.1, 1.0, 1.0),
    ]


def test_turning_points_keep_the_area(spark):
    random.seed(5)
    rows = [("d", round(random.random(), 2), int(random.random() < 0.4)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "device string, score double, label int")
    areas = []
    for drop in (False, True):
        points = sorted((p.false_positive_rate, p.true_positive_rate) for p in metrics.roc_points(frame, drop_collinear=drop).collect())
        areas.append((len(points), sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))))
    auc = metrics.auc_by_device(frame).first().auc
    assert areas[0][1] == pytest.approx(auc) and areas[1][1] == pytest.approx(auc)
    assert areas[1][0] <= areas[0][0]


@pytest.mark.parametrize("slices", [2, 16, 256])
def test_pooled_auc_against_brute_force(spark, slices):
    """Heavy ties, a narrow band with most scores, and unlabelled rows."""
    random.seed(slices)
    rows = []
    for i in range(600):
        score = random.choice([0.5, random.random(), 0.25 + random.random() * 1e-9])
        rows.append((score, int(random.random() < 0.3 + score / 3)))
    rows += [(0.1, None), (0.9, None)]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    frame = spark.createDataFrame(rows, "score double, label int")
    assert metrics.auc_pooled(frame, slices=slices).first().auc == pytest.approx(expected)


def test_pooled_auc_with_one_class(spark):
    frame = spark.createDataFrame([(0.5, 1), (0.6, 1)], "score double, label int")
    assert metrics.auc_pooled(frame).first().auc is None
