"""The forest's own learner: what it keeps, what it counts, and what its trees say."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from slotweave.functions import trees
from slotweave.operators import forest

COLUMNS = ["hour_of_week", "hour_of_day", "rate"]


@pytest.fixture(scope="module")
def rows(spark):
    hour = (F.xxhash64("id") % 168 + 168) % 168
    rate = F.round(F.rand(3), 3)
    made = spark.range(3000, numPartitions=3).select(hour.cast("int").alias("hour_of_week"), (hour % 24).cast("int").alias("hour_of_day"), rate.alias("rate"), F.rand(5).alias("draw"))
    active = (F.col("draw") < F.when(F.col("hour_of_day") > 15, F.col("rate")).otherwise(0.1)).cast("int")
    return made.select(*COLUMNS, active.alias("is_active")).localCheckpoint()


def test_a_fit_holds_no_table_of_rows_and_trees(spark, rows):
    """Spark's learner held a weight and a node per row and tree in its cache, which spilled to the disk."""
    held, over = [], threading.Event()

    def watch():
        while not over.wait(0.02):
            held.append(spark.sparkContext._jsc.getPersistentRDDs().size())

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        forest.train_forest(rows, forest.ForestSettings(trees=6, depth=4), COLUMNS)
    finally:
        over.set()
        watcher.join()
    assert len(held) > 10 and max(held) <= before


def gini(labels, weight):
    n = weight.sum()
    return 1 - sum((weight[labels == k].sum() / n) ** 2 for k in (0, 1)) if n else 0.0


def test_splits_are_the_best_of_the_drawn_columns(rows):
    """The split of each node of two levels against all splits of its columns, tried one by one."""
    settings = forest.ForestSettings(trees=1, depth=2, features_per_split=2, bins=40)
    binned = forest._binned(rows, COLUMNS, "is_active", settings)
    (tree,) = forest._grown(binned, settings, 5, 1)
    parts = binned.chunks.collect()
    bins = np.concatenate([np.frombuffer(p.bins, binned.kind).reshape(3, -1) for p in parts], axis=1)
    labels = np.concatenate([np.frombuffer(p.labels, np.uint8) for p in parts])
    weight = np.concatenate([trees.weights(settings.seed, 5, p.part, p.chunk, p.rows) for p in parts])
    assert weight.mean() == pytest.approx(1, abs=0.1) and weight.var() == pytest.approx(1, abs=0.15)
    sets = {0: np.full(len(labels), True)}
    for depth, level in enumerate(tree.levels):
        draws = np.random.default_rng([depth, 5, settings.seed])
        below = {}
        for i, path in enumerate(level["paths"].tolist()):
            at, drawn = sets[path], draws.choice(3, 2, replace=False)
            assert level["totals"][i].tolist() == [weight[at & (labels == k)].sum() for k in (0, 1)]
            n, best = weight[at].sum(), 0.0
            for column in drawn:
                for cut in range(len(binned.points[column])):
                    sides = [at & (bins[column] <= cut), at & (bins[column] > cut)]
                    sizes = [weight[s].sum() for s in sides]
                    if min(sizes) >= 1:
                        gain = gini(labels[at], weight[at]) - sum(gini(labels[s], weight[s]) * w / n for s, w in zip(sides, sizes))
                        best = max(best, gain)
            assert level["gains"][i] == pytest.approx(best) and level["features"][i] in drawn
            left = at & (bins[level["features"][i]] <= level["cuts"][i])
            below |= {2 * path: left, 2 * path + 1: at & ~left}
        sets = below


def test_trees_do_not_depend_on_the_passes(rows, monkeypatch):
    settings = forest.ForestSettings(trees=5, depth=5)
    whole = forest.train_forest(rows, settings, COLUMNS)
    monkeypatch.setattr(forest, "CELLS_AT_ONCE", 3000)
    parts = forest.train_forest(rows, settings, COLUMNS)
    assert whole.stages[-1].toDebugString.split("\n")[1:] == parts.stages[-1].toDebugString.split("\n")[1:]


@pytest.mark.parametrize("longest", [trees.TABLE_DEPTH, 2])
def test_predictions_are_those_of_the_stored_trees(rows, monkeypatch, longest):
    monkeypatch.setattr(trees, "TABLE_DEPTH", longest)
    model = forest.train_forest(rows, forest.ForestSettings(trees=9, depth=6), COLUMNS)
    assert max(t.depth for t in model.stages[-1].trees) > 2
    votes = vector_to_array("_votes")
    by_spark = model.pipeline.transform(rows).select(*COLUMNS, (votes[1] / 9).alias("by_spark"))
    both = forest.predict(model, rows).distinct().join(by_spark.distinct(), COLUMNS)
    assert both.count() >= rows.select(*COLUMNS).distinct().count()
    assert both.where("abs(by_spark - activation_probability) > 1e-9").count() == 0
    assert both.where("activation_predicted <> cast(by_spark > 0.5 as int)").count() == 0


@pytest.mark.parametrize("fleet", [10, 1000])
def test_rows_with_a_column_per_device_do_not_grow_with_the_fleet(spark, fleet):
    """Spark's learner kept a bin per row and device."""
    made = spark.range(4000, numPartitions=2).select(
        F.concat(F.lit("d"), F.col("id") % fleet).alias("device"), (F.col("id") % 24).cast("int").alias("hour_of_day"), (F.col("id") % fleet % 3 == 0).cast("int").alias("is_active")
    )
    settings = forest.ForestSettings(trees=3, depth=3, encoding="onehot")
    binned = forest._binned(made, ["hour_of_day"], "is_active", settings, forest.device_dictionary(made))
    sizes = binned.chunks.select(F.sum(F.length("bins") + F.length("labels") + F.length("devices")), F.sum("rows")).first()
    assert sizes[1] == 4000 and sizes[0] == 4000 * (1 + 1 + 4)
    model = forest.train_forest(made, settings, ["device", "hour_of_day"])
    assert model.stages[-1].numFeatures == fleet + 2


def test_columns_that_follow_from_another_are_counted_with_it():
    hours = np.arange(336) % 168
    bins = np.array([hours % 24, hours, np.arange(336) % 2, np.arange(336)])
    groups = trees.joint_groups([24, 168, 2, 336], bins)
    assert sorted(map(sorted, groups)) == [[0, 1, 2], [3]]
    batch = pa.RecordBatch.from_pydict({"rows": pa.array([336], pa.int32()), "bins": [bins[:2].astype("<u1").tobytes()]})
    (seen,) = trees.occurring([batch], [[1, 0]], [24, 168], "<u1")
    (_, cell, size, own), _ = trees.joint_cells([[1, 0]], [24, 168], [[seen.to_pylist()[0]["cells"]]])
    assert size == 168 and own.tolist() == [list(range(168)), [h % 24 for h in range(168)]]
    assert cell[30 * 24 + 6] == 30


def test_rows_without_a_value_stop_the_job(spark, rows):
    model = forest.train_forest(rows, forest.ForestSettings(trees=2, depth=2), COLUMNS)
    with pytest.raises(Exception, match="rate"):
        forest.predict(model, rows.withColumn("rate", F.lit(None).cast("double"))).collect()
