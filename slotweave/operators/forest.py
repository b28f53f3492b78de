"""The pooled random forest: one model for all devices, as a Spark ML pipeline.

The trees are grown as Spark ML grows them (bootstrap samples, candidate columns per node, bins, Gini impurity,
pruning of leaves that say the same), level by level from counts that the tasks add up. Spark's own learner keeps
a weight and a node per row and tree and a bin per row and column, which at 40 million rows is more than the
executors' disks hold; here a row is a byte per column, and weights and nodes are found anew in each pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import TaskContext, cloudpickle, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from slotweave.functions import trees
from slotweave.functions.clock import HOURS_PER_WEEK
from slotweave.operators.dictionary import dictionary
from slotweave.operators.splits import LABEL, MODEL_FEATURES, complete_rows
from slotweave.session import free_shuffles, scratch_path, write_stage

# Executors get the functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(trees)

DEVICE_RATE = "device_rate_so_far"

#: Trees of one part of the forest, which are grown side by side: a level of all of them is one pass over the rows.
TREES_AT_ONCE = 64
#: Parts side by side: executors work on one while the driver takes in the splits of another.
FITS_AT_ONCE = 2
#: With a column per device a node has few counts, and a part has one tree for as many columns, so that fewer
#: passes make the sets of rows of all devices.
COLUMNS_PER_TREE = 5
#: Counts that a task holds at once, of 8 bytes; nodes beyond are counted in a further pass.
CELLS_AT_ONCE = 16_000_000
#: Bytes of counts sent by the tasks until Spark is asked to delete the shuffle files of earlier passes.
SENT_AT_MOST = 500_000_000

_COLUMNS = "place int, name string, by_flags boolean"


@dataclass(frozen=True)
class ForestSettings:
    """Size of the forest and how it sees the device.

    ``encoding``: ``rate`` gives the device's activation rate so far (fixed width, for any
    number of devices), ``onehot`` a 0/1 column per device.
    """

    trees: int = 512
    depth: int = 8
    features_per_split: int = 4
    min_rows_per_leaf: int = 1
    bins: int = HOURS_PER_WEEK  # every hour of the week can be a threshold
    memory_mb: int = 1024
    seed: int = 42
    encoding: str = "rate"


def model_inputs(encoding: str, columns: Sequence[str] = MODEL_FEATURES) -> list[str]:
    """The columns a model reads."""
    if encoding == "onehot":
        return list(columns)
    if encoding == "rate":
        return [DEVICE_RATE if name == "device" else name for name in columns]
    raise ValueError(f"unknown encoding {encoding!r}: use 'onehot' or 'rate'")


@dataclass(frozen=True)
class Forest:
    """A trained forest. ``devices`` numbers the columns of a model with a column per device."""

    pipeline: PipelineModel
    columns: tuple[str, ...]
    devices: DataFrame | None = None
    nodes: Sequence[tuple[np.ndarray, ...]] | None = None
    """Per tree the feature (-1: leaf), threshold, left and right child and counts of its nodes."""

    @property
    def stages(self) -> list:
        return self.pipeline.stages


def device_dictionary(rows: DataFrame) -> DataFrame:
    """``device, device_index``: the names in order, numbered on the executors."""
    named = rows.where(F.col("device").isNotNull())
    return dictionary(named, "device", "device_index").withColumn("device_index", F.col("device_index").cast("int"))


def _sparse(index: Column, width: int, others: Sequence[str] = ()) -> Column:
    """A flag among ``width`` places and further numbers behind it, in the layout of a sparse vector."""
    places = [index.cast("int"), *[F.lit(width + i) for i in range(len(others))]]
    values = [F.lit(1.0), *[F.col(name).cast("double") for name in others]]
    kind = F.lit(0).cast("tinyint").alias("type")
    size = F.lit(width + len(others)).alias("size")
    return F.struct(kind, size, F.array(*places).alias("indices"), F.array(*values).alias("values"))


def with_device_flags(rows: DataFrame, devices: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_flags``: a 0/1 column per device, one for all other devices, and the ``others``.

    The dictionary is joined, not broadcast: it is as long as the fleet. Only its length is
    known to the driver.
    """
    width = devices.count() + 1
    coded = rows.join(devices, "device", "left")
    index = F.coalesce(F.col("device_index"), F.lit(width - 1))
    return coded.withColumn("_flags", _sparse(index, width, others)).drop("device_index")


def device_flags(rows: DataFrame) -> DataFrame:
    """``device``, the place of its column, the number of flags set, and that of all columns.

    The last column is for devices not seen in training.
    """
    flagged = with_device_flags(rows.select("device").distinct(), device_dictionary(rows))
    return flagged.select(
        "device",
        F.col("_flags.indices")[0].alias("device_index"),
        F.aggregate("_flags.values", F.lit(0.0), lambda total, x: total + x).cast("int").alias("flags_set"),
        F.col("_flags.size").alias("width"),
    )


def _by_flags(encoding: str, columns: Sequence[str]) -> bool:
    return encoding == "onehot" and "device" in columns


def _trees_at_once(width: int) -> int:
    """Trees of one part, for rows of ``width`` columns."""
    return max(TREES_AT_ONCE, width // COLUMNS_PER_TREE)


def _classifier(settings: ForestSettings, label: str, part: int = 0, width: int = 0) -> RandomForestClassifier:
    """Settings and columns of one part, with the trees from number ``part * _trees_at_once(width)`` on."""
    own = f"_{part}" if part else ""
    at_once = _trees_at_once(width)
    return RandomForestClassifier(
        featuresCol="_features",
        labelCol=label,
        predictionCol=f"_prediction{own}",
        probabilityCol=f"_probability{own}",
        rawPredictionCol=f"_votes{own}",
        numTrees=min(at_once, settings.trees - part * at_once),
        maxDepth=settings.depth,
        featureSubsetStrategy=str(settings.features_per_split),
        minInstancesPerNode=settings.min_rows_per_leaf,
        maxBins=settings.bins,
        maxMemoryInMB=settings.memory_mb,
        # Spark's own learner would walk all trees anew in each pass without it.
        cacheNodeIds=True,
        seed=settings.seed,
    )


_DEVICE = "_device"


@dataclass(frozen=True)
class _Binned:
    """Training rows in chunks, and what their bins mean. ``flags``: 0/1 columns of devices before the others."""

    chunks: DataFrame
    points: list[np.ndarray]
    flags: int
    classes: int
    kind: str
    joint: list[tuple]
    """The columns that are counted together."""

    @property
    def stride(self) -> int:
        """Counts of a node and a group of columns."""
        return self.classes * max(cells for _, _, cells, _ in self.joint)

    @property
    def features(self) -> int:
        return self.flags + len(self.points)


def _binned(
    complete: DataFrame, columns: Sequence[str], label: str, settings: ForestSettings, devices: DataFrame | None = None
) -> _Binned:
    """The rows with a bin per column, written once. As in Spark ML, thresholds come from some bins x bins rows."""
    size = complete.agg(F.count(F.lit(1)).alias("rows"), F.max(label).alias("label")).first()
    if not size.rows:
        raise ValueError("there are no complete rows to train on")
    wanted = max(settings.bins**2, 10_000)
    some = complete if size.rows <= wanted else complete.sample(False, wanted / size.rows, settings.seed)
    seen = some.select(*[F.col(c).cast("double") for c in columns]).toArrow()
    points = [trees.split_points(seen.column(c).to_numpy(), settings.bins) for c in columns]
    rows, device, flags = complete, None, 0
    if devices is not None:
        device, flags = _DEVICE, devices.count() + 1
        rows = complete.join(devices.withColumnRenamed("device_index", device), "device")
    made, names, kind = trees.as_chunks, list(columns), trees.bin_type(settings.bins)
    chunks = rows.mapInArrow(
        lambda batches: made(batches, names, label, device, points, kind, TaskContext.get().partitionId()), trees.CHUNK_TABLE
    )
    written = write_stage(chunks, "chunks")
    widths = [len(p) + 1 for p in points]
    groups = trees.joint_groups(widths, np.array([np.searchsorted(p, seen.column(c).to_numpy()) for c, p in zip(columns, points)]))
    occurring, packed = trees.occurring, [[] for _ in groups]
    for row in written.mapInArrow(lambda batches: occurring(batches, groups, widths, kind), trees.COUNTED).toArrow().to_pylist():
        packed[row["item"]].append(row["cells"])
    joint = trees.joint_cells(groups, widths, packed)
    return _Binned(written, points, flags, max(2, int(size.label) + 1), kind, joint)


@dataclass
class _Tree:
    """A tree as far as it is grown."""

    number: int
    levels: list[dict[str, np.ndarray]]
    """Per level the paths of the nodes that were asked for a split, their counts and what was chosen."""
    routes: list[tuple[np.ndarray, np.ndarray]]
    """Per level the splits, and which of their children are split again."""
    paths: np.ndarray
    counts: np.ndarray | None


def _grown(rows: _Binned, settings: ForestSettings, first: int, trees_wanted: int) -> list[_Tree]:
    """Trees from number ``first`` on: a pass over the rows for each level of all of them."""
    grown = [_Tree(first + i, [], [], np.zeros(1, np.int64), None) for i in range(trees_wanted)]
    splits: dict[tuple[int, int], int] = {}
    for level in range(settings.depth):
        asked = [_item(rows, settings, tree, level) for tree in grown if len(tree.paths)]
        for tree, found in _counted(rows, settings, splits, [part for item in asked for part in item]):
            _take_in(tree, found, splits)
    return grown


def _item(rows: _Binned, settings: ForestSettings, tree: _Tree, level: int) -> list[tuple[_Tree, dict]]:
    """What a pass counts for a tree, in parts of at most ``CELLS_AT_ONCE`` counts."""
    draws = np.random.default_rng([level, tree.number, settings.seed & 0xFFFFFFFF])
    width = min(settings.features_per_split, rows.features)
    chosen = np.array([draws.choice(rows.features, width, replace=False) for _ in tree.paths])
    step = max(1, CELLS_AT_ONCE // (rows.stride * len(rows.joint)))
    items = []
    for start in range(0, len(tree.paths), step):
        own, paths = chosen[start : start + step], tree.paths[start : start + step]
        used = set((own[own >= rows.flags] - rows.flags).tolist())
        groups = [g for g, (columns, *_) in enumerate(rows.joint) if used.intersection(columns)]
        if tree.counts is None and not groups:
            groups = [len(rows.joint) - 1]
        # A node that has a device's column twice would count it twice; columns are drawn without repeats.
        node, place = np.nonzero(own < rows.flags)
        every = len(paths) == 1 << level
        item = {
            "tree": tree.number, "levels": tree.routes, "paths": None if every else paths, "nodes": len(paths), "depth": level,
            "groups": groups, "pairs": (node, own[node, place]), "chosen": own,
            "totals": None if tree.counts is None else tree.counts[start : start + step],
        }
        items.append((tree, item))
    return items


def _counted(rows: _Binned, settings: ForestSettings, splits: dict, items: list[tuple[_Tree, dict]]) -> Iterable[tuple[_Tree, list]]:
    """Each tree with the results of its items, from as few passes as memory allows."""
    spark = rows.chunks.sparkSession
    widths = [len(p) + 1 for p in rows.points]
    known = np.array(list(splits), np.int64).reshape(-1, 2)
    job = {
        "seed": settings.seed & 0xFFFFFFFF, "classes": rows.classes, "flags": rows.flags, "kind": rows.kind, "widths": widths,
        "joint": rows.joint, "stride": rows.stride, "splits": (known[:, 0], known[:, 1]), "least": settings.min_rows_per_leaf,
    }
    passes: list[list[tuple[_Tree, dict]]] = []
    held = CELLS_AT_ONCE
    for tree, item in items:
        size = trees.cells_of(job, item)[1]
        if held + size > CELLS_AT_ONCE:
            passes.append([])
            held = 0
        passes[-1].append((tree, item))
        held += size
    found: dict[int, list] = {}
    for some in passes:
        asked = job | {"items": [item for _, item in some]}
        tasks = min(rows.chunks.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
        count, choose = trees.counted, trees.chosen
        counts = rows.chunks.coalesce(tasks).mapInArrow(lambda batches, job=asked: count(batches, job), trees.COUNTED)
        best = counts.repartition(min(tasks, len(some)), "item").mapInArrow(lambda batches, job=asked: choose(batches, job), trees.CHOSEN)
        for row in best.toArrow().sort_by("item").to_pylist():
            tree, item = some[row["item"]]
            found.setdefault(tree.number, []).append((item, row))
        _free_when_due(spark, 4 * tasks * sum(trees.cells_of(job, item)[1] for _, item in some))
    by_number = {tree.number: tree for tree, _ in items}
    return [(by_number[number], parts) for number, parts in found.items()]


_sent = [0]


def _free_when_due(spark: SparkSession, sent: int) -> None:
    _sent[0] += sent
    if _sent[0] > SENT_AT_MOST:
        _sent[0] = 0
        free_shuffles(spark)


def _take_in(tree: _Tree, parts: list[tuple[dict, dict]], splits: dict[tuple[int, int], int]) -> None:
    """The tree with one more level."""
    joined = {name: np.concatenate([row[name] for _, row in parts]) for name in ("features", "cuts", "gains", "left", "totals")}
    classes = len(joined["totals"]) // len(tree.paths)
    totals, left = joined["totals"].reshape(-1, classes), joined["left"].reshape(-1, classes)
    level = {"paths": tree.paths, "totals": totals, "left": left} | {name: joined[name] for name in ("features", "cuts", "gains")}
    split = np.flatnonzero(joined["features"] >= 0)
    if tree.routes:
        # Now it is known which nodes of the level before have children that are split.
        above = tree.levels[-1]["paths"][tree.levels[-1]["features"] >= 0]
        children = np.stack([2 * above, 2 * above + 1], axis=1).ravel()
        tree.routes[-1] = (tree.routes[-1][0], np.flatnonzero(np.isin(children, tree.paths[split])))
    tree.levels.append(level)
    pairs = zip(joined["features"][split].tolist(), joined["cuts"][split].tolist())
    tree.routes = [*tree.routes, (np.array([splits.setdefault(p, len(splits)) for p in pairs], np.int64), np.zeros(0, np.int64))]
    paths = np.stack([2 * tree.paths[split], 2 * tree.paths[split] + 1], axis=1).ravel()
    counts = np.stack([left[split], totals[split] - left[split]], axis=1).reshape(-1, classes)
    mixed = (counts > 0).sum(axis=1) > 1
    tree.paths, tree.counts = paths[mixed], counts[mixed].astype(np.int64)


def _finished(rows: _Binned, tree: _Tree) -> tuple[np.ndarray, ...]:
    """The nodes of a tree in preorder; leaves of one node that say the same become one, as in Spark ML."""
    places = [{int(path): i for i, path in enumerate(level["paths"])} for level in tree.levels]

    def node(depth: int, path: int, counts: np.ndarray) -> tuple:
        i = places[depth].get(path) if depth < len(places) else None
        if i is None or tree.levels[depth]["features"][i] < 0:
            return (counts,)
        level = tree.levels[depth]
        left = node(depth + 1, 2 * path, level["left"][i])
        right = node(depth + 1, 2 * path + 1, counts - level["left"][i])
        if len(left) == len(right) == 1 and left[0].argmax() == right[0].argmax():
            return (counts,)
        feature, cut = int(level["features"][i]), int(level["cuts"][i])
        threshold = 0.5 if feature < rows.flags else float(rows.points[feature - rows.flags][cut])
        return counts, feature, threshold, float(level["gains"][i]), left, right

    features, thresholds, lefts, rights, counts, gains = [], [], [], [], [], []

    def put(found: tuple) -> int:
        at = len(features)
        leaf = len(found) == 1
        features.append(-1 if leaf else found[1])
        thresholds.append(0.0 if leaf else found[2])
        gains.append(-1.0 if leaf else found[3])
        counts.append(found[0])
        lefts.append(-1)
        rights.append(-1)
        if not leaf:
            lefts[at], rights[at] = put(found[4]), put(found[5])
        return at

    put(node(0, 0, tree.levels[0]["totals"][0]))
    return np.array(features), np.array(thresholds), np.array(lefts), np.array(rights), np.array(counts), np.array(gains)


_NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
    "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def _as_model(spark: SparkSession, fit: RandomForestClassifier, grown: list[tuple], features: int, classes: int) -> RandomForestClassificationModel:
    """Trees as a model of Spark ML, through the form in which it stores models."""
    path = scratch_path(spark, "forest")
    rows = []
    for number, (feature, threshold, left, right, counts, gains) in enumerate(grown):
        for i in range(len(feature)):
            leaf, total = feature[i] < 0, counts[i].sum()
            split = (-1, [], -1) if leaf else (int(feature[i]), [float(threshold[i])], -1)
            impurity = float(1 - ((counts[i] / total) ** 2).sum())
            rows.append((number, (i, float(counts[i].argmax()), impurity, counts[i].tolist(), int(total), float(gains[i]), int(left[i]), int(right[i]), split)))
    spark.createDataFrame(rows, _NODES).coalesce(1).write.parquet(f"{path}/data")
    own = {p.name: value for p, value in fit._paramMap.items()}
    default = {p.name: value for p, value in fit._defaultParamMap.items()}

    def described(name: str, uid: str, less: set[str], more: dict) -> str:
        maps = {"paramMap": own, "defaultParamMap": default}
        maps = {key: {n: v for n, v in values.items() if n not in less} for key, values in maps.items()}
        head = {"class": f"org.apache.spark.ml.classification.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
        return json.dumps(head | maps | more)

    size = {"numFeatures": features, "numClasses": classes}
    text = described("RandomForestClassificationModel", fit.uid, set(), size | {"numTrees": len(grown)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    forest_only = {"numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"}
    each = [(i, described("DecisionTreeClassificationModel", f"dtc_{fit.uid}_{i}", forest_only, size), 1.0) for i in range(len(grown))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return RandomForestClassificationModel.load(path)


def _stored_nodes(spark: SparkSession, pipeline: str) -> list[tuple[np.ndarray, ...]]:
    """The trees of a stored pipeline, in the order of its stages."""
    stage = F.regexp_extract("_metadata.file_path", r"/stages/(\d+)_[^/]*/data/[^/]*$", 1).cast("int").alias("stage")
    data = spark.read.schema(_NODES).parquet(f"{pipeline}/stages/*/data")
    node = [F.col(f"nodeData.{name}") for name in ("id", "impurityStats", "leftChild", "rightChild")]
    split = [F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")]
    found: dict[tuple[int, int], list] = {}
    for row in data.select(stage, "treeID", *node, *split).toArrow().to_pylist():
        found.setdefault((row["stage"], row["treeID"]), []).append(row)
    trees_found = []
    for _, rows in sorted(found.items()):
        rows.sort(key=lambda row: row["id"])
        values = [[row[name] for row in rows] for name in ("feature", "threshold", "leftChild", "rightChild", "impurityStats")]
        trees_found.append((np.array(values[0]), np.array([v or 0.0 for v in values[1]]), *(np.array(v) for v in values[2:])))
    return trees_found


def _nodes_of(pipeline: PipelineModel) -> list[tuple[np.ndarray, ...]]:
    spark = SparkSession.active()
    path = scratch_path(spark, "pipeline")
    pipeline.write().save(path)
    return _stored_nodes(spark, path)


def _fitted(
    rows: _Binned, settings: ForestSettings, label: str
) -> tuple[list[RandomForestClassificationModel], list[tuple[np.ndarray, ...]]]:
    """The forest in parts of ``_trees_at_once`` trees, whose votes add up, and the nodes of all its trees."""
    spark = rows.chunks.sparkSession
    at_once = _trees_at_once(rows.features)
    parts = range(max(1, -(-settings.trees // at_once)))

    def fit(part: int) -> tuple[RandomForestClassificationModel, list[tuple[np.ndarray, ...]]]:
        asked = _classifier(settings, label, part, rows.features)
        grown = [_finished(rows, tree) for tree in _grown(rows, settings, part * at_once, asked.getNumTrees())]
        return _as_model(spark, asked, grown, rows.features, rows.classes), [tree[:5] for tree in grown]

    with ThreadPool(min(FITS_AT_ONCE, len(parts))) as pool:
        found = pool.map(inheritable_thread_target(spark)(fit), parts)
    return [model for model, _ in found], [tree for _, nodes in found for tree in nodes]


def training_rows(
    rows: DataFrame, settings: ForestSettings, columns: Sequence[str] = MODEL_FEATURES, label: str = LABEL
) -> DataFrame:
    """The complete rows a forest is fitted on, with its inputs and label alone."""
    needed = [*model_inputs(settings.encoding, columns), label]
    return complete_rows(rows.select(*needed), needed)


def train_forest(
    rows: DataFrame,
    settings: ForestSettings = ForestSettings(),
    columns: Sequence[str] = MODEL_FEATURES,
    label: str = LABEL,
) -> Forest:
    """Fit on labelled rows. Training makes many passes: give it a written table."""
    inputs = model_inputs(settings.encoding, columns)
    complete = training_rows(rows, settings, columns, label)
    if not _by_flags(settings.encoding, inputs):
        assembler = VectorAssembler(inputCols=inputs, outputCol="_features")
        models, nodes = _fitted(_binned(complete, inputs, label, settings), settings, label)
        return Forest(PipelineModel([assembler, *models]), tuple(inputs), nodes=nodes)
    devices = device_dictionary(complete)
    others = [name for name in inputs if name != "device"]
    models, nodes = _fitted(_binned(complete, others, label, settings, devices), settings, label)
    return Forest(PipelineModel(models), tuple(inputs), devices, nodes)


def predict(model: Forest, rows: DataFrame) -> DataFrame:
    """``rows`` with the predicted class and the probability of activity; keys stay."""
    prepared, columns, device, flags = rows, list(model.columns), None, 0
    if model.devices is not None:
        columns, device, flags = [name for name in model.columns if name != "device"], _DEVICE, model.devices.count() + 1
        prepared = rows.join(model.devices.withColumnRenamed("device_index", device), "device", "left").select(*rows.columns, device)
    nodes = _nodes_of(model.pipeline) if model.nodes is None else model.nodes
    plan, scored = trees.scoring_plan(nodes), trees.scored
    added = [T.StructField("activation_predicted", T.IntegerType()), T.StructField("activation_probability", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *added])
    return prepared.mapInArrow(lambda batches: scored(batches, plan, columns, device, flags), schema)


def save_model(model: Forest, path: str) -> None:
    """A folder with the pipeline, the columns it reads and, if it has one, the dictionary of devices."""
    spark = SparkSession.active()
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    if model.devices is not None:
        model.devices.write.mode("overwrite").parquet(f"{path}/devices")
    columns = spark.createDataFrame([(i, name, model.devices is not None) for i, name in enumerate(model.columns)], _COLUMNS)
    columns.coalesce(1).write.mode("overwrite").json(f"{path}/columns")


def load_model(path: str) -> Forest:
    spark = SparkSession.active()
    columns = spark.read.schema(_COLUMNS).json(f"{path}/columns").orderBy("place").collect()
    by_flags = bool(columns) and columns[0].by_flags
    devices = spark.read.parquet(f"{path}/devices") if by_flags else None
    pipeline = f"{path}/pipeline"
    return Forest(PipelineModel.load(pipeline), tuple(c.name for c in columns), devices, _stored_nodes(spark, pipeline))


def needs_device_rate(model: Forest) -> bool:
    """Whether the rows to score must carry the device-rate column."""
    return DEVICE_RATE in model.columns
