"""Scores against labels: ROC, AUC, accuracy and confusion counts.

Input is any table with a device, a 0/1 label and a score or a predicted label. Rows with
a null label are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from slotweave.functions.scalars import device_number, percent_of


def _counts_by_score(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per key and distinct score; equal scores become one row."""
    counts = scored.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )
    return counts.where((F.col("positives") + F.col("negatives") > 0) & F.col("score").isNotNull())


def roc_points(
    scored: DataFrame,
    score: str = "score",
    label: str = "label",
    drop_collinear: bool = False,
) -> DataFrame:
    """ROC points per device: one per distinct score, and the origin with an infinite cut.

    A rate is null where the device has no row of that class. ``drop_collinear`` leaves
    out the points that lie on the straight line between their neighbours. A device has
    at most as many scores as hours, which bounds its window.
    """
    device = Window.partitionBy("device")
    falling = device.orderBy(F.col("score").desc())
    so_far = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    curve = _counts_by_score(scored, ["device"], score, label).select(
        "device",
        "score",
        F.sum("positives").over(so_far).alias("true_positives"),
        F.sum("negatives").over(so_far).alias("false_positives"),
        F.sum("positives").over(whole).alias("all_positives"),
        F.sum("negatives").over(whole).alias("all_negatives"),
        F.row_number().over(falling).alias("rank"),
    )
    if drop_collinear:

        def bends(name: str):
            step_in = F.col(name) - F.lag(name).over(falling)
            step_out = F.lead(name).over(falling) - F.col(name)
            return step_in != step_out

        # The comparison is null on the first and the last point, which are kept.
        turning = bends("true_positives") | bends("false_positives")
        curve = curve.withColumn("kept", F.coalesce(turning, F.lit(True))).where("kept")
    point = F.struct(F.col("score").alias("score_cut"), F.col("true_positives").alias("tp"), F.col("false_positives").alias("fp"))
    origin = F.struct(
        F.lit(float("inf")).alias("score_cut"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp")
    )
    points = F.when(F.col("rank") == 1, F.array(origin, point)).otherwise(F.array(point))
    return curve.select("device", "all_positives", "all_negatives", F.inline(points)).select(
        "device",
        "score_cut",
        (F.col("fp") / F.nullif("all_negatives", F.lit(0))).alias("false_positive_rate"),
        (F.col("tp") / F.nullif("all_positives", F.lit(0))).alias("true_positive_rate"),
    )


def auc_by_device(
    scored: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ("device",)
) -> DataFrame:
    """Area under the ROC curve of each device (or ``keys``); null where it has one class only."""
    keys = list(keys)
    higher = Window.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("positives").over(higher), F.lit(0))
    curve = _counts_by_score(scored, keys, score, label).withColumn("positives_above", above)
    area = F.sum(F.col("negatives") * (F.col("positives_above") + F.col("positives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return curve.groupBy(*keys).agg((area / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def auc_pooled(scored: DataFrame, score: str = "score", label: str = "label", slices: int | None = None) -> DataFrame:
    """Exact area under the ROC curve of all rows together.

    A single ordered window over all scores would run on one task. The distinct scores
    are cut into slices at approximate quantiles; each slice is ordered on its own and
    starts from the positives of the slices above it. The cuts only balance the work,
    any cuts give the same area. The slice totals are at most ``slices + 1`` rows; without
    a number there are as many slices as shuffle partitions.
    """
    slices = slices or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = _counts_by_score(scored, [], score, label)
    steps = [i / slices for i in range(1, slices)]
    cuts = counts.agg(F.percentile_approx("score", steps, 10 * slices).alias("cuts")).scalar()
    # Slice 0 holds the highest scores.
    sliced = counts.withColumn("cuts", cuts).select(
        "score",
        "positives",
        "negatives",
        F.size(F.filter("cuts", lambda cut: cut > F.col("score"))).alias("slice"),
    )
    totals = sliced.groupBy("slice").agg(
        F.sum("positives").alias("slice_positives"), F.sum("negatives").alias("slice_negatives")
    )
    slices_above = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "slice", F.coalesce(F.sum("slice_positives").over(slices_above), F.lit(0)).alias("positives_before")
    )
    in_slice = (
        Window.partitionBy("slice").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    above = F.col("positives_before") + F.coalesce(F.sum("positives").over(in_slice), F.lit(0))
    # Every slice has an offset. As an inner join Catalyst would test the slice for null on
    # the rows below the aggregation, and so cut the slices once per row.
    ordered = sliced.join(F.broadcast(offsets), "slice", "left").withColumn("positives_above", above)
    area = F.sum(F.col("negatives") * (F.col("positives_above") + F.col("positives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return ordered.agg((area / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def accuracy(scored: DataFrame, keys: list[str], predicted: str = "predicted", label: str = "label") -> DataFrame:
    """Share of rows whose label was predicted, per key or, without keys, over all rows."""
    hit = (F.col(label) == F.col(predicted)).cast("int")
    return scored.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def confusion_by_device(
    scored: DataFrame, predicted: str = "predicted", label: str = "label", keys: Sequence[str] = ("device",)
) -> DataFrame:
    """Counts of the four outcomes per device (and other ``keys``), and each as percent of the rows."""

    def outcome(actual: int, forecast: int):
        return F.count_if((F.col(label) == actual) & (F.col(predicted) == forecast))

    counts = scored.groupBy(*keys).agg(
        outcome(0, 0).alias("tn"),
        outcome(0, 1).alias("fp"),
        outcome(1, 0).alias("fn"),
        outcome(1, 1).alias("tp"),
    )
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.select(
        *keys,
        device_number(F.col("device")).alias("device_number"),
        "tn",
        "fp",
        "fn",
        "tp",
        *[percent_of(F.col(name), total).alias(f"{name}_percent") for name in ("tn", "fp", "fn", "tp")],
    )


def device_report(
    scored: DataFrame,
    score: str = "score",
    predicted: str = "predicted",
    label: str = "label",
    keys: Sequence[str] = ("device",),
) -> DataFrame:
    """AUC, accuracy and confusion counts side by side, one row per device (and other ``keys``)."""
    counts = confusion_by_device(scored, predicted, label, keys)
    rows = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    right = (F.col("tn") + F.col("tp")) / F.nullif(rows, F.lit(0))
    return counts.withColumn("accuracy", right).join(auc_by_device(scored, score, label, keys), list(keys), "left")
