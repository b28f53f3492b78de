"""Stored models found by what they were trained on.

A model's name is a fingerprint of its training rows and settings, so any process that asks for
the same training finds the model, and other rows or settings never do. The rows are hashed one
by one and their hashes added up, which one pass with partial aggregation does, in any order and
on any partitioning.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotweave.operators.forest import Forest, load_model, save_model


def fingerprint(rows: DataFrame, settings: Mapping[str, object]) -> str:
    """A name for the rows (in any order, repeats counted) and the settings."""
    columns = sorted(rows.columns)
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)
    sums = [F.sum(number.cast("decimal(38,0)")) for number in (first, second)]
    # A null leaves a hash as it was, so nulls are told apart by their number per column.
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), *sums, *[F.count(c) for c in columns]).first()
    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    described = [[str(x) for x in totals], kinds, dict(settings)]
    return hashlib.sha256(json.dumps(described, sort_keys=True, default=str).encode()).hexdigest()[:40]


def _folder(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def find_or_train(spark: SparkSession, store: str, name: str, train: Callable[[], Forest]) -> Forest:
    """The stored model ``name``, trained and stored first if there is none.

    A model gets its name by one rename after it is complete, so a run that fails or is lost
    leaves no half model; of two runs that train the same, the first one's model stays. A model
    just trained and stored is not read back.
    """
    path = f"{store}/{name}"
    files, final = _folder(spark, path)
    if not files.exists(final):
        made = f"{store}/making-{uuid.uuid4().hex}"
        model = train()
        save_model(model, made)
        _, source = _folder(spark, made)
        if not files.exists(final) and files.rename(source, final):
            return model
        files.delete(source, True)
    return load_model(path)
