"""Session settings, the shared scratch folder and tables written between stages."""

from __future__ import annotations

import contextlib
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster spark-submit supplies it."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slotweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="slotweave-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    folder = f"{shared_folder(spark)}/slotweave-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


#: Folders of this process in the shared folder.
_made: list[str] = []


def stages_made() -> int:
    """How many stages this process has written and not deleted."""
    return len(_made)


def drop_stages(spark: SparkSession, keep: int = 0, newest: int = 0) -> None:
    """Delete all but the first ``keep`` and the ``newest`` last stages of this process.

    Results that read the others must be stored by then.
    """
    jvm = spark.sparkContext._jvm
    end = max(keep, len(_made) - newest)
    for folder in _made[keep:end]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[keep:end]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with.

    It does so when the driver's JVM collects the plans, which a driver that is seldom short of memory puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, failed or not, the stages written inside it; store the result inside it."""
    earlier = stages_made()
    try:
        yield
    finally:
        drop_stages(spark, earlier)


def write_stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    The table outlives lost executors, cuts the lineage, and stays columnar, so later
    readers still prune columns and push filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    # The values in folder names have no type of their own, and no rows leave no folder.
    reader = spark.read.schema(df.schema) if partition_by else spark.read
    return reader.parquet(path)


def device_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
