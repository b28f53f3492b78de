import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def make_log(spark):
    """An activation log from (time text, device, value) rows."""

    def build(*rows):
        values = [(None if t is None else dt.datetime.fromisoformat(t), d, v) for t, d, v in rows]
        return spark.createDataFrame(values, "time timestamp_ntz, device string, device_activated int")

    return build


@pytest.fixture(scope="session")
def planted_log(spark):
    """20 devices over 60 days, active from 9:00 to 16:59 with 2 % of the hours flipped."""
    from pyspark.sql import functions as F

    hours = spark.range(20 * 60 * 24).select(
        (F.col("id") % 20).cast("int").alias("number"), F.floor(F.col("id") / 20).cast("int").alias("hour")
    )
    in_office = (F.col("hour") % 24).between(9, 16)
    flipped = F.pmod(F.xxhash64("number", "hour"), F.lit(50)) == 0
    active = hours.where(in_office != flipped)
    start = F.lit("2024-03-01 00:10:00").cast("timestamp_ntz")
    log = active.select(
        F.timestamp_add("HOUR", F.col("hour"), start).alias("time"),
        F.concat(F.lit("device_"), F.col("number").cast("string")).alias("device"),
        F.lit(1).alias("device_activated"),
    )
    edges = spark.createDataFrame(
        [(dt.datetime(2024, 3, 1, 0, 5), "device_0", 1), (dt.datetime(2024, 4, 29, 23, 5), "device_0", 1)], log.schema
    )
    return log.unionByName(edges)
