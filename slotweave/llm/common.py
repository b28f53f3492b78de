"""Reading tables, safe column choice and stages on the shared folder, used by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.session import write_stage

__all__ = ["keyed", "no_null_text", "read_table", "text_key", "unused", "write_stage"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def no_null_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes with different starting values."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def keyed(df: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """``df`` with the two keys of its text, and their names."""
    first, second = unused(df, "_k1"), unused(df, "_k2")
    k1, k2 = text_key(no_null_text(text))
    return df.withColumns({first: k1, second: k2}), first, second
