"""Writers of prediction tables.

Output is a folder of part files, written in parallel. ``single_file`` is for results
that are known to be small, such as one day of a small fleet; the work before it stays
parallel, and an order is kept inside the one file by sorting it again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from slotweave.operators.dictionary import numbered


def _times_as_text(df: DataFrame) -> DataFrame:
    """Times with all their digits; the text writers keep milliseconds only."""
    kinds = (T.TimestampNTZType, T.TimestampType)
    times = [field.name for field in df.schema if isinstance(field.dataType, kinds)]
    return df.withColumns({name: F.col(name).cast("string") for name in times}) if times else df


def _one_file(df: DataFrame, order: Sequence[str]) -> DataFrame:
    one = df.repartition(1)
    return one.sortWithinPartitions(*order) if order else one


def write_csv(df: DataFrame, path: str, single_file: bool = False, order: Sequence[str] = ()) -> None:
    out = _times_as_text(_one_file(df, order) if single_file else df)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json_array(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One JSON array in the given order, as part files that make it up in the order of their names.

    Records are numbered by range partitions, so each task knows by number alone what stands around
    its records: the first of all opens the array, the others begin with a comma, the last closes it.
    No task writes more than its part. ``join_parts`` makes one file of them.
    """
    rows = _times_as_text(df)
    record = F.struct(*rows.columns)
    records = numbered(rows, *order, number="_number")
    total = records.count()
    spark = df.sparkSession
    if not total:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    opening = F.when(F.col("_number") == 0, "[").otherwise(",")
    closing = F.when(F.col("_number") == total - 1, "]").otherwise("")
    text = F.concat(opening, F.to_json(record, {"ignoreNullFields": "false"}), closing)
    records.orderBy("_number").select(text.alias("value")).write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """The part files of ``folder`` as one file, joined by the file system in the order of their names.

    File systems that can join files do so without reading them; the local one appends them block by block.
    """
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    as_path = jvm.org.apache.hadoop.fs.Path
    files = as_path(folder).getFileSystem(settings)
    parts = sorted(
        str(found.getPath()) for found in files.listStatus(as_path(folder)) if found.getPath().getName().startswith("part-") and found.getLen()
    )
    if files.getScheme() != "file":
        first, *rest = [as_path(part) for part in parts]
        if rest:
            names = spark.sparkContext._gateway.new_array(as_path, len(rest))
            for place, part in enumerate(rest):
                names[place] = part
            files.concat(first, names)
        files.rename(first, as_path(target))
        return
    out = files.create(as_path(target), True)
    try:
        for part in parts:
            opened = files.open(as_path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, out, settings, False)
            finally:
                opened.close()
    finally:
        out.close()


def write_json(df: DataFrame, path: str, single_file: bool = False, order: Sequence[str] = ()) -> None:
    """One JSON record per line."""
    out = _times_as_text(_one_file(df, order) if single_file else df)
    out.write.mode("overwrite").json(path)
