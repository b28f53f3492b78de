"""Readers of the activation log and of the one-row prediction request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from slotweave.functions.clock import as_time
from slotweave.session import write_stage

# The log as text; ``time`` is cast afterwards so that bad values are seen, not dropped.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("device_activated", T.IntegerType()),
    ]
)


def parse_time(raw: DataFrame) -> DataFrame:
    """Cast the ``time`` text; the job fails on a bad value, with ANSI mode on or off."""
    text = F.col("time")
    parsed = text.try_cast("timestamp_ntz")
    refused = F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz")
    return raw.withColumn("time", F.when(text.isNotNull() & parsed.isNull(), refused).otherwise(parsed))


def parse_time_lenient(raw: DataFrame) -> DataFrame:
    """As ``parse_time``, but bad text becomes null and is flagged in ``time_rejected``."""
    parsed = F.col("time").try_cast("timestamp_ntz")
    return raw.withColumn("time_rejected", F.col("time").isNotNull() & parsed.isNull()).withColumn("time", parsed)


def _log_columns(raw: DataFrame, path: str) -> DataFrame:
    """The log's columns by name; others are left out."""
    missing = [name for name in LOG_SCHEMA.names if name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(raw.columns)}")
    return raw.select(*LOG_SCHEMA.names)


_RAW = "_raw_record"


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a CSV log as text columns by name, those that do not fit the header with their raw text."""
    header = spark.read.csv(path, header=True).columns
    _log_columns(spark.createDataFrame([], T.StructType([T.StructField(name, T.StringType()) for name in header])), path)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, _RAW]])
    # With pruned columns the reader would not see that a record has too few or too many values.
    reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", _RAW).option("columnPruning", False)
    return reader.schema(schema).csv(path)


def _with_reasons(records: DataFrame) -> DataFrame:
    """Typed columns, and ``reasons``: what cannot be read of a record."""
    time, number = F.col("time").try_cast("timestamp_ntz"), F.col("device_activated").try_cast("int")
    broken = F.col(_RAW).isNotNull()
    reasons = [
        F.when(broken, "malformed record"),
        F.when(~broken & F.col("time").isNotNull() & time.isNull(), F.concat(F.lit("not a time: "), F.col("time"))),
        F.when(
            ~broken & F.col("device_activated").isNotNull() & number.isNull(),
            F.concat(F.lit("not a number: "), F.col("device_activated")),
        ),
    ]
    values = [F.col(name) for name in records.columns if name != _RAW]
    return records.select(
        time.alias("time"),
        "device",
        number.alias("device_activated"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
        F.col("_metadata.file_path").alias("file"),
        F.coalesce(F.col(_RAW), F.to_csv(F.struct(*values))).alias("text"),
    )


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header that names ``time, device, device_activated``, in any order, among others.

    A record that does not fit the header, or a value that is no time or no whole number, stops the
    job, with ANSI mode on or off; see ``quarantine`` to set such records aside.
    """
    found = _with_reasons(_csv_records(spark, path))
    refused = F.raise_error(F.concat(F.array_join("reasons", "; "), F.lit(" in "), F.col("text"))).cast("timestamp_ntz")
    time = F.when(F.size("reasons") > 0, refused).otherwise(F.col("time"))
    # Checked in a column that is always read.
    return found.select(time.alias("time"), "device", "device_activated")


def quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A CSV log without the records that cannot be read, and these with file, text and reasons.

    Both come from one scan: the records are written once, apart by whether they were rejected, and
    each side reads its own part.
    """
    found = _with_reasons(_csv_records(spark, path))
    reasons = F.array_join("reasons", "; ")
    rejected = F.size("reasons") > 0
    sorted_out = found.select(
        "time",
        "device",
        "device_activated",
        F.when(rejected, F.col("file")).alias("file"),
        F.when(rejected, F.col("text")).alias("text"),
        F.when(rejected, reasons).alias("reason"),
        rejected.alias("rejected"),
    )
    written = write_stage(sorted_out, "quarantine", partition_by="rejected")
    return written.where(~F.col("rejected")).select(*LOG_SCHEMA.names), written.where("rejected").select("file", "text", "reason")


def instant_to_time(instant: Column, source_zone: str) -> Column:
    """The wall clock of ``source_zone`` at an instant, whatever the session's zone."""
    micros = F.unix_micros(instant)
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    seconds = ((micros - days.cast("bigint") * 86_400_000_000).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = start + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(source_zone), utc)


def read_log_parquet(spark: SparkSession, path: str, source_zone: str = "UTC") -> DataFrame:
    """Parquet; text times are parsed strictly, instants are read in ``source_zone``."""
    raw = _log_columns(spark.read.parquet(path), path)
    kind = raw.schema["time"].dataType
    if isinstance(kind, T.StringType):
        raw = parse_time(raw)
    elif isinstance(kind, T.TimestampType):
        raw = raw.withColumn("time", instant_to_time(F.col("time"), source_zone))
    return raw.select(
        as_time(F.col("time")).alias("time"),
        F.col("device").cast("string").alias("device"),
        _whole_number("device_activated").alias("device_activated"),
    )


def _whole_number(name: str) -> Column:
    """A whole number; text that is none stops the job, with ANSI mode on or off."""
    refused = F.raise_error(F.concat(F.lit("not a number: "), F.col(name).cast("string"))).cast("int")
    number = F.col(name).try_cast("int")
    return F.when(F.col(name).isNotNull() & number.isNull(), refused).otherwise(number)


def log_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as an activation log: one activation per event."""
    return events.select(
        F.col("ts").alias("time"),
        F.concat(F.lit("device_"), F.col("user_id").cast("string")).alias("device"),
        F.lit(1).alias("device_activated"),
    )


def read_log(spark: SparkSession, path: str, kind: str | None = None, source_zone: str = "UTC") -> DataFrame:
    """``kind`` is ``csv`` or ``parquet``; without it a path that ends in .parquet is Parquet, else CSV."""
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown kind {kind!r}: use 'csv' or 'parquet'")
    return read_log_parquet(spark, path, source_zone) if kind == "parquet" else read_log_csv(spark, path)


def read_request(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated request with one ``time_for_prediction`` text.

    The text may stand in literal single quotes; they are stripped before the cast.
    """
    schema = T.StructType([T.StructField("time_for_prediction", T.StringType())])
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema)
    text = F.regexp_replace("time_for_prediction", "^'|'$", "")
    return raw.select(as_time(text).alias("time_for_prediction"))


def request_time(spark: SparkSession, path: str) -> str:
    """The first request row as text, for use as a job argument."""
    row = read_request(spark, path).select(F.col("time_for_prediction").cast("string")).first()
    if row is None:
        raise ValueError(f"no prediction time in {path}")
    return row[0]


def usable(log: DataFrame) -> DataFrame:
    """Rows that can be placed on the grid; see ``unusable_counts`` for what is left out."""
    return log.where(F.col("device").isNotNull() & F.col("time").isNotNull())


def unusable_counts(log: DataFrame) -> DataFrame:
    """One row: how many log rows lack a device or a time."""
    return log.agg(
        F.count_if(F.col("device").isNull()).alias("null_device"),
        F.count_if(F.col("time").isNull()).alias("null_time"),
        F.count(F.lit(1)).alias("rows_read"),
    )
