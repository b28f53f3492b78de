"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``nodes`` points of a ring; a key belongs to the next point clockwise. A shard
takes at most its share of the rows, floor(n / shards) or one more, so counts differ by one at
most (law ``rows``). Keys of a shard that is full continue clockwise to the next point whose
shard has room. A shard serves its own keys first, so only the excess moves.

Only the number of keys per arc reaches the driver (``shards * nodes`` numbers, whatever the
input). The walk over the ring is done on these counts; Spark then ranks the keys of each arc
and reads their shard and slot from the arc's quotas.

Ranks come from counts of small bins: a window never holds more than one bin. A key with very
many rows is split over bins by the hash of its texts, and rows that agree in both, of which any
can take any slot, by input partition; so shard and slot of a row do not depend on the layout.
Null texts have size 1 and CRC 0. A null doc_id is a key like any other. Repeated rows take a slot
each. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import write_stage

NODES = 128
BIN_ROWS = 4096
HOT_KEY_ROWS = 20_000


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the ring and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "little", signed=True), s)
        for s in range(shards)
        for v in range(nodes)
    )
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points])


def quotas(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) for the keys of every arc.

    ``counts`` holds the keys per arc in ring order, ``owners`` the shard of each arc.
    """
    total = int(counts.sum())
    room = np.full(shards, total // shards)
    room[: total % shards] += 1
    kept = np.zeros(len(counts), dtype=np.int64)
    for arc, owner in enumerate(owners):
        kept[arc] = min(counts[arc], room[owner])
        room[owner] -= kept[arc]
    used = np.zeros(shards, dtype=np.int64)
    pieces = []

    def give(arc: int, rank: int, shard: int, n: int) -> int:
        pieces.append((arc, rank, rank + n, int(shard), int(used[shard])))
        used[shard] += n
        return rank + n

    for arc, owner in enumerate(owners):
        rank = give(arc, 0, owner, int(kept[arc])) if kept[arc] else 0
        step = arc
        while rank < counts[arc]:
            step = (step + 1) % len(owners)
            free = int(min(room[owners[step]], counts[arc] - rank))
            if free:
                room[owners[step]] -= free
                rank = give(arc, rank, owners[step], free)
    return pieces


def shard_rows(documents: DataFrame, shards: int = 8, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and home_shard (the key's own) per row."""
    spark = documents.sparkSession
    points, owners = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for position in batches:
            yield pd.Series(np.searchsorted(points, position.to_numpy(np.int64)) % len(points)).astype("int32")

    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    keyed = documents.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("position"),
        F.xxhash64(F.lit(11), data).alias("content"),
        F.spark_partition_id().alias("part"),
    )
    rows = write_stage(keyed.withColumn("arc", arc_of("position")), "ring_keys")
    counts = np.zeros(len(points), dtype=np.int64)
    for arc, n in rows.groupBy("arc").count().collect():
        counts[arc] = n
    bins = max(1, int(counts.sum()) // (BIN_ROWS * len(points)))
    # A row per key, and per key and text, with very many rows: at most one per HOT_KEY_ROWS rows of the input.
    alike = rows.groupBy("position", "content").agg(F.count("*").alias("copies"))
    hot = alike.groupBy("position").agg(F.sum("copies").alias("held")).where(F.col("held") > HOT_KEY_ROWS)
    same = alike.where(F.col("copies") > HOT_KEY_ROWS).select("position", "content", F.lit(True).alias("same"))
    pieces = F.greatest(F.lit(1), F.floor(F.col("held") / BIN_ROWS)).cast("long")
    binned = rows.join(hot.select("position", pieces.alias("pieces")), "position", "left").join(same, ["position", "content"], "left")
    binned = binned.select(
        "doc_id",
        "size",
        "text_crc32",
        "position",
        "content",
        "arc",
        F.pmod("position", F.lit(bins)).cast("int").alias("bin"),
        # 0 for all keys of ordinary size, so they come first in their bin.
        F.when(F.col("pieces").isNotNull(), F.pmod("content", F.col("pieces")) + 1).otherwise(F.lit(0)).alias("salt"),
        F.when(F.col("same"), F.col("part") + 1).otherwise(F.lit(0)).alias("copy"),
    )
    # Hot keys that share a bin stay apart by their position.
    binned = binned.withColumn("hot_position", F.when(F.col("salt") > 0, F.col("position")).otherwise(F.lit(0)))
    keys = ["arc", "bin", "hot_position", "salt", "copy"]
    in_bin = Window.partitionBy(*keys).orderBy("position", "content", "doc_id", "text_crc32", "size")
    before = Window.partitionBy("arc").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(*keys).count()
    starts = starts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = binned.withColumn("number", F.row_number().over(in_bin) - 1).join(starts, keys)
    # At most one piece per arc and shard.
    table = spark.createDataFrame(
        [(*piece, int(owners[piece[0]])) for piece in quotas(counts, owners, shards)],
        "arc int, first long, after long, shard int, slot0 long, home_shard int",
    )
    rank = F.col("before") + F.col("number")
    placed = ranked.withColumn("rank", rank).join(F.broadcast(table), "arc").where("rank >= first and rank < after")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )
