"""Hard negatives by exact inner products with the method of Four Russians.

Components become integers, and every candidate is packed once into bit planes: a byte holds one
bit of eight neighbouring dimensions. For a block of anchors a task builds, for every group of
eight dimensions, the sums of all 256 subsets of the anchors' components. A candidate's byte looks
its subset up, and planes are shifted and added from the sign down, which gives whole exact scores.

Each block of anchors takes two passes over the candidates. The first scores rows of the anchors'
own labels and keeps the best as positives; the second scores rows of other labels and keeps, for
each positive, the best within its window of scores. A task reports only its own best rows per
anchor and positive, so candidates are never shuffled. The driver holds one block of anchors with
their positives, whose size is bounded by ``BLOCK`` and by the memory of its tables.

Rows with a null vec_id or label, a null vector or a null or non-finite component take no part.
Vectors meet only vectors of their own length; empty ones score 0. A repeated row is a candidate
(and an anchor) of its own. Ties go to the smaller vec_id. An empty table gives no rows. Scores that
might not fit 62 bits raise an error. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import write_stage
from slotweave.operators.dictionary import numbered
from slotweave.session import scratch_path

BLOCK = 1024
TABLE_BYTES = 32 << 20
CANDIDATES = 1024
SUBSETS = 256
_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Anchors:
    """One block of anchors, ordered by label, as it goes to the tasks."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    wide: bool

    def tables(self) -> np.ndarray:
        """(group, subset, anchor): sums of the anchors' components over every subset of eight dimensions."""
        kind = np.int64 if self.wide else np.int32
        groups = -(-self.vector.shape[1] // 8)
        padded = np.zeros((8 * groups, len(self.row)), dtype=kind)
        padded[: self.vector.shape[1]] = self.vector.T
        sums = np.zeros((groups, SUBSETS, len(self.row)), dtype=kind)
        for bit in range(8):
            sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + padded[bit::8][:, None, :]
        return sums


def pack(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of integer rows, (row, plane, group), lowest plane first, the last one the sign; their number."""
    largest = int(np.abs(vectors).max(initial=0))
    bits = largest.bit_length() + 1
    planes = [np.packbits(((vectors >> bit) & 1).astype(np.uint8), axis=1, bitorder="little") for bit in range(bits)]
    return np.stack(planes, axis=1), bits


def unpack(planes: np.ndarray, length: int) -> np.ndarray:
    """The integer rows of bit planes."""
    rows, bits, _ = planes.shape
    out = np.zeros((rows, length), dtype=np.int64)
    for bit in range(bits):
        plane = np.unpackbits(planes[:, bit], axis=1, count=length, bitorder="little").astype(np.int64) << bit
        out += -plane if bit == bits - 1 else plane
    return out


def scores(planes: np.ndarray, tables: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Inner products of packed candidates with the anchors from ``first`` to before ``last``."""
    rows, bits, groups = planes.shape
    anchors = len(range(*slice(first, last).indices(tables.shape[2])))
    total = np.zeros((rows, anchors), dtype=tables.dtype)
    for bit in range(bits - 1, -1, -1):
        total <<= 1
        for group in range(groups):
            found = tables[group][planes[:, bit, group], first:last]
            if bit == bits - 1:
                total -= found
            else:
                total += found
    return total


def _packed(embeddings: DataFrame, scale: int) -> DataFrame:
    """row, vec_id, label, length, bits, planes: every usable vector as bit planes."""
    number = lambda x: x.cast("double")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    usable = usable.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("length"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(first, CANDIDATES) for whole in batches for first in range(0, whole.num_rows, CANDIDATES)):
            length = batch.column("length").to_numpy()
            values = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False) * scale)
            if len(values) and np.abs(values).max() >= 1 << 40:
                raise ValueError("the inner products may not fit a long")
            values = values.astype(np.int64)
            starts = np.cumsum(length) - length
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                packed, bits = pack(values[starts[at][:, None] + np.arange(size)])
                data = [row.tobytes() for row in packed]
                columns = [batch.column(name).take(pa.array(at)) for name in ("row", "vec_id", "label", "length")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(len(at), bits, dtype=np.int32)), pa.array(data, pa.binary())],
                    ["row", "vec_id", "label", "length", "bits", "planes"],
                )

    return write_stage(usable.mapInArrow(planes, "row long, vec_id long, label long, length int, bits int, planes binary"), "bit_planes")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """row, vec_id, label and planes of at most ``CANDIDATES`` rows with equally many planes."""
    for batch in batches:
        row, vec, label, bits = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label", "bits"))
        column = batch.column("planes")
        for many in np.unique(bits):
            at = np.flatnonzero(bits == many)
            for piece in np.array_split(at, -(-len(at) // CANDIDATES)):
                planes = np.frombuffer(b"".join(column.take(pa.array(piece)).to_pylist()), dtype=np.uint8)
                yield row[piece], vec[piece], label[piece], planes.reshape(len(piece), many, -1)


class _Best:
    """The best ``k`` (score, vec_id) per slot so far."""

    def __init__(self, slots: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.slot, self.score, self.vec = (np.zeros(0, dtype=np.int64) for _ in range(3))
        # What a newcomer must beat: a score, and at that score a vec_id.
        self.least, self.least_vec = floor.astype(np.int64), np.full(slots, np.iinfo(np.int64).min)

    def better(self, score: np.ndarray, vec: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Which candidates (rows) would be kept in the slots (columns) from ``first`` to before ``last``."""
        least, least_vec = self.least[first:last], self.least_vec[first:last]
        return (score > least) | ((score == least) & (vec[:, None] < least_vec))

    def add(self, slot: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, vec = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.slot, self.score, self.vec = slot[place < self.k], score[kept], vec[kept]
        full = slot[place == self.k - 1]
        self.least[full], self.least_vec[full] = score[last], vec[last]


def _positives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(anchor, score, vec_id, rank): the best ``k`` other rows of each anchor's label."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def find(batches):
        block = shared.value
        tables = block.tables()
        best = _Best(len(block.row), k, np.full(len(block.row), np.iinfo(np.int64).min))
        for row, vec, label, planes in _slices(batches):
            for one in np.intersect1d(label, block.label):
                first, last = np.searchsorted(block.label, [one, one + 1])
                at = np.flatnonzero(label == one)
                score = scores(planes[at], tables, first, last).astype(np.int64)
                mask = best.better(score, vec[at], first, last) & (row[at][:, None] != block.row[first:last])
                c, a = np.nonzero(mask)
                best.add(a + first, score[c, a], vec[at][c])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.vec)], ["anchor", "score", "vec_id"])

    found = rows.mapInArrow(find, "anchor long, score long, vec_id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _negatives(rows: DataFrame, anchors: Anchors, positive: dict[str, np.ndarray], k: int) -> DataFrame:
    """The best ``k`` rows of other labels within the window of each positive, with both scores.

    ``positive`` has a row per positive and anchor: vec_id, score, low and high; an empty window
    stands for a positive that is missing.
    """
    shared = rows.sparkSession.sparkContext.broadcast((anchors, positive))

    def find(batches):
        block, positive = shared.value
        tables = block.tables()
        low, high = positive["low"], positive["high"]
        asked = [j for j in range(len(low)) if (low[j] <= high[j]).any()]
        best = {j: _Best(len(block.row), k, low[j] - 1) for j in asked}
        for _, vec, label, planes in _slices(batches) if asked else ():
            score = scores(planes, tables).astype(np.int64)
            other = label[:, None] != block.label
            for j, kept in best.items():
                c, a = np.nonzero(kept.better(score, vec) & (score <= high[j]) & other)
                kept.add(a, score[c, a], vec[c])
        for j, kept in best.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kept.slot * len(low) + j),
                    pa.array(block.vec_id[kept.slot]),
                    pa.array(positive["vec_id"][j][kept.slot]),
                    pa.array(kept.vec),
                    pa.array(positive["score"][j][kept.slot]),
                    pa.array(kept.score),
                ],
                ["slot", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
            )

    found = rows.mapInArrow(
        find, "slot long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    )
    order = Window.partitionBy("slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _block(rows: DataFrame, length: int, wide: bool) -> Anchors:
    table = rows.select("row", "vec_id", "label", "bits", "planes").toArrow()
    vectors = [
        unpack(np.frombuffer(data, dtype=np.uint8).reshape(1, bits, -1), length) for data, bits in zip(table["planes"].to_pylist(), table["bits"].to_pylist())
    ]
    label = table["label"].to_numpy()
    order = np.argsort(label, kind="stable")
    vector = np.concatenate(vectors) if vectors else np.zeros((0, length), dtype=np.int64)
    return Anchors(table["row"].to_numpy()[order], table["vec_id"].to_numpy()[order], label[order], vector[order], wide)


def hard_negatives(
    embeddings: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on vec_id and label. For each anchor and each of its best
    ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score
    lies within ``window`` per cent of the positive's.
    """
    spark = embeddings.sparkSession
    rows = _packed(embeddings, scale)
    path, written = scratch_path(spark, "hard_negatives"), False
    asked = rows.where(anchors).groupBy("length").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("length").agg(F.max("bits").alias("bits")).join(asked, "length").collect()
    for length, bits, n in sorted((s["length"], s["bits"], s["n"]) for s in sizes):
        bound = length << 2 * (bits - 1)
        if bound >= 1 << 62:
            raise ValueError("the inner products may not fit a long")
        # A partial sum of the planes is at most four times as large as a score can be.
        wide = bound >= 1 << 29
        per_anchor = max(1, -(-length // 8) * SUBSETS * (8 if wide else 4))
        block = max(1, min(BLOCK, TABLE_BYTES // per_anchor))
        own = rows.where(F.col("length") == length)
        order = numbered(own.where(anchors), "vec_id", "row")
        for first in range(0, n, block):
            mine = _block(order.where(F.col("number").between(first, first + block - 1)), length, wide)
            near = _positives(own, mine, positives).collect()
            shape = (positives, len(mine.row))
            positive = {name: np.zeros(shape, dtype=np.int64) for name in ("vec_id", "score", "low", "high")}
            positive["high"] -= 1
            for p in near:
                at = (p["rank"] - 1, p["anchor"])
                positive["vec_id"][at], positive["score"][at] = p["vec_id"], p["score"]
                # Least and largest scores inside the window, in whole numbers.
                positive["low"][at] = -(-window[0] * p["score"] // 100)
                positive["high"][at] = window[1] * p["score"] // 100
            _negatives(own, mine, positive, negatives).write.mode("append").parquet(path)
            written = True
    return spark.read.schema(_FOUND).parquet(path) if written else spark.createDataFrame([], _FOUND)
