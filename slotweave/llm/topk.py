"""Exact top-k inner products by distributed histogram selection.

The range of possible scores is cut into bins. Each round counts every query's scores per bin
over all candidates, finds the bin that holds the kth highest, and cuts that bin again, until
it is one value wide. A last pass keeps what lies above that value and, of the ties, the
smallest ids. A task reports only its highest bins that together hold k scores: lower ones
cannot hold the kth highest of all.

Queries are taken in blocks of at most ``BLOCK`` rows; a block is the only thing broadcast. The
driver holds three numbers per query of one block. Candidates are never shuffled.

Vectors that are null or have null or non-finite components, and rows without id, take no part.
Vectors meet only vectors of their own length. A repeated row is a candidate (and a query) of
its own. An empty table gives no rows. Scores that might not fit 63 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import write_stage

BLOCK = 2048
BINS = 1024
CANDIDATES = 2048


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(np.float64)


def _scores(candidates: np.ndarray, queries: np.ndarray, exact: bool) -> np.ndarray:
    """Integer scores, candidates by queries; float products are exact below 2^53."""
    if exact:
        return np.rint(candidates @ queries.T).astype(np.int64)
    return candidates.astype(np.int64) @ queries.T.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, CANDIDATES):
            yield batch.slice(first, CANDIDATES)


def _histogram(rows, queries, low, width, k: int, exact: bool) -> DataFrame:
    """(query, bin, n): counts of scores in the bins of each query's bracket, highest bins only."""
    shared = rows.sparkSession.sparkContext.broadcast((*queries, low, width))

    def count(batches):
        own, matrix, low, width = shared.value
        n = len(own)
        total = np.zeros(n * BINS, dtype=np.int64)
        for batch in _slices(batches):
            at = (_scores(_matrix(batch), matrix, exact) - low) // width
            row = batch.column("row").to_numpy()
            inside = (at >= 0) & (at < BINS) & (row[:, None] != own[None, :])
            total += np.bincount((at + np.arange(n) * BINS)[inside], minlength=n * BINS)
        total = total.reshape(n, BINS)
        higher = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total
        query, at = np.nonzero((total > 0) & (higher < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[query, at])], ["query", "bin", "n"]
        )

    return rows.mapInArrow(count, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _kth_values(rows: DataFrame, queries, bound: int, k: int, exact: bool) -> np.ndarray:
    """The kth highest score of each query, or the lowest possible where there are fewer."""
    n = len(queries[0])
    low, missing = np.full(n, -bound, dtype=np.int64), np.full(n, k)
    # A power of the number of bins, so that a bin is cut into whole bins of the next round.
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    while True:
        order = Window.partitionBy("query").orderBy(F.desc("bin"))
        counted = _histogram(rows, queries, low, width, k, exact).withColumn("upto", F.sum("n").over(order))
        asked = rows.sparkSession.createDataFrame([(i, int(m)) for i, m in enumerate(missing)], "query int, missing long")
        hits = counted.join(F.broadcast(asked), "query").where((F.col("upto") >= F.col("missing")) & (F.col("upto") - F.col("n") < F.col("missing")))
        found = np.zeros(n, dtype=bool)
        for query, at, above in hits.select("query", "bin", F.col("upto") - F.col("n")).collect():
            low[query] += at * width
            missing[query] -= above
            found[query] = True
        # A query with fewer candidates than k keeps them all.
        low[~found] = -bound
        if width == 1:
            return low
        missing[~found] = k
        width //= BINS


def _above(rows: DataFrame, queries, ids: np.ndarray, cut: np.ndarray, k: int, exact: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((*queries, ids, cut))

    def keep(batches):
        own, matrix, ids, cut = shared.value
        for batch in _slices(batches):
            vec = batch.column("vec_id").to_numpy()
            order = np.argsort(vec, kind="stable")
            scores = _scores(_matrix(batch), matrix, exact)[order]
            other = batch.column("row").to_numpy()[order][:, None] != own[None, :]
            tie = (scores == cut) & other
            tie &= np.cumsum(tie, axis=0) <= k
            at, query = np.nonzero(((scores > cut) & other) | tie)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[query]), pa.array(ids[query]), pa.array(vec[order][at]), pa.array(scores[at, query])],
                ["query_row", "query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(keep, "query_row long, query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its ``k`` best."""
    spark = embeddings.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    vectors = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    vectors = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("vector"),
    )
    vectors = write_stage(vectors, "vectors")
    found = None
    sizes = vectors.groupBy(F.size("vector").alias("length")).agg(
        F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")
    )
    for length, largest, asked in sorted(sizes.collect(), key=lambda x: x[0]):
        bound = int(length * (largest or 0.0) ** 2) + 1
        if bound >= 1 << 62:
            raise ValueError("the inner products may not fit a long")
        exact = bound < 1 << 53
        rows = vectors.where(F.size("vector") == length)
        blocks = -(-asked // (BLOCK // 2))
        for block in range(blocks):
            mine = rows.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block))
            table = mine.toArrow().combine_chunks()
            if not table.num_rows:
                continue
            own, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
            values = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            queries = (own, values.reshape(len(own), -1).astype(np.float64))
            cut = _kth_values(rows, queries, bound, k, exact)
            part = _above(rows, queries, ids, cut, k, exact)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
