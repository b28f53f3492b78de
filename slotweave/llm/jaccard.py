"""N-gram Jaccard join with Bayesian pruning of candidates.

Sets are the five-word shingles of a text (words are runs of anything but ASCII white space; a
text of one to four words has one shingle, all its words). Every distinct text gets MinHash
values. Texts that agree in a band of values are candidates; a pair with similarity 0.8 misses
every band with a probability below 2e-6. Of a candidate pair the values are compared in steps,
and the pair is dropped when, with a uniform prior, the probability that its similarity reaches
the threshold is below ``TOLERANCE``. All others are verified exactly on their shingles.

A pair belongs to the first band it agrees in, so it is looked at once. Large buckets are cut
into tiles of at most two blocks of members, so a task holds one tile, and each tile reports one
row per member (its links, and the member it is connected to), never its pairs. Copies are one
class with a count; groups are connected components of the links.

Equal texts are always linked; texts without words have no other links. Null texts are empty.
Repeated rows are copies. An empty table gives no rows. Texts are read whole. Only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import keyed, no_null_text, text_key, unused, write_stage
from slotweave.llm.text_arrays import SPACED, hashed_words, mix, sequence_hashes, text_pieces, whole_groups

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 25, 4
VALUES = BANDS * BAND_ROWS
STEP = 20
TOLERANCE = 1e-9
BLOCK = 512
PAIRS = 1 << 17


@cache
def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that stay): Beta posterior after a uniform prior."""
    found = []
    for m in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for k in range(m + 1):
            tail += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= tolerance:
                found.append((m, k))
                break
    return found


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles before each row and the total)."""
    words, first = hashed_words(data, offsets, SPACED)
    count = np.diff(first)
    numbers = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    before = np.concatenate([[0], np.cumsum(numbers)])
    row = np.repeat(np.arange(len(count)), numbers)
    start = first[row] + np.arange(len(row)) - before[row]
    return sequence_hashes(words, start, np.minimum(start + size, first[row + 1])), before


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 64, size=VALUES, dtype=np.uint64) | np.uint64(1)


def signatures(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, a row per row that has shingles."""
    starts = before[:-1][np.diff(before) > 0]
    out = np.empty((len(starts), VALUES), dtype=np.uint16)
    for k, factor in enumerate(_factors()):
        hashed = ((values ^ factor) * factor >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(hashed, starts).astype(np.uint16)
    return out


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_pieces(batch.column("text")):
            # Copies inside the piece have one signature.
            _, one = np.unique(batch.column("k1").to_numpy()[a:b], return_index=True)
            values, before = shingles(data, offsets)
            has = np.flatnonzero(np.diff(before) > 0)
            if not len(has):
                continue
            rows = signatures(values, before)
            first = np.isin(has, one)
            has, rows = has[first], np.ascontiguousarray(rows[first])
            sent = pa.array(has + a)
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(sent), batch.column("k2").take(sent), packed], ["k1", "k2", "values"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        quads = np.frombuffer(b"".join(batch.column("values").to_pylist()), dtype=np.uint64).reshape(n, BANDS)
        keys = mix(quads ^ mix(np.arange(BANDS, dtype=np.uint64), 21)[None, :], 22)
        row = np.repeat(np.arange(n), BANDS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.ravel().view(np.int64)),
                pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)),
                batch.column("k1").take(pa.array(row)),
                batch.column("k2").take(pa.array(row)),
            ],
            ["bucket", "band", "k1", "k2"],
        )


def _pairs(edges: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, i, j) of the pairs of every tile: all pairs of a single block, else those across its two blocks."""
    sizes = np.diff(edges)
    groups = np.flatnonzero(sizes > 1)
    at = 0
    while at < len(groups):
        squares = np.cumsum(sizes[groups[at : at + PAIRS]] ** 2)
        last = at + max(1, int(np.searchsorted(squares, PAIRS, side="right")))
        mine = groups[at:last]
        at = last
        n = sizes[mine]
        row = np.repeat(np.arange(len(mine)), n * n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
        i, j = edges[mine][row] + place // n[row], edges[mine][row] + place % n[row]
        two = np.array([side[edges[g]] != side[edges[g + 1] - 1] or (side[edges[g] : edges[g + 1]] != side[edges[g]]).any() for g in mine])
        good = (i < j) & (~two[row] | (side[i] != side[j]))
        yield mine[row[good]], i[good], j[good]


def _surviving(values: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[tuple[int, int]]):
    """Pairs that are not pruned and whose first common band is this one."""
    matches = np.zeros(len(i), dtype=np.int64)
    done = 0
    for m, least in limits:
        matches += (values[i, done:m] == values[j, done:m]).sum(axis=1)
        keep = matches >= least
        i, j, matches, done = i[keep], j[keep], matches[keep], m
    equal = (values[i] == values[j]).reshape(-1, BANDS, BAND_ROWS).all(axis=2)
    keep = equal.argmax(axis=1) == band[i] if len(i) else np.zeros(0, dtype=bool)
    return i[keep], j[keep]


def _tile_pairs(table: pa.Table, edges: np.ndarray, limits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    values = np.frombuffer(b"".join(table["values"].to_pylist()), dtype=np.uint16).reshape(table.num_rows, VALUES)
    band = table["band"].to_numpy()
    for _, i, j in _pairs(edges, table["block"].to_numpy()):
        yield _surviving(values, band, i, j, limits)


_TILE = ["bucket", "low", "high"]


def _active(limits) -> Callable:
    """Members with a pair left, per tile."""

    def run(batches):
        for table, edges in whole_groups(batches, _TILE):
            used = np.zeros(table.num_rows, dtype=bool)
            for i, j in _tile_pairs(table, edges, limits):
                used[i] = used[j] = True
            yield from table.filter(pa.array(used)).to_batches()

    return run


def _verified(limits, threshold: float) -> Callable:
    """Per member of a tile: copies of the texts it is linked to, and a member it is connected to."""

    def run(batches):
        for table, edges in whole_groups(batches, _TILE):
            n = table.num_rows
            links = np.zeros(n, dtype=np.int64)
            root = np.arange(n)
            copies = table["copies"].to_numpy()
            sets: dict[int, np.ndarray] = {}
            for a, b, data, offsets in text_pieces(table["text"]):
                values, before = shingles(data, offsets)
                for r in range(a, b):
                    sets[r] = np.unique(values[before[r - a] : before[r - a + 1]])
            for i, j in _tile_pairs(table, edges, limits):
                for a, b in _linked(sets, i, j, threshold):
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    for x, y in zip(a.tolist(), b.tolist()):
                        x, y = _root(root, x), _root(root, y)
                        if x != y:
                            root[max(x, y)] = min(x, y)
            some = np.flatnonzero(links > 0)
            top = np.array([_root(root, x) for x in some.tolist()], dtype=np.int64)
            k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
            columns = [k1[some], k2[some], links[some], k1[top], k2[top]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "links", "to1", "to2"])

    return run


def _root(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return int(x)


def _linked(sets: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose shingle sets have at least the similarity, computed exactly."""
    if not len(i):
        return
    used = np.unique(np.concatenate([i, j]))
    place = {int(r): k for k, r in enumerate(used)}
    sizes = np.array([len(sets[int(r)]) for r in used])
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, number = np.unique(np.concatenate([sets[int(r)] for r in used]), return_inverse=True)
    held = np.zeros(number.max() + 1 if len(number) else 1, dtype=bool)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cuts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
    for s, e in zip(cuts[:-1], cuts[1:]):
        a, partners = place[int(i[s])], np.array([place[int(x)] for x in j[s:e]])
        mine = number[first[a] : first[a + 1]]
        held[mine] = True
        # Partners in slices of bounded total size.
        at = 0
        while at < len(partners):
            total = np.cumsum(sizes[partners[at:]])
            stop = at + max(1, int(np.searchsorted(total, 1 << 20)))
            part = partners[at:stop]
            n = sizes[part]
            begin = np.cumsum(n) - n
            index = np.repeat(first[part] - begin, n) + np.arange(n.sum())
            common = np.add.reduceat(held[number[index]].astype(np.int64), begin)
            # common / union >= threshold, for a threshold of whole thousandths
            good = common * 1000 >= round(threshold * 1000) * (len(mine) + n - common)
            yield i[s + at : s + stop][good], j[s + at : s + stop][good]
            at = stop
        held[mine] = False


def _tiled(rows: DataFrame, size: Column) -> DataFrame:
    """Copies of each bucket row for the tiles it belongs to."""
    blocks = F.ceil(size / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), blocks).cast("int"))
    tiled = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    return tiled.select("bucket", "band", low, high, "block", "k1", "k2")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, label): the least node of each node's component. ``edges`` (a, b), ``nodes`` (n); any orderable type.

    Each round takes the least label among neighbours, then the label's own label; rounds are
    written to the shared folder. Only counts reach the driver.
    """
    both = write_stage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = write_stage(nodes.select("n", F.col("n").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("n")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "n", "left").select("n", F.least("label", "near").alias("next"), "label")
        hooked = write_stage(hooked, "hooked")
        up = hooked.select(F.col("n").alias("next"), F.col("next").alias("top"))
        new = hooked.join(up, "next").select("n", "top", "label")
        new = write_stage(new.select("n", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "labels")
        labels = new.select("n", "label")
        if new.where("moved").isEmpty():
            return labels


def classes(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(k1, k2, copies, first_id, links, g1, g2): every distinct text, its links and the key of its group.

    links counts the documents linked to one document of the class, its copies included.
    """
    limits = least_matches(threshold, tolerance)
    text = no_null_text("text")
    rows = documents.select("doc_id", *text_key(text), text.alias("text"))
    texts = write_stage(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "classes")
    hashed = rows.select("k1", "k2", "text").mapInArrow(_signature_rows, "k1 long, k2 long, `values` binary")
    hashed = write_stage(hashed.groupBy("k1", "k2").agg(F.any_value("values").alias("values")), "signatures")
    banded = hashed.mapInArrow(_band_rows, "bucket long, band int, k1 long, k2 long")
    sizes = banded.groupBy("bucket").count().where("count > 1")
    tiled = _tiled(banded.join(sizes, "bucket"), F.col("count"))
    members = tiled.join(hashed, ["k1", "k2"])
    kinds = "bucket long, band int, low int, high int, block int, k1 long, k2 long, `values` binary"
    names = ["bucket", "band", "low", "high", "block", "k1", "k2", "values"]
    in_tiles = lambda df: df.repartition(*_TILE).sortWithinPartitions(*_TILE)
    active = write_stage(in_tiles(members.select(*names)).mapInArrow(_active(limits), kinds), "candidates")
    needed = active.select("k1", "k2").distinct().join(texts.select("k1", "k2", "copies"), ["k1", "k2"])
    bodies = rows.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(needed, ["k1", "k2"])
    judged = in_tiles(active.join(bodies, ["k1", "k2"])).mapInArrow(_verified(limits, threshold), "k1 long, k2 long, links long, to1 long, to2 long")
    judged = write_stage(judged, "links")
    node = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = judged.select(node("k1", "k2").alias("a"), node("to1", "to2").alias("b"))
    labels = components(edges, edges.select(F.col("a").alias("n")).distinct())
    labels = labels.select(F.col("n.x").alias("k1"), F.col("n.y").alias("k2"), F.col("label.x").alias("l1"), F.col("label.y").alias("l2"))
    links = judged.groupBy("k1", "k2").agg(F.sum("links").alias("others"))
    joined = texts.join(links, ["k1", "k2"], "left").join(labels, ["k1", "k2"], "left")
    return joined.select(
        "k1",
        "k2",
        "copies",
        "first_id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        F.coalesce("l1", "k1").alias("g1"),
        F.coalesce("l2", "k2").alias("g2"),
    )


def group_heads(found: DataFrame) -> DataFrame:
    """``classes`` with class_id, the smallest doc_id of the group."""
    found = write_stage(found, "groups")
    heads = found.groupBy("g1", "g2").agg(F.min("first_id").alias("class_id"))
    return found.join(heads, ["g1", "g2"])


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links per row: rows of one class are connected by links."""
    found = group_heads(classes(documents, threshold)).select("k1", "k2", "class_id", F.col("links").alias("n_links"))
    keys = documents.select("doc_id", *text_key(no_null_text("text")))
    return keys.join(found, ["k1", "k2"]).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` with one row left of each group: that of the smallest doc_id."""
    found = group_heads(classes(documents, threshold)).where(F.col("first_id").eqNullSafe(F.col("class_id")))
    # One text per group (two texts may share a doc_id), then one of its rows.
    chosen = found.groupBy("g1", "g2").agg(F.min(F.struct("k1", "k2")).alias("one"), F.min("class_id").alias("head_id"))
    rows, k1, k2 = keyed(documents)
    head = unused(rows, "_head")
    chosen = chosen.select(F.col("one.k1").alias(k1), F.col("one.k2").alias(k2), F.col("head_id").alias(head))
    rows = rows.join(chosen, [k1, k2]).where(F.col("doc_id").eqNullSafe(F.col(head)))
    return rows.dropDuplicates([k1, k2]).select(*[f"`{c}`" for c in documents.columns])
