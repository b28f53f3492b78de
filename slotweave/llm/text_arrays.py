"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes, without a loop over words.

Everything here works on whole texts. A batch is cut into pieces of whole rows so that the
arrays stay small; one row longer than the limit is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.session import write_stage

PIECE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

U64 = np.uint64


def byte_classes(separators: bytes) -> np.ndarray:
    """1 for bytes of words, 0 for the separators."""
    table = np.ones(256, dtype=np.uint8)
    table[list(separators)] = 0
    return table


#: Words are runs of anything but ASCII white space.
SPACED = byte_classes(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = byte_classes(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0 of the rows and their end); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    # Workers live on between stages and should not hold what this batch needed.
    pa.default_memory_pool().release_unused()


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240117).integers(0, 1 << 64, size=256, dtype=np.uint64)


_powers: dict[str, np.ndarray] = {}


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``length`` of each."""
    if "up" not in _powers or len(_powers["up"]) < length:
        size = max(length, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for each span; equal sequences have equal hashes."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and per row the number of words before it (and the total)."""
    inside = classes[data].astype(bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    split = edges[inside[edges] & inside[edges - 1]]
    begins[split] = True
    stops[split] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sequence_hashes(_byte_values()[data], starts, ends)


def hashed_words(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED, lower: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each row and the total)."""
    starts, ends, first = word_spans(data, offsets, classes)
    return word_hashes(LOWER[data] if lower else data, starts, ends), first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the numbers of words before the rows."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by the keys, with the starts of the groups and the end."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        begins = np.ones(table.num_rows, dtype=bool)
        begins[1:] = False
        for key in keys:
            column = table[key].to_numpy()
            begins[1:] |= column[1:] != column[:-1]
        return np.append(np.flatnonzero(begins), table.num_rows)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < 8 << 20:
            continue
        table = pa.Table.from_batches(held, schema=batch.schema)
        edges = cut(table)
        if len(edges) > 2:
            yield table.slice(0, edges[-2]), edges[:-1]
            held = table.slice(edges[-2]).combine_chunks().to_batches()
        size = 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def word_totals(parts: Iterator[np.ndarray], held: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(word, n) of the hashes of all parts: counts are exact once the rows of a word are added up.

    Counts of parts are merged here until there are more than ``held`` different words.
    """
    words, counts, size = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        return word, np.bincount(at, weights=np.concatenate(counts), minlength=len(word)).astype(np.int64)

    def rows(word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(word), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[s : s + 50_000].view(np.int64)), pa.array(n[s : s + 50_000])], ["word", "n"])

    for part in parts:
        word, n = np.unique(part, return_counts=True)
        words.append(word)
        counts.append(n)
        size += len(word)
        if size > 2 * held:
            word, n = merged()
            if len(word) > held:
                yield from rows(word, n)
                word, n = word[:0], n[:0]
            words, counts, size = [word], [n], len(word)
    if words:
        yield from rows(*merged())


def heavy_words(counted: DataFrame, share: float, stage: str) -> tuple[np.ndarray, int]:
    """Sorted hashes of the words with at least ``share`` of all in (word, n), at most 1 / share, and the sum of all."""
    found = write_stage(counted.groupBy("word").agg(F.sum("n").alias("n")), stage)
    total = found.agg(F.sum("n")).first()[0] or 0
    heavy = found.where(F.col("n") >= share * total).select("word").collect()
    return np.sort(np.array([r[0] for r in heavy], dtype=np.int64).view(np.uint64)), total


def words_with_share(counted: DataFrame, share: float, stage: str) -> np.ndarray:
    return heavy_words(counted, share, stage)[0]
