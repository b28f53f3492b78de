"""A hierarchical Pitman-Yor language model of two levels, sampled over Spark partitions.

A restaurant stands for the words after one context word, and every context word has one. Its
dishes are words, and every table it opens sends a customer to the restaurant all contexts share,
whose base is uniform over the vocabulary and one unknown word.

One row holds many words with their counts in all restaurants, so a word's seating is sampled
where the row is. A Gibbs sweep takes the customers of a dish out, draws the number of their tables given
the tables of all others (exactly up to ``EXACT`` customers, beyond that in small leaps), and
then does the same for the word in the shared restaurant. Tables of the other dishes enter by
their totals, which Spark sums after each sweep. Totals of contexts that make up at least ``CONTEXT_SHARE``
of the training tokens (at most 1 / CONTEXT_SHARE) are broadcast; those of all others, the rare
ones, are summed where their context hashes to, and each row gets the sums it asked for back. A
single customer always has one table, so only pairs that occur twice or more are asked for in a sweep.
The seating is written after each sweep, and the next one begins there. Draws are hashes of word,
restaurant and sweep: a lost partition samples the same seating again. Predictive probabilities are
averaged over the sweeps after the burn-in, for which a row keeps the sum of its seated customers
less their discounts.

To score, each task groups its texts' tokens by word; Spark brings them to the words' rows,
which have all that the probabilities of trained pairs need, and returns sums per text. Pairs of a rare
context that training never saw go on to where the totals of their context are. Words are known by
64 bits of hash. Only totals per frequent context (bounded) reach the driver or are broadcast.

Null texts are empty; an empty text is its end token. Texts are scored whole. Rows without
doc_id are training rows. Repeated rows count as often as they occur. An empty table gives no
rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import write_stage
from slotweave.llm.text_arrays import SPACED, hashed_words, heavy_words, mix, text_pieces, word_totals
from slotweave.session import device_partitions, drop_stages, free_shuffles, stages_made

CONTEXT_SHARE = 2e-5
BURN_IN, SAMPLES = 2, 2
EXACT = 48
CHUNK_TOKENS = 500_000
CHUNK_ROWS = 60_000
SUMS_HELD = 1_000_000
#: Words are dealt out to packs and rare contexts to parts, by hash; so many training tokens make one of them.
PACK_TOKENS, PART_TOKENS = 1_000_000, 2_000_000
UNSEEN_HELD = 200_000
MERGED_PAIRS = 1_000_000
#: Texts are scored in so many turns, each for its share of the packs: the uses of all words at once take twice the disk.
TURNS = 2
USES_HELD = 2 << 20
END = np.uint64(0x5851F42D4C957F2D)
_COUNT = np.dtype([("ctx", "<u2"), ("n", "<u4")])
_USE = np.dtype([("ctx", "<u2"), ("doc", "<u2"), ("n", "u1")])
#: The same for rare contexts, which have no number.
_PAIR = np.dtype([("ctx", "<u8"), ("n", "<u4")])
_PAIR_USE = np.dtype([("ctx", "<u8"), ("doc", "<u2"), ("n", "u1")])
#: A word of a bundle, with the sizes of its lists for frequent and for rare contexts.
_HEAD = np.dtype([("word", "<u8"), ("often", "<u4"), ("rare", "<u4")])
#: A pair in its context's part: place of the word in its pack, context, customers.
_RARE = np.dtype([("at", "<u4"), ("ctx", "<u8"), ("n", "<u4")])
#: A pair with several customers between sweeps, with its context's tables of single customers and other tables.
_MANY = np.dtype([*_RARE.descr, ("ones", "<u4"), ("more", "<u4"), ("taken", "<f8")])
_SENT = np.dtype([("ctx", "<u8"), ("tables", "<u4")])
_SCORED = np.dtype([("ctx", "<u8"), ("p", "<f8")])


class Totals(NamedTuple):
    """What all partitions share: contexts, counts, and per sweep the tables of every restaurant."""

    contexts: np.ndarray
    tokens: int
    types: int
    customers: np.ndarray
    discounts: tuple[float, float]
    strengths: tuple[float, float]
    tables: tuple[np.ndarray, ...]
    shared: tuple[tuple[float, float], ...]
    packs: int = 1
    parts: int = 1


class Rare(NamedTuple):
    """Pairs of rare contexts with several customers, and per word its number of pairs with a single one."""

    at: np.ndarray
    ctx: np.ndarray
    n: np.ndarray
    all_tables: np.ndarray
    ones: np.ndarray


class Chunk(NamedTuple):
    tokens: np.ndarray
    row: np.ndarray
    ids: list
    held_out: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch], training_only: bool) -> Iterator[Chunk]:
    """Tokens of many texts: hash and number of the text."""
    words, sizes, ids, held = [], [], [], []
    total = 0

    def build() -> Chunk:
        counts = np.concatenate(sizes)
        row = np.repeat(np.arange(len(counts)), counts + 1)
        tokens = np.full(len(row), END)
        ends = np.zeros(len(row), dtype=bool)
        ends[np.cumsum(counts + 1) - 1] = True
        tokens[~ends] = np.concatenate(words)
        return Chunk(tokens, row, list(ids), np.array(held, dtype=bool))

    for batch in batches:
        for a, b, data, offsets in text_pieces(batch.column("text")):
            # A part of a piece must not hold more texts than a chunk can number.
            found, first = hashed_words(data, offsets, SPACED, lower=True)
            out = batch.column("held_out").slice(a, b - a).to_pylist()
            name = batch.column("doc_id").slice(a, b - a).to_pylist()
            for s in range(0, b - a, CHUNK_ROWS):
                e = min(s + CHUNK_ROWS, b - a)
                if ids and (len(ids) + e - s > CHUNK_ROWS or total > CHUNK_TOKENS):
                    yield build()
                    words, sizes, ids, held, total = [], [], [], [], 0
                part, count = found[first[s] : first[e]], np.diff(first[s : e + 1])
                mine = ~np.array(out[s:e], dtype=bool) if training_only else np.ones(e - s, dtype=bool)
                words.append(part if mine.all() else part[np.repeat(mine, count)])
                sizes.append(count[mine])
                ids += [x for x, m in zip(name[s:e], mine) if m]
                held += [x for x, m in zip(out[s:e], mine) if m]
                total += len(words[-1])
    if ids:
        yield build()


def _restaurant(before: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Number of the context of each token; len(contexts) for the shared restaurant."""
    if not len(contexts):
        return np.zeros(len(before), dtype=np.int64)
    at = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
    return np.where(contexts[at] == before, at, len(contexts))


def _binary(records: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One value per slice of packed records."""
    offsets = (edges * records.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])


def _frequent(rows: DataFrame, share: float) -> tuple[np.ndarray, int]:
    def report(batches):
        yield from word_totals(chunk.tokens for chunk in _chunks(batches, True))

    return heavy_words(rows.mapInArrow(report, "word long, n long"), share, "contexts")


def find_contexts(rows: DataFrame, share: float) -> np.ndarray:
    """Words with at least the share of all training tokens, counted exactly: at most 1 / share."""
    return _frequent(rows, share)[0]


def _pairs(chunk: Chunk, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, the number of each token's pair (word, word before), and the words' restaurants."""
    word, code = np.unique(chunk.tokens, return_inverse=True)
    before = np.empty_like(code)
    # A text's first word follows the end of the text before it.
    before[:1], before[1:] = code[-1:], code[:-1]
    return word, code * len(word) + before, _restaurant(word, contexts)


def part_of(ctx: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ctx, 5) % np.uint64(parts)).astype(np.int32)


def pack_of(word: np.ndarray, packs: int) -> np.ndarray:
    """The pack of each word."""
    return (mix(word, 6) % np.uint64(packs)).astype(np.int64)


def _bundle(*arrays: np.ndarray) -> bytes:
    """Arrays of records as one value, byte by byte of the records: what repeats lies together."""
    bodies = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return np.array([len(a) for a in arrays], dtype="<i8").tobytes() + b"".join(bodies)


def _unbundle(body: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, np.frombuffer(body, dtype="<i8", count=len(kinds)).tolist()):
        raw = np.frombuffer(body, dtype=np.uint8, count=size * kind.itemsize, offset=at).reshape(kind.itemsize, size)
        out.append(raw.T.copy().view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def _by_pack(word: np.ndarray, packs: int, *lists: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """A bundle per pack: its words with the sizes of their two lists, and the lists, given as (number of the word, record)."""
    pack = pack_of(word, packs)
    order = np.argsort(pack, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    starts = np.flatnonzero(np.append(True, np.diff(pack[order]) != 0))
    ends = np.append(starts[1:], len(word))
    heads, sorted_lists = np.zeros(len(word), dtype=_HEAD), []
    heads["word"] = word[order]
    for name, (code, records) in zip(("often", "rare"), lists):
        at = place[code]
        by_word = np.argsort(at, kind="stable")
        heads[name] = np.bincount(at, minlength=len(word))
        sorted_lists.append((records[by_word], np.append(0, np.cumsum(heads[name], dtype=np.int64))))
    for s, e in zip(starts.tolist(), ends.tolist()):
        yield int(pack[order[s]]), _bundle(heads[s:e], *(records[edges[s] : edges[e]] for records, edges in sorted_lists))


def count_words(rows: DataFrame, contexts: np.ndarray, packs: int = 1, parts: int = 1) -> DataFrame:
    """Every training word with its counts in frequent restaurants, many words to a row (kind 6), those that occur
    twice or more once more as the sweeps need them (kind 0), and the pairs of rare contexts, a row per pack and part (kind 1)."""
    return _counted(rows, contexts, packs, parts).where("ctx is null").select(*_ROW_SCHEMA.names)


def _counted(rows: DataFrame, contexts: np.ndarray, packs: int, parts: int) -> DataFrame:
    """The rows of ``count_words``, and per frequent restaurant: customers, dishes, dishes with one and with two
    customers; then the same of the shared one with one table for every dish; at last types, tokens, dishes of rare
    restaurants with one and with two customers, and types that occur once."""
    k = len(contexts)

    def split(batches):
        for chunk in _chunks(batches, True):
            word, pair, restaurant = _pairs(chunk, contexts)
            if not len(word):
                continue
            pair, n = np.unique(pair, return_counts=True)
            code, before = pair // len(word), pair % len(word)
            ctx = restaurant[before]
            often, rare = ctx < k, ctx >= k
            lists = (
                (code[often], _filled_records(_COUNT, ctx=ctx[often], n=n[often])),
                (code[rare], _filled_records(_PAIR, ctx=word[before[rare]], n=n[rare])),
            )
            found = list(_by_pack(word, packs, *lists))
            for s in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found[s : s + 64]]), pa.array([x for _, x in found[s : s + 64]], pa.binary())], ["pack", "body"])

    def merge(batches):
        out = np.zeros((k + 2, 5))
        current, held, size, limit = None, [], 0, MERGED_PAIRS
        for batch in batches:
            for pack, body in zip(batch.column("pack").to_pylist(), batch.column("body")):
                if pack != current:
                    if held:
                        yield from _pack_rows(current, _added(held), out, parts)
                    current, held, size, limit = pack, [], 0, MERGED_PAIRS
                heads, *lists = _unbundle(body.as_py(), _HEAD, _COUNT, _PAIR)
                held.append([(np.repeat(heads["word"], heads[name]), x["ctx"], x["n"].astype(np.int64)) for name, x in zip(("often", "rare"), lists)])
                size += sum(map(len, lists))
                if size > limit:
                    held, size = [_added(held)], 0
                    limit = max(MERGED_PAIRS, sum(len(x[0]) for x in held[0]))
        if held:
            yield from _pack_rows(current, _added(held), out, parts)
        yield _summed(out)

    found = rows.mapInArrow(split, "pack long, body binary").repartition(packs, "pack").sortWithinPartitions("pack")
    return write_stage(found.mapInArrow(merge, f"{_ROWS}, {_SUMMED}"), "word_counts")


def _added(held: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word, context and count of the pairs of two kinds, sorted, equal pairs added up."""
    out = []
    for parts in zip(*held):
        word, ctx, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ctx, word))
        word, ctx, n = word[order], ctx[order], n[order]
        begins = np.ones(len(word), dtype=bool)
        begins[1:] = (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])
        first = np.flatnonzero(begins)
        out.append((word[first], ctx[first], np.add.reduceat(n, first) if len(first) else n))
    return out


def _pack_rows(pack: int, pairs: list, out: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of a pack; words that occur twice or more are its first ones. Its sums are added to ``out``."""
    (w0, c0, n0), (w1, c1, n1) = pairs
    k = len(out) - 2
    word = np.unique(np.concatenate([w0, w1]))
    o0, o1 = np.searchsorted(word, w0), np.searchsorted(word, w1)
    total = (np.bincount(o0, weights=n0, minlength=len(word)) + np.bincount(o1, weights=n1, minlength=len(word))).astype(np.int64)
    order = np.argsort(total < 2, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    word, total, o0, o1 = word[order], total[order], place[o0], place[o1]
    by0, by1 = np.argsort(o0, kind="stable"), np.argsort(o1, kind="stable")
    o0, c0, n0, o1, c1, n1 = o0[by0], c0[by0].astype(np.int64), n0[by0], o1[by1], c1[by1], n1[by1]
    moved = int((total > 1).sum())
    ones = np.bincount(o0[n0 == 1], minlength=len(word)) + np.bincount(o1[n1 == 1], minlength=len(word))
    shared = np.bincount(o0, minlength=len(word)) + np.bincount(o1, minlength=len(word))
    for j, values in enumerate((n0, np.ones(len(n0)), n0 == 1, n0 == 2)):
        out[:k, j] += np.bincount(c0, weights=values, minlength=k)[:k]
    out[k, :4] += shared.sum(), len(word), (shared == 1).sum(), (shared == 2).sum()
    out[k + 1] += len(word), total.sum(), (n1 == 1).sum(), (n1 == 2).sum(), len(word) - moved
    counts = _filled_records(_COUNT, ctx=c0, n=np.minimum(n0, 0xFFFFFFFF))
    whole = {"word": pa.array(word.view(np.int64)), "n": pa.array(total), "counts": _binary(counts, np.searchsorted(o0, np.arange(len(word) + 1)))}
    yield _rows(pack, [-1], 6, [_packed(whole, len(word))], [None])
    many = n0 > 1
    swept = {
        "word": pa.array(word[:moved].view(np.int64)),
        "counts": _binary(counts[many], np.searchsorted(o0[many], np.arange(moved + 1))),
        "ones": pa.array(ones[:moved]),
    }
    yield _rows(pack, [-1], 0, [_packed(swept, moved)], [_bundle(np.zeros(0, dtype=_MANY))])
    records = _filled_records(_RARE, at=o1, ctx=c1, n=np.minimum(n1, 0xFFFFFFFF))
    yield from _dealt(pack, records, part_of(records["ctx"], parts), 1)


def _filled_records(kind: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(next(iter(columns.values()))), dtype=kind)
    for name, values in columns.items():
        out[name] = values
    return out


def _rows(pack, dst, kind: int, words: list, body: list) -> pa.RecordBatch:
    """Rows of one kind, with no sums."""
    size = len(dst)
    given = {
        "pack": pa.array(np.broadcast_to(np.asarray(pack, dtype=np.int64), size)),
        "dst": pa.array(np.asarray(dst, dtype=np.int32)),
        "kind": pa.array(np.full(size, kind, dtype=np.int32)),
        "words": pa.array(words, pa.binary()),
        "body": pa.array(body, pa.binary()),
    }
    return _filled(_ALL_SCHEMA, given, size)


def _bundles(records: np.ndarray, edges: np.ndarray) -> list[bytes]:
    return [_bundle(records[s:e]) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _dealt(pack: int, records: np.ndarray, part: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """A row per part that has records, in the order of the parts."""
    if len(records):
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        yield _rows(pack, part[first], kind, [None] * len(first), _bundles(records[order], np.append(first, len(part))))


def _uniform(word: np.ndarray, ctx: np.ndarray | int, salt: int) -> np.ndarray:
    """Numbers inside (0, 1) that depend on word, restaurant and salt only."""
    x = mix(word ^ mix(np.asarray(ctx).astype(np.uint64), 1000), 2000 + salt)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


@cache
def _log_stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: ways to seat c customers at t tables, up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        for t in range(1, c + 2):
            grow = c - discount * t
            old = out[c, t] + np.log(grow) if grow > 0 and t <= c else -np.inf
            out[c + 1, t] = np.logaddexp(out[c, t - 1], old)
    return out


def _poisson(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Draws from one uniform number by inversion, for large means from a normal."""
    normal = np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    small = mean < 12
    count, term = np.zeros(len(mean)), np.exp(-np.where(small, mean, 0.0))
    total = term.copy()
    for i in range(1, 40):
        above = u > total
        if not (above & small).any():
            break
        count += above
        term *= mean / i
        total += np.where(small, term, 0.0)
    return np.where(small, count, np.maximum(normal, 0))


def seat(word, ctx, n, weight, discount: float, salt: int) -> np.ndarray:
    """Tables of n customers of one dish, where a new table weighs ``weight`` (the base's share of new tables)."""
    tables = np.minimum(n, 1).astype(np.float64)
    stirling = _log_stirling(discount)
    first = np.minimum(n, EXACT)
    log_weight = np.log(np.maximum(weight, 1e-300))
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(2, EXACT + 2))
    u = _uniform(word, ctx, salt)
    for c, s, e in zip(range(2, EXACT + 1), cuts[:-1], cuts[1:]):
        for a in range(s, e, 200_000):
            mine = order[a : min(a + 200_000, e)]
            t = np.arange(1, c + 1)
            logs = stirling[c, 1 : c + 1][None, :] + t[None, :] * log_weight[mine][:, None]
            share = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[mine] = 1 + (share < (u[mine] * share[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(n > EXACT)
    seated = np.full(len(many), float(EXACT))
    step = 0
    while len(many):
        left = n[many] - seated
        leap = np.minimum(left, np.maximum(1, np.floor(seated / 32)))
        p = weight[many] / (weight[many] + np.maximum(seated - discount * tables[many], 1e-9))
        u, v = _uniform(word[many], ctx[many], salt + 7 + 64 * step), _uniform(word[many], ctx[many], salt + 8 + 64 * step)
        tables[many] += np.minimum(_poisson(leap * p, u, v), leap)
        seated += leap
        more = seated < n[many]
        many, seated = many[more], seated[more]
        step += 1
    return tables


class Seating(NamedTuple):
    """Per entry of a context: its tables; per word: its customers and tables in the shared restaurant; per pair of ``Rare``: its tables."""

    tables: np.ndarray
    customers: np.ndarray
    shared_tables: np.ndarray
    rare_tables: np.ndarray


def first_seating(word: np.ndarray, owner: np.ndarray, ctx: np.ndarray, n: np.ndarray, k: int, rare: Rare | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of each word in the shared restaurant with one table for every dish."""
    customers = np.bincount(owner, weights=np.where(ctx < k, 1, n), minlength=len(word))
    if rare is not None:
        customers = customers + rare.ones + np.bincount(rare.at, minlength=len(word))
    return customers, np.minimum(customers, 1)


def sweep(word, owner, ctx, n, customers, tables, totals: Totals, number: int, rare: Rare | None = None) -> Seating:
    """The seating of whole words after one more sweep.

    ``word``, ``customers``, ``tables``: per word, as the sweep before left them; ``owner`` (number of the word),
    ``ctx`` and ``n``: per entry. ``totals`` has the tables of all restaurants after that sweep.
    """
    k = len(totals.contexts)
    (d0, d1), (s0, s1) = totals.discounts, totals.strengths
    inner = ctx < k
    direct = np.bincount(owner, weights=np.where(inner, 0, n), minlength=len(word))
    o, c, m = owner[inner], ctx[inner], n[inner]
    all_tables, (all_customers, all_shared) = totals.tables[number], totals.shared[number]
    shared = shared_probability(customers, tables, all_customers, all_shared, totals)
    t = seat(word[o], c, m, (s1 + d1 * all_tables[c]) * shared[o], d1, 100_000 * number + 1)
    customers, t_rare = direct + np.bincount(o, weights=t, minlength=len(word)), np.zeros(0)
    if rare is not None:
        t_rare = seat(word[rare.at], rare.ctx, rare.n, (s1 + d1 * rare.all_tables) * shared[rare.at], d1, 100_000 * number + 1)
        customers = customers + rare.ones + np.bincount(rare.at, weights=t_rare, minlength=len(word))
    weight = np.full(len(word), (s0 + d0 * all_shared) / (totals.types + 1))
    tables = seat(word, np.full(len(word), k), customers.astype(np.int64), weight, d0, 100_000 * number + 50_001)
    return Seating(t, customers, tables, t_rare)


def shared_probability(customers, tables, all_customers: float, all_tables: float, totals: Totals):
    d0, s0 = totals.discounts[0], totals.strengths[0]
    return (np.maximum(customers - d0 * tables, 0) + (s0 + d0 * all_tables) / (totals.types + 1)) / (s0 + all_customers)


def _records(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed records of all values, null ones without any, and how many each value has."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = whole.fill_null(b"")
    if not len(whole):
        return np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
    _, offsets, data = whole.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1]
    raw = b"" if data is None else data.slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes()
    return np.frombuffer(raw, dtype=kind), np.diff(edges) // kind.itemsize


def _entries(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    records, sizes = _records(table.column("counts"), _COUNT)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return table.column("word").to_numpy().view(np.uint64), owner, records["ctx"].astype(np.int64), records["n"].astype(np.int64)


#: A row holds many words, since a row per word costs Spark more than the sweep itself: this many to a batch of
#: its value, and this many are swept at once.
PACK_WORDS = 20_000
SWEPT_WORDS = 100_000
_STATE = "word long, n long, counts binary, customers double, tables double, seated binary, seen array<double>, rare binary"
_ROWS = "pack long, dst int, kind int, words binary, body binary"
_SUMMED = "ctx long, a double, b double, c double, d double, e double"
_SUMMED_SCHEMA = pa.schema([("ctx", pa.int64()), *[(name, pa.float64()) for name in "abcde"]])
_WORD_SCHEMA = pa.schema(
    [
        ("word", pa.int64()),
        ("n", pa.int64()),
        ("counts", pa.binary()),
        ("ones", pa.int64()),
        ("customers", pa.float64()),
        ("tables", pa.float64()),
        ("seated", pa.binary()),
        ("seen", pa.list_(pa.float64())),
    ]
)
_ROW_SCHEMA = pa.schema([("pack", pa.int64()), ("dst", pa.int32()), ("kind", pa.int32()), ("words", pa.binary()), ("body", pa.binary())])
_ALL_SCHEMA = pa.schema([*_ROW_SCHEMA, *_SUMMED_SCHEMA])


def _filled(schema: pa.Schema, given: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def _packed(words: dict, rows: int) -> bytes:
    """Columns of words as one value."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _WORD_SCHEMA) as writer:
        writer.write_table(pa.Table.from_batches([_filled(_WORD_SCHEMA, words, rows)]), max_chunksize=PACK_WORDS)
    return sink.getvalue()


def _unpacked(words: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(words) as reader:
        table = reader.read_all().combine_chunks()
    return table.to_batches()[0] if len(table) else _filled(_WORD_SCHEMA, {}, 0)


def _summed(out: np.ndarray) -> pa.RecordBatch:
    """Sums per restaurant, in rows that are of no pack."""
    some = np.flatnonzero(out.any(axis=1))
    return _filled(_ALL_SCHEMA, {"ctx": pa.array(some), **{name: pa.array(out[some, j]) for j, name in enumerate("abcde")}}, len(some))


def _bodies(table: pa.Table, kind: int, records: np.dtype) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a kind by pack and part, their records, and how many each has."""
    rows = table.filter(pa.compute.equal(table["kind"], kind)).sort_by([("pack", "ascending"), ("dst", "ascending")])
    return rows, *_joined(rows["body"].to_pylist(), records)


def _joined(bodies: list[bytes], records: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    found = [_unbundle(body, records)[0] for body in bodies]
    return np.concatenate([np.zeros(0, dtype=records), *found]), np.array([len(x) for x in found], dtype=np.int64)


def _first_reply(table: pa.Table) -> pa.Table:
    """For the rare pairs of a part: those with several customers, and their contexts' tables with one table for every dish."""
    rows, pairs, sizes = _bodies(table, 1, _RARE)
    _, at = np.unique(pairs["ctx"], return_inverse=True)
    many = pairs["n"] > 1
    ones, more = np.bincount(at, weights=~many), np.bincount(at, weights=many)
    own = at[many]
    found = _filled_records(_MANY, at=pairs["at"][many], ctx=pairs["ctx"][many], n=pairs["n"][many], ones=ones[own], more=more[own])
    edges = np.append(0, np.cumsum(many))[np.append(0, np.cumsum(sizes))]
    return _replied(rows, 2, _bundles(found, edges))


def _next_reply(table: pa.Table) -> pa.Table:
    """For the tables that packs sent to a part: all tables of the same contexts."""
    rows, sent, sizes = _bodies(table, 2, _SENT)
    _, at = np.unique(sent["ctx"], return_inverse=True)
    return _replied(rows, 2, _bundles(np.bincount(at, weights=sent["tables"]).astype("<u4")[at], np.append(0, np.cumsum(sizes))))


def _replied(rows: pa.Table, kind: int, body: list) -> pa.Table:
    out = _rows(rows["pack"].to_numpy(), rows["dst"].to_numpy(), kind, [None] * len(rows), body)
    return pa.Table.from_batches([out.select(_ROW_SCHEMA.names)])


def _sums(samples: int) -> np.dtype:
    """Customers of a context, and its tables in every sample."""
    return np.dtype([("customers", "<u4"), ("tables", "<u4", (samples,))])


def _named(samples: int) -> np.dtype:
    return np.dtype([("ctx", "<u8"), *_sums(samples).descr])


def _restaurants(table: pa.Table, samples: int) -> pa.Table:
    """Customers and tables of the contexts of a part: for each of its rare pairs (kind 2) and by context (kind 3)."""
    rows, pairs, sizes = _bodies(table, 1, _RARE)
    names, at = np.unique(pairs["ctx"], return_inverse=True)
    found = np.zeros(len(names), dtype=_named(samples))
    found["ctx"], found["customers"] = names, np.bincount(at, weights=pairs["n"], minlength=len(names))
    found["tables"] = np.bincount(at, weights=pairs["n"] == 1, minlength=len(names))[:, None]
    for s in range(samples):
        _, sent, _ = _bodies(table, 4 + s, _SENT)
        own = np.searchsorted(names, sent["ctx"])
        found["tables"][:, s] += np.bincount(own, weights=sent["tables"], minlength=len(names)).astype(np.uint32)
    replied = _filled_records(_sums(samples), customers=found["customers"][at], tables=found["tables"][at])
    own = _rows(-1, table["dst"].to_numpy()[:1], 3, [None], [_bundle(found)]).select(_ROW_SCHEMA.names)
    return pa.concat_tables([_replied(rows, 2, _bundles(replied, np.append(0, np.cumsum(sizes)))), pa.Table.from_batches([own])])


def _swept(table: pa.Table, totals: Totals, number: int, kept: bool) -> pa.Table:
    """One sweep over a pack: its row as it leaves it, the tables of rare pairs for their contexts, and sums per restaurant."""
    k = len(totals.contexts)
    d1 = totals.discounts[1]
    out = np.zeros((k + 2, 5))
    own = table.filter(pa.compute.equal(table["kind"], 0))
    batch, many = _unpacked(own["words"][0].as_py()), _unbundle(own["body"][0].as_py(), _MANY)[0]
    if number == 0:
        many = _bodies(table, 2, _MANY)[1]
    else:
        many["more"] = _bodies(table, 2, np.dtype("<u4"))[1]
    word, owner, ctx, n = _entries(batch)
    ones, at = batch.column("ones").to_numpy(), many["at"].astype(np.int64)
    rare = Rare(at, many["ctx"], many["n"].astype(np.int64), many["ones"].astype(np.float64) + many["more"], ones)
    if number == 0:
        customers, tables = first_seating(word, owner, ctx, n, k, rare)
    else:
        customers, tables = (batch.column(name).to_numpy() for name in ("customers", "tables"))
    after = Seating(np.zeros(len(n)), np.zeros(len(word)), np.zeros(len(word)), np.zeros(len(many)))
    for s in range(0, len(word), SWEPT_WORDS):
        e = min(s + SWEPT_WORDS, len(word))
        a, b = np.searchsorted(owner, [s, e])
        mine = np.flatnonzero((at >= s) & (at < e))
        part = Rare(at[mine] - s, rare.ctx[mine], rare.n[mine], rare.all_tables[mine], ones[s:e])
        found = sweep(word[s:e], owner[a:b] - s, ctx[a:b], n[a:b], customers[s:e], tables[s:e], totals, number, part)
        after.tables[a:b], after.customers[s:e], after.shared_tables[s:e], after.rare_tables[mine] = found
    seated, seen = batch.column("seated"), batch.column("seen")
    if kept:
        before, _ = _records(seated, np.dtype("<f8"))
        mine = np.maximum(n - d1 * after.tables, 0) + (before if len(before) else 0)
        seated = _binary(mine, np.searchsorted(owner, np.arange(len(word) + 1)))
        many["taken"] += np.maximum(rare.n - d1 * after.rare_tables, 0)
        pairs = np.column_stack([after.customers, after.shared_tables])
        earlier = seen.flatten().to_numpy(zero_copy_only=False)
        if len(earlier):
            pairs = np.hstack([earlier.reshape(len(word), -1), pairs])
        seen = pa.ListArray.from_arrays(pa.array(np.arange(len(word) + 1, dtype=np.int32) * pairs.shape[1]), pa.array(pairs.ravel()))
    words = {name: batch.column(name) for name in ("word", "counts", "ones")}
    words |= {"customers": pa.array(after.customers), "tables": pa.array(after.shared_tables), "seated": seated, "seen": seen}
    out[:k, 4] += np.bincount(ctx, weights=after.tables, minlength=k)[:k]
    out[k, 0] += after.customers.sum()
    out[k, 4] += after.shared_tables.sum()
    pack = table["pack"][0].as_py()
    sent = _dealt(pack, _filled_records(_SENT, ctx=many["ctx"], tables=after.rare_tables), part_of(many["ctx"], totals.parts), 2)
    return pa.Table.from_batches([_rows(pack, [-1], 0, [_packed(words, len(word))], [_bundle(many)]), *sent, _summed(out)])


def _finished(whole: bytes, words: bytes, many: np.ndarray, pairs: np.ndarray, sums: np.ndarray, totals: Totals, burn_in: int, samples: int) -> pa.Table:
    """A row per word of a pack, with the averaged probabilities of its rare pairs; ``sums`` are of the pairs' contexts."""
    batch, swept = _unpacked(whole), _unpacked(words)
    size, moved = batch.num_rows, swept.num_rows
    _, owner, _, n = _entries(batch)
    at = pairs["at"].astype(np.int64)
    d1, s1 = totals.discounts[1], totals.strengths[1]
    # Single customers and words that occur once have one table in every sample.
    seated = np.full(len(n), samples * (1 - d1))
    seated[n > 1] = _records(swept.column("seated"), np.dtype("<f8"))[0]
    seen = np.ones((size, 2 * samples))
    seen[:moved] = swept.column("seen").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * samples)
    # Both are in the order of the parts, and in each of them in that of the counts.
    taken = np.full(len(pairs), samples * (1 - d1))
    taken[pairs["n"] > 1] = many["taken"]
    for s in range(samples):
        shared = shared_probability(seen[:, 2 * s], seen[:, 2 * s + 1], *totals.shared[burn_in + s + 1], totals)
        taken += (s1 + d1 * sums["tables"][:, s]) * shared[at]
    order = np.lexsort((pairs["ctx"], at))
    p = taken / (samples * (s1 + sums["customers"]))
    edges = np.arange(size + 1)
    columns = {
        "word": batch.column("word"),
        "n": batch.column("n"),
        "counts": batch.column("counts"),
        "customers": pa.array(seen[:, -2]),
        "tables": pa.array(seen[:, -1]),
        "seated": _binary(seated, np.searchsorted(owner, edges)),
        "seen": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32) * 2 * samples), pa.array(seen.ravel())),
        "rare": _binary(_filled_records(_SCORED, ctx=pairs["ctx"][order], p=p[order]), np.searchsorted(at[order], edges)),
    }
    return pa.table(columns)


def _train(rows: DataFrame, share: float, burn_in: int, samples: int) -> tuple[DataFrame, DataFrame, Totals]:
    spark = rows.sparkSession
    earlier = stages_made()
    contexts, seen_tokens = _frequent(rows, share)
    drop_stages(spark, earlier)
    packs, parts = (max(device_partitions(spark), 1 + int(seen_tokens) // size) for size in (PACK_TOKENS, PART_TOKENS))
    counts = _counted(rows, contexts, packs, parts)
    k = len(contexts)

    def collect(found: DataFrame) -> np.ndarray:
        """Bounded: a row per frequent context."""
        out = np.zeros((k + 2, 5))
        for ctx, *values in found.where("ctx is not null").groupBy("ctx").sum("a", "b", "c", "d", "e").collect():
            out[ctx] = values
        return out

    start = collect(counts)
    free_shuffles(spark)
    counts = counts.where("ctx is null").select(*_ROW_SCHEMA.names)
    types, tokens, single, double, still = start[k + 1]
    ones, twos = start[:k, 2].sum() + single, start[:k, 3].sum() + double
    d1 = float(np.clip(ones / max(1.0, ones + 2 * twos), 0.05, 0.95))
    d0 = float(np.clip(start[k, 2] / max(1.0, start[k, 2] + 2 * start[k, 3]), 0.05, 0.95))
    totals = Totals(contexts, int(tokens), int(types), start[:k, 0], (d0, d1), (1.0, 1.0), (start[:k, 1],), ((start[k, 0], float(types)),), packs, parts)
    def swept(shared, number: int, kept: bool):
        return lambda table: _swept(table, shared.value, number, kept)

    state, rare = counts.where("kind = 0"), counts.where("kind = 1")
    replies, sampled = rare.groupBy("dst").applyInArrow(_first_reply, _ROWS), rare
    for number in range(burn_in + samples):
        kept = number >= burn_in
        run = swept(spark.sparkContext.broadcast(totals), number, kept)
        written = write_stage(state.unionByName(replies).groupBy("pack").applyInArrow(run, f"{_ROWS}, {_SUMMED}"), "seating")
        found = collect(written)
        written = written.where("ctx is null").select(*_ROW_SCHEMA.names)
        state, sent = written.where("kind = 0"), written.where("kind = 2")
        replies = sent.groupBy("dst").applyInArrow(_next_reply, _ROWS)
        if kept:
            sampled = sampled.unionByName(sent.withColumn("kind", F.lit(4 + number - burn_in)))
        # Dishes with a single customer and words that occur once are not swept: they have one table.
        totals = totals._replace(tables=(*totals.tables, start[:k, 2] + found[:k, 4]), shared=(*totals.shared, (still + found[k, 0], still + found[k, 4])))
        if not kept:
            drop_stages(spark, earlier + 1, newest=1)
        free_shuffles(spark)
    restaurants = write_stage(sampled.groupBy("dst").applyInArrow(lambda table: _restaurants(table, samples), _ROWS), "restaurants")
    drop_stages(spark, earlier + 1, newest=2)
    free_shuffles(spark)
    whole = counts.where("kind in (1, 6)").unionByName(state).unionByName(restaurants.where("kind = 2"))
    return whole, restaurants.where("kind = 3"), totals


def train(rows: DataFrame, share: float, burn_in: int, samples: int) -> tuple[DataFrame, Totals]:
    """All words with their counts and what the averaged samples need, and the totals after every sweep."""
    packs, _, totals = _train(rows, share, burn_in, samples)
    shared = rows.sparkSession.sparkContext.broadcast(totals)

    def finish(table):
        whole, state = (table.filter(pa.compute.equal(table["kind"], kind)) for kind in (6, 0))
        many = _unbundle(state["body"][0].as_py(), _MANY)[0]
        pairs, sums = (_bodies(table, kind, records)[1] for kind, records in ((1, _RARE), (2, _sums(samples))))
        return _finished(whole["words"][0].as_py(), state["words"][0].as_py(), many, pairs, sums, shared.value, burn_in, samples)

    return packs.groupBy("pack").applyInArrow(finish, _STATE), totals


def _uses(rows: DataFrame, contexts: np.ndarray, packs: int, turn: int) -> DataFrame:
    """(pack, kind, chunk, body) of a turn's packs: where the words of a chunk are used (kind 7); one row more per chunk is about its texts (kind 8)."""
    k = len(contexts)

    def split(batches):
        part = TaskContext.get().partitionId() << 40
        for number, chunk in enumerate(_chunks(batches, False)):
            docs = len(chunk.ids)
            # A chunk's name ends in its number of texts.
            name = part | number << 16 | docs
            word, pair, restaurant = _pairs(chunk, contexts)
            mine = (pack_of(word, packs) % TURNS == turn)[pair // len(word)]
            key, n = np.unique(pair[mine] * docs + chunk.row[mine], return_counts=True)
            # Counts above 255 take several records.
            pieces = -(-n // 255)
            key, at = np.repeat(key, pieces), np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.minimum(np.repeat(n, pieces) - 255 * at, 255)
            doc, key = (key % docs).astype(np.uint16), key // docs
            code, before = (key // len(word)).astype(np.int32), (key % len(word)).astype(np.int32)
            ctx = restaurant[before]
            often, rare = ctx < k, ctx >= k
            del key, at, pieces, pair
            lists = (
                (code[often], _filled_records(_USE, ctx=ctx[often], doc=doc[often], n=n[often])),
                (code[rare], _filled_records(_PAIR_USE, ctx=word[before[rare]], doc=doc[rare], n=n[rare])),
            )
            about = pa.table({"doc_id": chunk.ids, "held_out": chunk.held_out, "n_tokens": np.bincount(chunk.row, minlength=docs)}, schema=_ABOUT)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, _ABOUT) as writer:
                writer.write_table(about)
            found = [(x, 7, y) for x, y in _by_pack(word, packs, *lists) if x % TURNS == turn]
            own = int(pack_of(np.array([name], dtype=np.uint64), packs)[0])
            if own % TURNS == turn:
                found.append((own, 8, sink.getvalue()))
            for s in range(0, len(found), 64):
                pack, kind, body = zip(*found[s : s + 64])
                arrays = [pa.array(pack, pa.int64()), pa.array(kind, pa.int32()), pa.array([name] * len(pack), pa.int64()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["pack", "kind", "chunk", "body"])

    return rows.mapInArrow(split, "pack long, kind int, chunk long, body binary")


_ABOUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())])
_SUMS = np.dtype([("doc", "<u2"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def _probabilities(table: pa.Table, totals: Totals, burn_in: int):
    """Of the words of a table: entry keys (word number, context), their averaged probabilities, and those after unseen contexts."""
    k = len(totals.contexts)
    word, owner, ctx, n = _entries(table)
    inner = ctx < k
    o, c = owner[inner], ctx[inner]
    (_, d1), (_, s1) = totals.discounts, totals.strengths
    samples = len(totals.shared) - 1 - burn_in
    seen = np.zeros((len(word), 2 * samples))
    known = table.column("n").to_numpy(zero_copy_only=False).astype(np.float64) > 0
    pairs = table.column("seen").combine_chunks() if isinstance(table.column("seen"), pa.ChunkedArray) else table.column("seen")
    seen[known] = pairs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * samples)
    taken = _records(table.column("seated"), np.dtype("<f8"))[0].copy()
    shared_by_sample = []
    for at in range(samples):
        after, (customers, tables) = totals.tables[burn_in + at + 1], totals.shared[burn_in + at + 1]
        shared = shared_probability(seen[:, 2 * at], seen[:, 2 * at + 1], customers, tables, totals)
        shared_by_sample.append(shared)
        taken += (s1 + d1 * after[c]) * shared[o]
    return o * k + c, taken / (samples * (s1 + totals.customers[c])), np.array(shared_by_sample)


def _unseen(samples: int) -> np.dtype:
    """A use of a pair that training never saw, after a rare context, with the shared probabilities of its word."""
    return np.dtype([("ctx", "<u8"), ("chunk", "<i8"), ("doc", "<u2"), ("n", "u1"), ("p", "<f8", (samples,))])


def _after_rare(table: pa.Table, totals: Totals, samples: int) -> pa.Table:
    """Sums per text of the unseen pairs whose contexts belong to a part."""
    (_, d1), (_, s1) = totals.discounts, totals.strengths
    known = _bodies(table, 3, _named(samples))[1]
    uses = _bodies(table, 5, _unseen(samples))[1]
    back_off = np.ones((len(uses), samples))
    if len(known):
        at = np.minimum(np.searchsorted(known["ctx"], uses["ctx"]), len(known) - 1)
        found = known["ctx"][at] == uses["ctx"]
        mine = known[at[found]]
        back_off[found] = (s1 + d1 * mine["tables"]) / (s1 + mine["customers"].astype(np.float64))[:, None]
    value = uses["n"] * np.log10((back_off * uses["p"]).mean(axis=1))
    chunk, number = np.unique(uses["chunk"], return_inverse=True)
    text, own = np.unique(number << 16 | uses["doc"], return_inverse=True)
    records = _filled_records(_SUMS, doc=text & 0xFFFF, score=np.bincount(own, weights=value, minlength=len(text)))
    first = np.searchsorted(text >> 16, np.arange(len(chunk)))
    return pa.table({"chunk": chunk, "about": np.zeros(len(chunk), dtype=bool), "sums": _binary(records, np.append(first, len(records)))})


def _pair_key(word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(ctx ^ mix(word, 3), 4)


def score(rows: DataFrame, share: float = CONTEXT_SHARE, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of (doc_id, text)."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    packs, restaurants, totals = _train(rows, share, burn_in, samples)
    k = len(totals.contexts)
    shared = rows.sparkSession.sparkContext.broadcast(totals)
    kinds = pa.schema([("chunk", pa.int64()), ("about", pa.bool_()), ("sums", pa.binary()), ("dst", pa.int32())])

    def add(batches):
        totals = shared.value
        (d0, d1), (s0, s1) = totals.discounts, totals.strengths
        kept = [totals.tables[i + 1] for i in range(burn_in, burn_in + samples)]
        # Share of the next level after each frequent context, per sample.
        back_off = np.array([(s1 + d1 * t) / (s1 + totals.customers) for t in kept]).reshape(samples, k)
        none = np.array([(s0 + d0 * t) / (s0 + c) / (totals.types + 1) for c, t in totals.shared[burn_in + 1 :]])
        sums, first, used = np.zeros((3, 1 << 16)), {}, 0
        unseen, unseen_size = [], 0
        current, model, state, held, size = None, None, {}, [], 0

        def built():
            """The probabilities of a pack's words and pairs; None without trained words."""
            if not state:
                return None
            many = _unbundle(state[0][0][2], _MANY)[0]
            by_part = {kind: [body for _, _, body in sorted(state.get(kind, []), key=lambda x: x[0])] for kind in (1, 2)}
            pairs, contexts = _joined(by_part[1], _RARE)[0], _joined(by_part[2], _sums(samples))[0]
            table = _finished(state[6][0][1], state[0][0][1], many, pairs, contexts, totals, burn_in, samples)
            table = table.take(np.argsort(table["word"].to_numpy().view(np.uint64))).combine_chunks()
            key, p, by_sample = _probabilities(table, totals, burn_in)
            word = table["word"].to_numpy().view(np.uint64)
            pairs, sizes = _records(table["rare"], _SCORED)
            names = _pair_key(np.repeat(word, sizes), pairs["ctx"])
            order = np.argsort(names)
            return word, table["n"].to_numpy(), by_sample, key, p, names[order], pairs[order]

        def put():
            """Adds up the uses held, all of words of the same pack."""
            nonlocal used, sums, unseen_size
            heads, often, rare = (np.concatenate(x) for x in zip(*(x for _, *x in held)))
            which_row = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            # Every chunk has a stretch of the sums, as long as it has texts.
            for name, *_ in held:
                if name not in first:
                    first[name] = used
                    used += name & 0xFFFF
            if used > sums.shape[1]:
                sums = np.hstack([sums, np.zeros((3, max(used, 2 * sums.shape[1]) - sums.shape[1]))])
            start = np.array([first[name] for name, *_ in held])[which_row]
            n, by_sample = np.zeros(len(heads)), np.repeat(none[:, None], len(heads), axis=1)
            own, trained = np.zeros(len(heads), dtype=np.int64), np.zeros(len(heads), dtype=bool)
            if model is not None:
                word, counts, p_shared, key, p, names, pairs = model
                own = np.minimum(np.searchsorted(word, heads["word"]), len(word) - 1)
                trained = word[own] == heads["word"]
                n[trained], by_sample[:, trained] = counts[own[trained]], p_shared[:, own[trained]]
            base = np.log10((n + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))

            def added(which, records, value):
                times = records["n"].astype(np.float64)
                place = start[which] + records["doc"]
                for total, x in zip(sums, (times * (n > 0)[which], times * base[which], times * np.log10(value))):
                    total[:used] += np.bincount(place, weights=x, minlength=used)

            which, ctx = np.repeat(np.arange(len(heads)), heads["often"]), often["ctx"].astype(np.int64)
            value = (back_off[:, ctx] * by_sample[:, which]).mean(axis=0)
            if model is not None and len(key):
                asked = own[which] * k + ctx
                at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                value = np.where((key[at] == asked) & trained[which], p[at], value)
            added(which, often, value)

            which = np.repeat(np.arange(len(heads)), heads["rare"])
            found, value = np.zeros(len(rare), dtype=bool), np.ones(len(rare))
            if model is not None and len(pairs):
                asked = _pair_key(heads["word"][which], rare["ctx"])
                at = np.minimum(np.searchsorted(names, asked), len(pairs) - 1)
                found = (names[at] == asked) & (pairs["ctx"][at] == rare["ctx"])
                value[found] = pairs["p"][at[found]]
            # Unseen pairs get their score where their context is.
            added(which, rare, value)
            rest, which = rare[~found], which[~found]
            more = _filled_records(_unseen(samples), ctx=rest["ctx"], doc=rest["doc"], n=rest["n"], p=by_sample[:, which].T)
            more["chunk"] = np.array([name for name, *_ in held], dtype=np.int64)[which_row[which]]
            unseen.append(more)
            unseen_size += len(more)

        def sent() -> pa.RecordBatch:
            records = np.concatenate(unseen)
            part = part_of(records["ctx"], totals.parts)
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            body = _bundles(records[order], np.append(starts, len(records)))
            return _filled(kinds, {"sums": pa.array(body, pa.binary()), "dst": pa.array(part[order][starts])}, len(starts))

        for batch in batches:
            columns = [batch.column(name) for name in ("pack", "kind", "dst", "chunk", "words", "body")]
            for pack, kind, dst, chunk, words, body in zip(*columns):
                pack, kind, body = pack.as_py(), kind.as_py(), body.as_py()
                if held and (pack != current or kind == 8 or size > USES_HELD):
                    put()
                    held, size = [], 0
                if pack != current:
                    current, model, state = pack, None, {}
                if kind == 8:
                    yield _filled(kinds, {"chunk": pa.array([chunk.as_py()]), "about": pa.array([True]), "sums": pa.array([body], pa.binary())}, 1)
                elif kind == 7:
                    if state:
                        model, state = built(), {}
                    held.append((chunk.as_py(), *_unbundle(body, _HEAD, _USE, _PAIR_USE)))
                    size += len(body)
                else:
                    state.setdefault(kind, []).append((dst.as_py(), words.as_py(), body))
                if unseen_size > UNSEEN_HELD:
                    yield sent()
                    unseen, unseen_size = [], 0
                if used > SUMS_HELD:
                    yield from _sum_rows(sums, first, kinds)
                    sums, first, used = np.zeros((3, 1 << 16)), {}, 0
        if held:
            put()
        if unseen_size:
            yield sent()
        yield from _sum_rows(sums, first, kinds)

    # The rows of a pack must come together, its state before its uses.
    turns = []
    for turn in range(TURNS):
        together = _uses(rows, totals.contexts, totals.packs, turn).unionByName(packs.where(F.col("pack") % TURNS == turn), allowMissingColumns=True)
        together = together.repartition("pack").sortWithinPartitions("pack", "kind")
        turns.append(write_stage(together.mapInArrow(add, "chunk long, about boolean, sums binary, dst int"), "text_sums"))
        free_shuffles(rows.sparkSession)
    parts = reduce(DataFrame.unionByName, turns)
    unseen = parts.where("dst is not null").select(F.lit(0).cast("long").alias("pack"), "dst", F.lit(5).alias("kind"), F.col("sums").alias("body"))
    later = unseen.unionByName(restaurants.select("pack", "dst", "kind", "body")).groupBy("dst")
    later = later.applyInArrow(lambda table: _after_rare(table, shared.value, samples), "chunk long, about boolean, sums binary")
    result = parts.where("dst is null").select("chunk", "about", "sums").unionByName(later)
    result = result.groupBy("chunk").applyInArrow(_texts, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _sum_rows(sums: np.ndarray, first: dict[int, int], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for name, start in first.items():
        values = sums[:, start : start + (name & 0xFFFF)]
        doc = np.flatnonzero(values[1])
        records = np.empty(len(doc), dtype=_SUMS)
        records["doc"], records["known"], records["base"], records["score"] = doc, values[0, doc], values[1, doc], values[2, doc]
        yield _filled(kinds, {"chunk": pa.array([name]), "about": pa.array([False]), "sums": pa.array([records.tobytes()], pa.binary())}, 1)


def _texts(chunk: pa.Table) -> pa.Table:
    """Rows of a chunk's texts, from its row about them and the sums of all tasks."""
    about = chunk.filter(chunk["about"])["sums"][0].as_py()
    texts = pa.ipc.open_stream(io.BytesIO(about)).read_all()
    known, base, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), np.zeros(len(texts))
    for part in chunk.filter(pa.compute.invert(chunk["about"]))["sums"].to_pylist():
        records = np.frombuffer(part, dtype=_SUMS)
        known[records["doc"]] += records["known"]
        base[records["doc"]] += records["base"]
        score[records["doc"]] += records["score"]
    return pa.table(
        {"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": texts["n_tokens"], "n_known": known, "base_score": base, "score": score}
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, texts, perplexity of the model and of the base."""
    return scored.groupBy("held_out").agg(
        F.count("*").alias("texts"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
