"""Benchmark decontamination by latent semantic retrieval and exact checks.

Words are lower-case runs of letters, digits and everything beyond ASCII. Texts are kept as the
places of the benchmark's words (nothing else can match), cut into passages of ``PASSAGE`` words.
Terms are the benchmark's words outside the most common ones; passages get TF-IDF vectors. A
randomised SVD, whose start holds the items' own vectors besides random ones, is summed over
Spark tasks; its right singular vectors are the latent space. Passages whose cosine with a
passage of an item reaches ``COSINE`` are candidates, and so are passages that hold at least half
of the ``LEAST_TERMS`` rarest terms of a passage of an item, whatever else stands there. A copy
of up to 64 words lies in two passages together, one of which thus holds half of them: no
verbatim copy is missed, however common its words are.

A candidate is a leak if the longest common subsequence of item and surroundings has at least
``SURE`` of the item's words, or at least ``LIKELY`` of them and the item's answer (its last
words, together) stands there too.

The benchmark is taken in blocks of bounded size, which alone are broadcast. Null texts and items
are empty and match nothing; items without words are skipped. Texts are read whole, passages
overlap by half. Repeated rows give repeated results. Empty tables give no rows. Only ``doc_id``,
``text`` and ``item_id`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.common import keyed, no_null_text, text_key, write_stage
from slotweave.llm.text_arrays import ALPHANUMERIC, hashed_words, text_pieces

PASSAGE, STEP = 64, 32
COMMON = 0.01
LEAST_TERMS = 8
COSINE = 0.45
SURE, LIKELY, ANSWER = 0.8, 0.6, 3
OVERSAMPLE = 32
BLOCK_WORDS = 20_000
BLOCK_ITEMS = 256


class Items(NamedTuple):
    """A block of the benchmark: sorted word hashes, and per item its words as places among them."""

    names: np.ndarray
    ids: list
    words: list[np.ndarray]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of items; only one is on the driver at a time."""
    ids, words, total = [], [], 0
    rows = benchmark.select("item_id", no_null_text("text").alias("text")).orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        data = text.encode()
        found, _ = hashed_words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), ALPHANUMERIC, lower=True)
        if not len(found):
            continue
        if ids and (total + len(found) > BLOCK_WORDS or len(ids) == BLOCK_ITEMS):
            yield _block(ids, words)
            ids, words, total = [], [], 0
        ids.append(item)
        words.append(found)
        total += len(found)
    if ids:
        yield _block(ids, words)


def _block(ids: list, words: list[np.ndarray]) -> Items:
    names = np.unique(np.concatenate(words))
    return Items(names, ids, [np.searchsorted(names, w) for w in words])


_CODED = "doc_id long, k1 long, k2 long, length int, word array<int>, place array<int>"


def coded_texts(documents: DataFrame, names: np.ndarray) -> DataFrame:
    """Per text its number of words, and the places of the benchmark's words."""
    text = no_null_text("text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(names)

    def code(batches):
        names = shared.value
        # A small table tells most other words apart before the search.
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(names >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("text")):
                words, first = hashed_words(data, offsets, ALPHANUMERIC, lower=True)
                at = np.flatnonzero(maybe[(words >> np.uint64(44)).astype(np.int64)])
                number = np.minimum(np.searchsorted(names, words[at]), len(names) - 1)
                known = names[number] == words[at]
                at, number = at[known], number[known]
                edges = np.searchsorted(at, first).astype(np.int32)
                place = at - np.repeat(first[:-1], np.diff(edges))
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (number, place)]
                kept = [batch.column(n).slice(a, b - a) for n in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first).astype(np.int32)), *lists], ["doc_id", "k1", "k2", "length", "word", "place"])

    return write_stage(rows.mapInArrow(code, _CODED), "coded_texts")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and the edges of the rows."""
    edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), edges


def _passages(length: np.ndarray, step: int) -> np.ndarray:
    """Number of passages of each text: full ones at every step, and what is left at the end."""
    return np.maximum(1, -(-(length - (PASSAGE - step)) // step))


def _in_passages(word, row, place, length, step: int):
    """(passage, word, count) of all passages, and the first passage of each row."""
    number = _passages(length, step)
    first = np.concatenate([[0], np.cumsum(number)])
    parts = []
    for back in range(PASSAGE // step):
        p = place // step - back
        good = (p >= 0) & (p < number[row])
        parts.append((first[row[good]] + p[good], word[good]))
    passage, term = (np.concatenate(x) for x in zip(*parts))
    width = int(word.max(initial=0)) + 1
    key, n = np.unique(passage * width + term, return_counts=True)
    return key // width, key % width, n, first


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def _read(batch: pa.RecordBatch, use: np.ndarray | None = None):
    word, edges = _flat(batch.column("word"))
    place, _ = _flat(batch.column("place"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
    if use is not None:
        kept = use[word]
        word, place, row = word[kept], place[kept], row[kept]
    return word, row, place, batch.column("length").to_numpy().astype(np.int64)


def document_frequencies(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages that hold each of the benchmark's words, and the number of passages."""

    def count(batches):
        held, total = np.zeros(size, dtype=np.int64), 0
        for batch in _sliced(batches):
            word, row, place, length = _read(batch)
            _, term, _, first = _in_passages(word, row, place, length, PASSAGE)
            held += np.bincount(term, minlength=size)
            total += int(first[-1])
        word = np.append(np.flatnonzero(held), -1)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.append(held[held > 0], total))], ["word", "n"])

    out, total = np.zeros(size, dtype=np.int64), 0
    for word, n in coded.mapInArrow(count, "word long, n long").groupBy("word").sum("n").collect():
        if word < 0:
            total = n
        else:
            out[word] = n
    return out, total


def _weights(term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(n)) * idf[term]).astype(np.float32)


def _project(passage, term, n, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, its sum of rows of ``weighted``, a space times IDF) for the passages that have terms; sorted input."""
    starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    out = np.empty((len(starts), weighted.shape[1]), dtype=np.float32)
    edges = np.append(starts, len(term))
    for s in range(0, len(starts), 512):
        e = min(s + 512, len(starts))
        rows = weighted[term[edges[s] : edges[e]]]
        more = np.flatnonzero(n[edges[s] : edges[e]] > 1)
        rows[more] *= (1 + np.log(n[edges[s] : edges[e]][more])).astype(np.float32)[:, None]
        np.add.reduceat(rows, starts[s:e] - edges[s], axis=0, out=out[s:e])
    return passage[starts], out


def _rarest(passage, term, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sought words: queries that seek each of ``size`` words as edges and numbers, and how many words each query needs."""
    query = np.cumsum(np.append(True, passage[1:] != passage[:-1])) - 1
    order = np.lexsort((term, -idf[term], query))
    query, term = query[order], term[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < LEAST_TERMS
    query, term = query[kept], term[kept]
    need = (np.bincount(query) + 1) // 2
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(size + 1)), query[order], need


def _covered(number, term, rows: int, sought) -> np.ndarray:
    """Whether each of ``rows`` passages holds enough of the words each query seeks; a passage has a word once."""
    edges, query, need = sought
    times = np.diff(edges)[term]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edges[term], times)
    held = np.bincount(np.repeat(number, times) * len(need) + query[at], minlength=rows * len(need))
    return held.reshape(rows, len(need)) >= need


class Space(NamedTuple):
    use: np.ndarray
    idf: np.ndarray
    vectors: np.ndarray
    strength: np.ndarray


def latent_space(coded: DataFrame, items: Items, seed: int = 3) -> Space:
    """Terms, their IDF, and right singular vectors of all passages' TF-IDF."""
    spark = coded.sparkSession
    size = len(items.names)
    held, total = document_frequencies(coded, size)
    use = held <= COMMON * total
    for words in items.words:
        # An item of common words only is searched by its rarest ones.
        own = np.unique(words)
        if use[own].sum() < LEAST_TERMS:
            use[own[np.argsort(held[own], kind="stable")[:LEAST_TERMS]]] = True
    idf = np.log((total + 1) / (held + 1)).astype(np.float32) + 1
    start = np.zeros((size, len(items.ids) + OVERSAMPLE), dtype=np.float32)
    for i, words in enumerate(items.words):
        term, n = np.unique(words[use[words]], return_counts=True)
        start[term, i] = _weights(term, n, idf)
    start[:, len(items.ids) :] = np.random.default_rng(seed).normal(size=(size, OVERSAMPLE))
    start[~use] = 0
    start /= np.maximum(np.linalg.norm(start, axis=0), 1e-9)
    found = _summed(coded, spark, use, idf, start, "terms", size)
    # One direction per item and random one; an item that no passage resembles needs none.
    lengths = np.linalg.norm(found, axis=0)
    basis, sizes, _ = np.linalg.svd(found[:, lengths > 0] / lengths[lengths > 0], full_matrices=False)
    basis = basis[:, sizes > 1e-6 * sizes[:1].sum()].astype(np.float32)
    gram = _summed(coded, spark, use, idf, basis, "gram", basis.shape[1])
    values, turn = np.linalg.eigh(gram)
    return Space(use, idf, np.ascontiguousarray(basis @ turn[:, ::-1].astype(np.float32)), np.sqrt(np.maximum(values[::-1], 0)))


def _summed(coded: DataFrame, spark: SparkSession, use, idf, space: np.ndarray, kind: str, rows: int) -> np.ndarray:
    """With A the passages' matrix and S the space: A'AS (kind terms) or S'A'AS (kind gram), summed over tasks."""
    shared = spark.sparkContext.broadcast((use, idf, space))
    width = space.shape[1]

    def sums(batches):
        use, idf, space = shared.value
        weighted = space * idf[:, None]
        out = np.zeros((rows, width))
        for batch in _sliced(batches):
            word, row, place, length = _read(batch, use)
            if not len(word):
                continue
            passage, term, n, _ = _in_passages(word, row, place, length, PASSAGE)
            weight = _weights(term, n, idf)
            which, seen = _project(passage, term, n, weighted)
            if kind == "gram":
                out += seen.T @ seen
                continue
            order = np.argsort(term, kind="stable")
            term, back = term[order], np.searchsorted(which, passage[order])
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            for s in range(0, len(starts), 512):
                e = starts[s + 512] if s + 512 < len(starts) else len(term)
                part = slice(starts[s], e)
                out[term[starts[s : s + 512]]] += np.add.reduceat(seen[back[part]] * weight[order[part]][:, None], starts[s : s + 512] - starts[s], axis=0)
        filled = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array([r.tobytes() for r in out[filled]], pa.binary())], ["row", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table["sums"].to_pylist()], axis=0)
        return pa.table({"row": table["row"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "row long, sums binary"
    out = np.zeros((rows, width))
    # Bounded by the block of items: a row per word of it.
    for row, values in coded.mapInArrow(sums, kinds).groupBy("row").applyInArrow(merge, kinds).collect():
        out[row] = np.frombuffer(values)
    return out


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for w in words:
        hit = state & masks.get(w, 0)
        state = (state + hit | state - hit) & full
    return len(item) - state.bit_count()


def _holds(words: list[int], places: list[int], answer: list[int]) -> bool:
    """Whether the answer's words stand together."""
    n = len(answer)
    return any(words[i : i + n] == answer and places[i + n - 1] - places[i] == n - 1 for i in range(len(words) - n + 1))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words), answer, first_word, k1, k2 per text and leaked item."""
    spark = documents.sparkSession
    out = "doc_id long, item_id long, cosine double, lcs double, answer boolean, first_word int, k1 long, k2 long"
    found = spark.createDataFrame([], out)
    for items in item_blocks(benchmark):
        coded = coded_texts(documents, items.names)
        found = found.unionByName(_search(coded, items, latent_space(coded, items), out))
    return found


def _search(coded: DataFrame, items: Items, space: Space, kinds: str) -> DataFrame:
    # Items longer than a passage are searched by all their passages.
    word = np.concatenate(items.words)
    length = np.array([len(w) for w in items.words])
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    kept = space.use[word]
    passage, term, n, first = _in_passages(word[kept], row[kept], place[kept], length, STEP)
    which, queries = _project(passage, term, n, space.vectors * space.idf[:, None])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    owner = np.searchsorted(first, which, side="right") - 1
    sought = _rarest(passage, term, space.idf, len(items.names))
    shared = coded.sparkSession.sparkContext.broadcast((items, space, queries, owner, sought))

    def search(batches):
        items, space, queries, owner, sought = shared.value
        weighted = space.vectors * space.idf[:, None]
        present = np.zeros(len(items.names), dtype=bool)
        for batch in _sliced(batches):
            word, row, place, length = _read(batch, space.use)
            if not len(word):
                continue
            passage, term, n, first = _in_passages(word, row, place, length, STEP)
            # Passages with a single term of weight are compared like all others.
            which, seen = _project(passage, term, n, weighted)
            seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-9)
            starts = np.append(np.searchsorted(passage, which), len(passage))
            number = np.repeat(np.arange(len(which)), np.diff(starts))
            best: dict[tuple[int, int], tuple] = {}
            every, edges = _flat(batch.column("word"))
            places, _ = _flat(batch.column("place"))
            for s in range(0, len(which), 4096):
                cosine = seen[s : s + 4096] @ queries.T
                part = slice(starts[s], starts[s + len(cosine)])
                covered = _covered(number[part] - s, term[part], len(cosine), sought)
                for p, q in zip(*(x.tolist() for x in np.nonzero((cosine >= COSINE) | covered))):
                    doc = int(np.searchsorted(first, which[s + p], side="right")) - 1
                    start = (int(which[s + p]) - int(first[doc])) * STEP
                    hit = _check(items.words[owner[q]], every[edges[doc] : edges[doc + 1]], places[edges[doc] : edges[doc + 1]], start, present)
                    key = (doc, int(owner[q]))
                    if hit and (key not in best or best[key][:2] < (hit[0], float(cosine[p, q]))):
                        best[key] = (hit[0], float(cosine[p, q]), hit[1], start)
            if best:
                docs = pa.array([d for d, _ in best])
                values = list(best.values())
                columns = [
                    batch.column("doc_id").take(docs),
                    pa.array([items.ids[i] for _, i in best], pa.int64()),
                    pa.array([v[1] for v in values]),
                    pa.array([v[0] for v in values]),
                    pa.array([v[2] for v in values]),
                    pa.array([v[3] for v in values], pa.int32()),
                    batch.column("k1").take(docs),
                    batch.column("k2").take(docs),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "k1", "k2"])

    return coded.mapInArrow(search, kinds)


def _check(item: np.ndarray, words: np.ndarray, places: np.ndarray, start: int, present: np.ndarray) -> tuple[float, bool] | None:
    """(share of the item's words in order, whether its answer is there) if that makes a leak.

    ``present`` is a flag per word, all unset. No more words can stand in order than are there
    at all, which settles most candidates.
    """
    margin = len(item)
    a, b = np.searchsorted(places, [start - margin, start + PASSAGE + margin])
    present[words[a:b]] = True
    most = present[item].mean()
    present[words[a:b]] = False
    if most < LIKELY:
        return None
    near = words[a:b].tolist()
    own = item.tolist()
    share = common_subsequence(own, near) / len(own)
    if share < LIKELY:
        return None
    answer = _holds(near, places[a:b].tolist(), own[-ANSWER:])
    return (share, answer) if share >= SURE or answer else None


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text holds no leak."""
    rows, k1, k2 = keyed(documents)
    found = write_stage(leaks(documents, benchmark).select("k1", "k2").distinct(), "leaks")
    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    return rows.join(found, [k1, k2], "left_anti").select(*[f"`{c}`" for c in documents.columns])
