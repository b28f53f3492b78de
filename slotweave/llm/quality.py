"""Quality classifier: random-indexing word vectors pooled per text, and a two-layer network.

Texts are cut into runs of letters, digits and marks. Each run is a word (letters in lower case)
and is followed by a word for its shape: case, length, and whether the text had it before. Words
with at least ``SHARE`` of the corpus keep a number of their own (so at most 1 / SHARE do), all
others fall into hashed buckets. Every number has a sparse random index vector; its word vector
adds the index vectors of its neighbours over the whole corpus. A text is the mean of its word
vectors; the network turns it into a probability, whose temperature is set on rows held back
from the fit.

The network is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of the
doc_id; word counts and word vectors cover all texts. Labels, language, source and doc_id are no
inputs of a score.

Null and empty texts have the zero vector and get a score as well. Without labelled rows all
scores are 0.5; labels that contradict each other are left out. Texts are read whole; repeated
rows get equal scores. An empty table gives no rows. Columns other than ``doc_id`` and ``text``
are passed through by ``scored`` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import unused, write_stage
from slotweave.llm.text_arrays import LOWER, mix, text_pieces, word_hashes, word_totals, words_with_share

# Sums of vectors follow the pieces, so their last digits depend on this.
PIECE_BYTES = 2 << 20
SHARE = 3e-4
BUCKETS = 256
SIZE = 128
NONZERO = 6
NEIGHBOURS = 0.5
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.3

_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[0x41:0x5B] = 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word): a run and then its shape, in order of the text."""
    kind = _KIND[data]
    begins = kind != 0
    begins[1:] &= kind[1:] != kind[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = kind[edges] != 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # A run ends where the next begins, at white space or at the end of the row.
    stop = kind == 0
    stop[edges] = True
    stop[starts] = True
    places = np.append(np.flatnonzero(stop), len(data))
    ends = places[np.searchsorted(places, starts, side="right")]
    row = np.searchsorted(offsets, starts, side="right") - 1
    hashed = word_hashes(LOWER[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals, length = upper[ends] - upper[starts], ends - starts
    case = np.select([capitals == 0, (capitals == length) & (length > 1), (capitals == 1) & (_UPPER[data[starts]] == 1)], [0, 1, 2], 3)
    in_row = mix(hashed ^ mix(row.astype(np.uint64), 31), 32)
    again = np.ones(len(starts), dtype=np.int64)
    again[np.unique(in_row, return_index=True)[1]] = 0
    shape = ((kind[starts].astype(np.int64) * 4 + case) * 2 + again) * 32 + np.minimum(length, 24)
    both = np.empty(2 * len(starts), dtype=np.uint64)
    both[0::2], both[1::2] = hashed, mix(shape.astype(np.uint64), 33)
    return both, np.repeat(row, 2)


def numbers_of(hashed: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The number of each word: its place among the frequent words, or a bucket after them."""
    bucket = len(frequent) + (mix(hashed, 34) % np.uint64(BUCKETS)).astype(np.int64)
    if not len(frequent):
        return bucket
    at = np.minimum(np.searchsorted(frequent, hashed), len(frequent) - 1)
    return np.where(frequent[at] == hashed, at, bucket)


def index_vectors(frequent: np.ndarray) -> np.ndarray:
    """A sparse random vector of unit length per number, from its hash alone."""
    names = np.concatenate([frequent, mix(np.arange(BUCKETS, dtype=np.uint64), 35)])
    out = np.zeros((len(names), SIZE), dtype=np.float32)
    for k in range(NONZERO):
        x = mix(names, 40 + k)
        place = (x >> np.uint64(8)) % np.uint64(SIZE)
        np.add.at(out, (np.arange(len(names)), place.astype(np.int64)), np.where(x & np.uint64(1), 1.0, -1.0))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def frequent_words(texts: DataFrame, share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the words with at least the share of all words, counted exactly: at most 1 / share."""

    def report(batches):
        yield from word_totals(words_of(data, offsets)[0] for batch in batches for _, _, data, offsets in text_pieces(batch.column("text"), PIECE_BYTES))

    return words_with_share(texts.select("text").mapInArrow(report, "word long, n long"), share, "quality_words")


def word_vectors(texts: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Index vectors with, added, the normalised sum of the index vectors of all neighbours in the corpus."""
    index = index_vectors(frequent)
    shared = texts.sparkSession.sparkContext.broadcast((frequent, index))

    def sums(batches):
        frequent, index = shared.value
        total = np.zeros(index.shape, dtype=np.float64)
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch.column("text"), PIECE_BYTES):
                hashed, row = words_of(data, offsets)
                number = numbers_of(hashed, frequent)
                near = row[1:] == row[:-1]
                a, b = number[:-1][near], number[1:][near]
                key, n = np.unique(np.concatenate([a * len(index) + b, b * len(index) + a]), return_counts=True)
                if not len(key):
                    continue
                word, other = key // len(index), key % len(index)
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                total[word[starts]] += np.add.reduceat(index[other] * n[:, None].astype(np.float32), starts, axis=0)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        flat = pa.array(total[used].ravel())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * SIZE), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), vectors], ["word", "total"])

    parts = texts.select("text").mapInArrow(sums, "word long, total array<double>")
    columns = [F.sum(F.col("total")[i]).alias(f"x{i}") for i in range(SIZE)]
    near = np.zeros(index.shape)
    # Bounded: one row per number.
    for word, *values in parts.groupBy("word").agg(*columns).collect():
        near[word] = values
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    return (index + NEIGHBOURS * near).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each row; zero for rows without words."""
    rows = len(offsets) - 1
    hashed, row = words_of(data, offsets)
    number = numbers_of(hashed, frequent)
    out = np.zeros((rows, SIZE), dtype=np.float32)
    cuts = np.searchsorted(row, np.arange(0, rows + 512, 512))
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        a = 512 * k
        n = min(512, rows - a)
        counts = np.bincount((row[s:e] - a) * len(vectors) + number[s:e], minlength=n * len(vectors)).reshape(n, -1)
        out[a : a + n] = (counts.astype(np.float32) @ vectors) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return out


class Network(NamedTuple):
    """Two layers on standardised inputs, with a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network | None:
    """Adam on the log loss; every fifth row is held back for the temperature."""
    if not len(y):
        return None
    rng = np.random.default_rng(seed)
    back = np.arange(len(y)) % 5 == 4
    x = x.astype(np.float64)
    xt, yt = x[~back], y[~back].astype(np.float64)
    centre, scale = xt.mean(axis=0), xt.std(axis=0) + 1e-6
    params = [rng.normal(0, (2 / SIZE) ** 0.5, (SIZE, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (xt - centre) / scale
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for s in range(0, len(order), 128):
            at = order[s : s + 128]
            inner = z[at] @ params[0] + params[1]
            hidden = np.maximum(inner, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -500, 500)))
            g = (p - yt[at]) / len(at)
            back_g = np.outer(g, params[2]) * (inner > 0)
            grads = [z[at].T @ back_g + 1e-4 * params[0], back_g.sum(axis=0), hidden.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                params[i] = params[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if back.any():
        logits, yb = net.logits(x[back]), y[back].astype(np.float64)

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, logits / t) - yb * logits / t))

        net = net._replace(temperature=min(np.exp(np.linspace(-1.5, 2.5, 81)).tolist(), key=loss))
    return net


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


class Model(NamedTuple):
    frequent: np.ndarray
    vectors: np.ndarray
    network: Network | None


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors of ``documents`` and a network for ``labels.quality``, without the rows held out."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = frequent_words(texts)
    vectors = word_vectors(texts, frequent)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (_fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")
    shared = documents.sparkSession.sparkContext.broadcast((frequent, vectors))

    def pool(batches):
        frequent, vectors = shared.value
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("text"), PIECE_BYTES):
                flat = pooled(data, offsets, frequent, vectors).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * SIZE), pa.array(flat))
                columns = [batch.column(name).slice(a, b - a) for name in ("doc_id", "quality")]
                yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "quality", "x"])

    # The sample is bounded by its parameter.
    rows = texts.join(F.broadcast(write_stage(known, "quality_sample")), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(pool, "doc_id long, quality int, x array<float>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().combine_chunks()
    if not table.num_rows:
        return Model(frequent, vectors, None)
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
    return Model(frequent, vectors, fit(x, table["quality"].to_numpy()))


def scored(documents: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``documents`` with the probability that the label is 1 in a column ``score``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c != score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("text"), PIECE_BYTES):
                if model.network is None:
                    found = np.full(b - a, 0.5)
                else:
                    found = model.network.probability(pooled(data, offsets, model.frequent, model.vectors))
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(a, b - a) for n in names], pa.array(found)], [*names, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name != score)
    return documents.select(*[f"`{n}`" for n in names]).mapInArrow(run, f"{fields}, `{score}` double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    found = scored(documents.select("doc_id", F.col("text").cast("string").alias("text")), train(documents, labels))
    return found.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that the classifier, fitted on them, does not reject."""
    score = unused(documents, "_score")
    found = scored(documents, train(documents, labels), score)
    return found.where(F.col(score) >= threshold).select(*[f"`{c}`" for c in documents.columns])
