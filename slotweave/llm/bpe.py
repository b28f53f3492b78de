"""BPE encoding and decoding with a lexicon of frequent words, kept as a minimal acyclic transducer.

Words that make up at least ``SHARE`` of all words are compiled, with their ids, into an automaton
that shares suffixes: the numbers on the arcs add up to the word's place in the sorted lexicon,
and the place gives its ids. The automaton is one file in the shared folder; executors fetch it
once and every worker maps it into memory. Words it does not hold are merged exactly, pair by
pair in order of rank, many words at a time. So the lexicon changes the speed, never the ids.

There are at most 1 / SHARE such words, a bound that does not depend on the corpus. Each task
counts all its words and reports those with at least that share of its own words; a word with
that share of the whole must have it in some task.

Null and empty texts have no tokens. Special tokens in a text become their own ids. Texts of any
length are encoded whole; repeated rows give repeated results. Only the id and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.session import scratch_path, write_stage

SHARE = 4e-6
MEMO_WORDS = 150_000
PIECE = 2 << 20
LONG_WORD = 64
NO_RANK = np.int32(2**31 - 1)

# Fixed values of the tokenizer's definition: how text is cut into words, and the end-of-word mark.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for ASCII in lower case. The white space is spelt out, as ``re`` has more of it.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
END = "</w>"
#: Characters whose class is the same in every version of Unicode in use.
_RARE = regex.compile(r"[^\x00-ɏͰ-ͷΆ-ϿЀ-ԯḀ-ỿ‐-‧‰-⁞€ぁ-ゖァ-ヿ一-龥가-힣]")


class Vocabulary:
    """The merges and tokens of a tokenizer file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        spec = json.loads(self.text)
        ids = spec["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        letters = _byte_letters()
        self.inner = np.array([ids[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([ids[letters[b] + END] for b in range(256)], dtype=np.int32)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in map(tuple, spec["model"]["merges"])]
        self._place(pairs)

    def _place(self, pairs: list[tuple[int, int, int]]) -> None:
        """An open-addressing table from a pair of ids to its rank and the merged id."""
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        self.merged = np.zeros(1 << self.bits, dtype=np.int32)
        for rank, (a, b, c) in enumerate(pairs):
            key = a << 20 | b
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & (1 << self.bits) - 1
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at], self.merged[at] = key, rank, c

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NO_RANK where it is no merge."""
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        missed = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(missed):
            at[missed] = (at[missed] + 1) & (1 << self.bits) - 1
            held = self.keys[at[missed]]
            missed = missed[(held != keys[missed]) & (held >= 0)]
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], NO_RANK), self.merged[at]


@cache
def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free code from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _library(text: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def split_words(text: str, vocab: Vocabulary) -> list[str]:
    """Words of a text without special tokens."""
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    if (rare := _RARE.search(text)) and any(unicodedata.category(c) == "Cn" for c in text[rare.start() :]):
        # Characters newer than this Python's tables: the tokenizer's own tables decide.
        own = _library(vocab.text)
        parts = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
        back = {letter: b for b, letter in enumerate(_byte_letters())}
        return [bytes(back[c] for c in part).decode("utf-8", "surrogateescape") for part, _ in parts]
    # The final sigma is lowered like any other.
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return WORD.findall(text.lower())


def parts_of(text: str, vocab: Vocabulary) -> list[str | int]:
    """Words, and ids of special tokens, in order."""
    if "<" not in text or not (hits := list(vocab.special.finditer(text))):
        return split_words(text, vocab)
    parts: list[str | int] = []
    at = 0
    for hit in hits:
        parts += [*split_words(text[at : hit.start()], vocab), vocab.specials[hit.group()]]
        at = hit.end()
    return parts + split_words(text[at:], vocab)


def _merge_long(word: bytes, vocab: Vocabulary) -> bytes:
    """One long word, by a queue of pairs."""
    ids = [*vocab.inner[list(word[:-1])].tolist(), int(vocab.last[word[-1]])]
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    ranks, merged = vocab.look_up(np.array(ids[:-1]), np.array(ids[1:]))
    queue = [(int(r), i, ids[i], ids[i + 1], int(c)) for i, (r, c) in enumerate(zip(ranks, merged)) if r != NO_RANK]
    heapq.heapify(queue)
    alive = [True] * len(ids)
    while queue:
        _, i, a, b, c = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = c, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] >= 0:
                rank, new = vocab.look_up(np.array([ids[x]]), np.array([ids[after[x]]]))
                if rank[0] != NO_RANK:
                    heapq.heappush(queue, (int(rank[0]), x, ids[x], ids[after[x]], int(new[0])))
    return np.array([x for x, lives in zip(ids, alive) if lives], dtype="<u4").tobytes()


def merge_words(words: list[str], vocab: Vocabulary) -> list[bytes]:
    """The ids of words, as little-endian 32-bit numbers. Each step merges the leftmost best pair of every word."""
    coded = [w.encode("utf-8", "surrogateescape") for w in words]
    lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    out: list[bytes] = [b""] * len(coded)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = _merge_long(coded[i], vocab)
    ids = ranks = merged = None
    rows = np.zeros(0, dtype=np.int64)
    for length in range(int(min(LONG_WORD, lengths.max(initial=0))), 0, -1):
        fresh = np.flatnonzero(lengths == length)
        if len(fresh):
            letters = np.frombuffer(b"".join(coded[i] for i in fresh), dtype=np.uint8).reshape(-1, length)
            new_ids = vocab.inner[letters]
            new_ids[:, -1] = vocab.last[letters[:, -1]]
            new_ranks, new_merged = vocab.look_up(new_ids[:, :-1].ravel(), new_ids[:, 1:].ravel())
            new_ranks, new_merged = new_ranks.reshape(len(fresh), -1), new_merged.reshape(len(fresh), -1)
            held = len(rows) > 0
            rows = np.concatenate([rows, fresh]) if held else fresh
            ids = np.concatenate([ids, new_ids]) if held else new_ids
            ranks = np.concatenate([ranks, new_ranks]) if held else new_ranks
            merged = np.concatenate([merged, new_merged]) if held else new_merged
        if not len(rows):
            continue
        place = ranks.argmin(axis=1) if length > 1 else np.zeros(len(rows), dtype=np.int64)
        every = np.arange(len(rows))
        done = ranks[every, place] == NO_RANK if length > 1 else np.ones(len(rows), dtype=bool)
        packed = ids[done].astype("<u4").tobytes()
        for k, i in enumerate(rows[done].tolist()):
            out[i] = packed[4 * length * k : 4 * length * (k + 1)]
        rows, ids, ranks, merged, place = rows[~done], ids[~done], ranks[~done], merged[~done], place[~done]
        if not len(rows):
            continue
        every = np.arange(len(rows))
        token = merged[every, place]
        column = np.arange(length - 1)
        ids = np.take_along_axis(ids, column + (column > place[:, None]), axis=1)
        ids[every, place] = token
        if length > 2:
            pair = np.arange(length - 2)
            source = pair + (pair >= place[:, None])
            ranks, merged = np.take_along_axis(ranks, source, axis=1), np.take_along_axis(merged, source, axis=1)
            for x in (place - 1, place):
                ok = np.flatnonzero((x >= 0) & (x < length - 2))
                ranks[ok, x[ok]], merged[ok, x[ok]] = vocab.look_up(ids[ok, x[ok]], ids[ok, x[ok] + 1])
        else:
            ranks = merged = np.zeros((len(rows), 0), dtype=np.int32)
    return out


def compile_lexicon(words: list[str], vocab: Vocabulary) -> bytes:
    """The file of the minimal automaton of ``words`` and the ids of each, by sorted place."""
    ordered = sorted({w.encode("utf-8", "surrogateescape") for w in words if w})
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]], int]] = []

    def settle(node: list) -> int:
        """The number of the state with this ending and these arcs; equal states are one."""
        arcs = tuple(node[1])
        key = (node[0], arcs)
        if key not in known:
            known[key] = len(states)
            states.append((node[0], list(arcs), node[0] + sum(states[t][2] for _, t in arcs)))
        return known[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for depth in range(len(last), shared, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], settle(node)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[depth - 1], settle(node)))
    root = settle(path[0])
    keys, targets, skips = [], [], []
    for number, (final, arcs, _) in enumerate(states):
        passed = int(final)
        for byte, target in arcs:
            keys.append(number << 8 | byte)
            targets.append(target)
            skips.append(passed)
            passed += states[target][2]
    ids = merge_words([w.decode("utf-8", "surrogateescape") for w in ordered], vocab)
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    arrays = [
        np.array([root], dtype=np.int64),
        np.array(keys, dtype=np.int64),
        np.array(targets, dtype=np.int64),
        np.array(skips, dtype=np.int64),
        np.array([s[0] for s in states], dtype=np.int64),
        offsets,
    ]
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    return b"".join([sizes.tobytes(), *[a.tobytes() for a in arrays], *ids])


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        self.map = np.memmap(path, dtype=np.uint8, mode="r")
        sizes = self.map[:48].view(np.int64)
        edges = 48 + 8 * np.cumsum([0, *sizes])
        parts = [self.map[a:b].view(np.int64) for a, b in zip(edges, edges[1:])]
        root, self.keys, self.targets, self.skips, self.final, self.offsets = parts
        self.root, self.ids = int(root[0]), self.map[edges[-1] :]

    def find(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word, None for words it does not hold; all words walk the automaton together."""
        coded = [w.encode("utf-8", "surrogateescape") for w in words]
        found: list[bytes | None] = [None] * len(coded)
        if not len(self.keys):
            return found
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        text = np.frombuffer(b"".join(coded), dtype=np.uint8)
        at = np.cumsum(lengths) - lengths
        alive = np.arange(len(coded))
        state = np.full(len(coded), self.root)
        place = np.zeros(len(coded), dtype=np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            for i in alive[ended & (self.final[state[alive]] == 1)].tolist():
                p = place[i]
                found[i] = self.ids[self.offsets[p] : self.offsets[p + 1]].tobytes()
            alive = alive[~ended]
            key = state[alive] << 8 | text[at[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            place[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            step += 1
        return found


def frequent_words(documents: DataFrame, tokenizer: str, share: float = SHARE) -> list[str]:
    """All words with at least ``share`` of the corpus's words (and perhaps some slightly rarer ones)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(parts_of(text, vocab))
                if len(words) > MEMO_WORDS:
                    yield _heavy(words, share)
                    words.clear()
        yield _heavy(words, share)

    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long, total long")
    # Every report has one row without word that carries its number of words.
    summed = write_stage(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "frequent_words")
    total = summed.where("word is null").select("total").first()
    least = share * (total[0] if total and total[0] else 0)
    return [r[0] for r in summed.where((F.col("n") >= least) & F.col("word").isNotNull()).select("word").collect()]


def _heavy(words: Counter, share: float) -> pa.RecordBatch:
    # The numbers among them are special tokens.
    total = words.total() - sum(n for w, n in words.items() if w.__class__ is int)
    kept = [(w, n) for w, n in words.items() if n >= share * total and w.__class__ is str and w.isprintable()]
    names = [w for w, _ in kept] + [None]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([n for _, n in kept] + [0], pa.int64()), pa.array([0] * len(kept) + [total], pa.int64())],
        ["word", "n", "total"],
    )


def share_lexicon(spark: SparkSession, data: bytes) -> str:
    """Write the lexicon to the shared folder, have executors fetch it, and return its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class _Worker:
    """What a worker keeps between batches: the mapped lexicon and the ids of words seen lately."""

    def __init__(self, tokenizer: str, name: str) -> None:
        self.vocab, self.lexicon = vocabulary(tokenizer), Lexicon(SparkFiles.get(name))
        self.known: dict[str | int, bytes] = {}

    def learn(self, parts: set) -> None:
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known.clear()
            new = list(parts)
        words = [p for p in new if p.__class__ is str]
        self.known.update((p, p.to_bytes(4, "little")) for p in new if p.__class__ is int)
        found = self.lexicon.find(words)
        unseen = [w for w, ids in zip(words, found) if ids is None]
        self.known.update((w, ids) for w, ids in zip(words, found) if ids is not None)
        self.known.update(zip(unseen, merge_words(unseen, self.vocab)))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [parts_of(t, self.vocab) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


def decode_ids(ids: bytes, tokens: list[str]) -> str:
    """Tokens joined by one space, special tokens included."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_worker: dict[tuple[str, str], _Worker] = {}


def round_trip(documents: DataFrame, tokenizer: str, share: float = SHARE) -> DataFrame:
    """All columns of ``documents`` but text, then ids (little-endian 32-bit numbers) and decoded text."""
    spark = documents.sparkSession
    vocab = vocabulary(tokenizer)
    name = share_lexicon(spark, compile_lexicon(frequent_words(documents, tokenizer, share), vocab))
    kept = [c for c in documents.columns if c not in ("text", "ids", "decoded")]
    rows = documents.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, name) not in _worker:
            _worker.clear()
            _worker[tokenizer, name] = _Worker(tokenizer, name)
        worker = _worker[tokenizer, name]
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            first, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= PIECE or i == len(texts) - 1:
                    ids = worker.encode([t or "" for t in texts[first : i + 1]])
                    decoded = [decode_ids(x, worker.vocab.tokens) for x in ids]
                    columns = [batch.column(k).slice(first, i + 1 - first) for k in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*kept, "ids", "decoded"])
                    first, size = i + 1, 0

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "ids binary", "decoded string"]))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
