"""Removal of repeated word sequences by recompression.

Each text is parsed in rounds. The first names maximal runs of one word; each later round names
pairs whose left symbol is on the left side and right symbol on the right side of a split of all
symbols by a hash bit. A name is a hash of what it stands for, so the same parts get the same
name everywhere. A symbol's context is the stretch of words that alone decides that it arises:
equal sequences hold equal symbols wherever the context lies inside them.

1. Spark counts the high-level symbols of all texts. A window of words that occurs twice can only
   hold symbols (with context) that occur twice; one that holds a single symbol is unique.
2. The windows left are compared exactly over all texts, by 128 bits of hash of their words.
3. Words covered by a repeated window are removed; decisions look at the input only.

Only distinct texts are parsed: all windows of a text with copies are repeated. Symbols and
windows that repeat inside one piece of a task are sent once, so a passage shared by a third of
all rows sends one row per piece. Texts themselves are shuffled once.

Null and empty texts have no words. Texts shorter than the window lose nothing. Texts are read
whole; repeated rows are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import keyed, no_null_text, text_key, unused, write_stage
from slotweave.llm.text_arrays import SPACED, hashed_words, mix, rows_of, sequence_hashes, text_pieces, word_spans

WINDOW = 35
ROUNDS = 6
_LEFT = np.uint64(0xA24BAED4963EE407)
_RIGHT = np.uint64(0x9FB21C651E98DF25)


def parse(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows after the rounds: name, row, first word and word after the last of the context.

    ``first`` holds the words before each row and the total. A context that reaches beyond its
    row (where the row's end took part in the decision) begins before or ends after the row.
    """
    row = rows_of(first)
    count = len(words)
    if not count:
        return words, row, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge_left, edge_right = first[:-1] - 1, first[1:] + 1

    def neighbours(row, left, right):
        """Context of the symbol before and after each; beyond the row at its ends."""
        before, after = np.empty_like(left), np.empty_like(right)
        before[1:], after[:-1] = left[:-1], right[1:]
        starts = np.ones(len(row), dtype=bool)
        starts[1:] = row[1:] != row[:-1]
        stops = np.ones(len(row), dtype=bool)
        stops[:-1] = starts[1:]
        before[starts], after[stops] = edge_left[row[starts]], edge_right[row[stops]]
        return before, after, starts, stops

    left, right = np.arange(count), np.arange(1, count + 1)
    before, after, starts, _ = neighbours(row, left, right)
    begins = starts.copy()
    begins[1:] |= words[1:] != words[:-1]
    head = np.flatnonzero(begins)
    tail = np.append(head[1:], count) - 1
    length = tail - head + 1
    name = np.where(length > 1, mix(words[head] ^ mix(length.astype(np.uint64), 1), 2), words[head])
    row, left, right = row[head], before[head], after[tail]
    for k in range(rounds):
        before, after, starts, stops = neighbours(row, left, right)
        on_right = (mix(name, 16 + k) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = ~on_right[:-1] & on_right[1:] & ~stops[:-1]
        joined = np.zeros(len(name), dtype=bool)
        joined[1:] = joins[:-1]
        pair = np.flatnonzero(joins)
        name = name.copy()
        new = mix(name[pair] * _LEFT + name[pair + 1] * _RIGHT, 64 + k)
        new_left, new_right = left.copy(), right.copy()
        # A symbol that found no partner depends on the neighbour that was not one.
        single_left, single_right = ~on_right & ~joins, on_right & ~joined
        new_right[single_left] = np.maximum(right, after)[single_left]
        new_left[single_right] = np.minimum(left, before)[single_right]
        name[pair], new_right[pair] = new, right[pair + 1]
        kept = ~joined
        name, row, left, right = name[kept], row[kept], new_left[kept], new_right[kept]
    return name, row, left, right


def _usable(first: np.ndarray, name, row, left, right, window: int):
    """Symbols whose context fits into a window of their row, with their number in the row."""
    fits = (left >= first[row]) & (right <= first[row + 1]) & (right - left <= window)
    name, row, left, right = name[fits], row[fits], left[fits], right[fits]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    return name, row, left, right, number


def _first_of_each(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first of each value, whether the value at each position occurs again)."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.ones(len(values), dtype=bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(begins) - 1
    sizes = np.bincount(group) if len(values) else np.zeros(0, dtype=np.int64)
    again = np.zeros(len(values), dtype=bool)
    again[order] = sizes[group] > 1
    return order[begins], again


#: Marks in references: the row stands for two occurrences at least.
_TWICE = 1 << 31
_MARK = 1 << 23


def _reference(key2: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The upper half of the text's second key and a number below 2^31 in one value."""
    return (key2 & np.int64(-1 << 32)) | number


def _symbol_rows(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """(symbol, reference): one row per symbol; symbols that repeat in a piece are sent once, marked.

    Repeated occurrences get a row of their own under a name that nothing else has. A reference is
    the upper 40 bits of the text's first key, the mark and the symbol's number. Should texts share
    these bits, more symbols count as repeated and more windows are compared; none is lost. Symbols
    beyond the largest number are not sent and count as repeated.
    """
    for batch in batches:
        k1_all = batch.column(0).to_numpy()
        for a, b, data, offsets in text_pieces(batch.column(1)):
            k1 = k1_all[a:b]
            one, copied = _first_of_each(k1)
            words, first = hashed_words(data, offsets)
            name, row, _, _, number = _usable(first, *parse(words, first, rounds), window)
            is_first = np.zeros(b - a, dtype=bool)
            is_first[one] = True
            mine = is_first[row] & (number < _MARK - 1)
            name, row, number = name[mine], row[mine], number[mine]
            where, again = _first_of_each(name)
            again |= copied[row]
            lone = ~again
            twice = where[again[where]]
            own = mix(name[again] ^ mix(k1[row[again]].view(np.uint64), 3) ^ number[again].astype(np.uint64), 4)
            symbol = np.concatenate([name[lone], name[twice], own]).view(np.int64)
            upper = k1 & np.int64(-1 << 24)
            at = np.concatenate([upper[row[lone]] | number[lone], np.full(len(twice), -1), upper[row[again]] | number[again] | _MARK])
            yield pa.RecordBatch.from_arrays([pa.array(symbol), pa.array(at)], ["symbol", "at"])


def _windows_left(words, first, shared: list[np.ndarray | None], window: int, rounds: int) -> np.ndarray:
    """For each word, whether the window that starts there may be repeated."""
    name, row, left, right, number = _usable(first, *parse(words, first, rounds), window)
    known = np.zeros(len(name), dtype=bool)
    base = np.searchsorted(row, np.arange(len(first)))
    for i, numbers in enumerate(shared):
        if numbers is not None and len(numbers):
            known[base[i] + numbers[base[i] + numbers < base[i + 1]]] = True
    known |= number >= _MARK - 1
    # A symbol that occurs once rules out every window that holds its context.
    change = np.zeros(len(words) + 1, dtype=np.int64)
    lone = ~known
    low = np.maximum(right[lone] - window, first[row[lone]])
    np.add.at(change, low, 1)
    np.add.at(change, left[lone] + 1, -1)
    row_of_word = rows_of(first)
    whole = np.arange(len(words)) + window <= first[row_of_word + 1]
    return (np.cumsum(change)[:-1] == 0) & whole


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, k1, reference) of the windows that may be repeated; repeats in a piece as for symbols."""
    for batch in batches:
        k1_all, k2_all = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        copies_all = batch.column("copies").to_numpy()
        numbers = batch.column("numbers")
        for a, b, data, offsets in text_pieces(batch.column("text")):
            words, first = hashed_words(data, offsets)
            shared = [None if x is None else np.array(x, dtype=np.int64) for x in numbers.slice(a, b - a).to_pylist()]
            many = copies_all[a:b] > 1
            left = _windows_left(words, first, shared, window, rounds)
            row_of_word = rows_of(first)
            whole = np.arange(len(words)) + window <= first[row_of_word + 1]
            start = np.flatnonzero(left | (many[row_of_word] & whole))
            row = row_of_word[start]
            h1 = sequence_hashes(words, start, start + window)
            h2 = sequence_hashes(mix(words, 9), start, start + window)
            where, again = _first_of_each(h1)
            again |= many[row]
            number = start - first[row]
            k1, k2 = k1_all[a:b], k2_all[a:b]
            lone, twice = ~again, where[again[where]]
            own = again & ~many[row]
            o1 = mix(h1[own] ^ mix(k1[row[own]].view(np.uint64), 3) ^ number[own].astype(np.uint64), 4)
            o2 = mix(h2[own] ^ mix(k1[row[own]].view(np.uint64), 5) ^ number[own].astype(np.uint64), 6)
            columns = [
                np.concatenate([h1[lone], h1[twice], o1]).view(np.int64),
                np.concatenate([h2[lone], h2[twice], o2]).view(np.int64),
                np.concatenate([k1[row[lone]], np.zeros(len(twice), np.int64), k1[row[own]]]),
                np.concatenate([_reference(k2[row[lone]], number[lone]), np.full(len(twice), -1), _reference(k2[row[own]], number[own] | _TWICE)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "k1", "at"])


def _again(rows: DataFrame, keys: list[str], mark: int) -> DataFrame:
    """The references whose key occurs again. A key has one row at most per piece, and one per text."""
    times = F.sum(F.when(F.col("at").bitwiseAND(F.lit(mark)) != 0, 2).otherwise(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("times", times).where((F.col("times") > 1) & (F.col("at") != -1))


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, n_words, n_removed, kept): the kept words joined by spaces."""
    for batch in batches:
        copies_all = batch.column("copies").to_numpy()
        numbers = batch.column("numbers")
        for a, b, data, offsets in text_pieces(batch.column("text")):
            starts, ends, first = word_spans(data, offsets, SPACED)
            covered = np.zeros(len(starts) + 1, dtype=np.int64)
            for i, found in enumerate(numbers.slice(a, b - a).to_pylist()):
                if copies_all[a + i] > 1 and first[i + 1] - first[i] >= window:
                    covered[first[i]] += 1
                    covered[first[i + 1]] -= 1
                elif found:
                    begin = first[i] + np.array(found)
                    covered[begin] += 1
                    np.subtract.at(covered, begin + window, 1)
            kept = np.cumsum(covered)[:-1] == 0
            raw = data.tobytes()
            texts, removed = [], []
            for i in range(b - a):
                here = np.flatnonzero(kept[first[i] : first[i + 1]]) + first[i]
                removed.append(int(first[i + 1] - first[i] - len(here)))
                if removed[-1]:
                    texts.append(b" ".join([raw[s:e] for s, e in zip(starts[here].tolist(), ends[here].tolist())]))
                else:
                    texts.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").slice(a, b - a),
                    batch.column("k2").slice(a, b - a),
                    pa.array(np.diff(first)),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["k1", "k2", "n_words", "n_removed", "kept"],
            )


def deduplicate(documents: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """k1, k2, n_words, n_removed and kept (text) per distinct text; ``text_key`` gives the keys of a text."""
    text = no_null_text("text")
    rows = documents.select(*text_key(text), text.alias("text"))
    keys = write_stage(rows.select("k1", "k2").distinct(), "text_keys")
    symbols = rows.select("k1", "text").mapInArrow(lambda b: _symbol_rows(b, window, rounds), "symbol long, at long")
    number = F.col("at").bitwiseAND(F.lit(_MARK - 1)).cast("int")
    shared = _again(symbols, ["symbol"], _MARK).groupBy(F.shiftright("at", 24).alias("upper")).agg(F.collect_set(number).alias("numbers"))
    shared = keys.withColumn("upper", F.shiftright("k1", 24)).join(shared, "upper").select("k1", "k2", "numbers")
    shared = write_stage(shared, "shared_symbols")
    distinct = rows.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    windows = distinct.join(shared, ["k1", "k2"], "left").mapInArrow(lambda b: _window_rows(b, window, rounds), "h1 long, h2 long, k1 long, at long")
    number = F.col("at").bitwiseAND(F.lit(_TWICE - 1)).cast("int")
    half = F.shiftright("at", 32).alias("half")
    repeated = _again(windows, ["h1", "h2"], _TWICE).groupBy("k1", half).agg(F.collect_set(number).alias("numbers"))
    repeated = keys.withColumn("half", F.shiftright("k2", 32)).join(repeated, ["k1", "half"]).select("k1", "k2", "numbers")
    final = distinct.join(repeated, ["k1", "k2"], "left")
    return final.mapInArrow(lambda b: _removed(b, window), "k1 long, k2 long, n_words long, n_removed long, kept string")


def repeated_words(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row."""
    results = deduplicate(documents, window).withColumn("kept_sha256", F.sha2(F.encode("kept", "UTF-8"), 256)).drop("kept")
    keys = documents.select("doc_id", *text_key(no_null_text("text")))
    return keys.join(results, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without the repeated words: changed texts are their kept words joined by spaces.

    Texts that lose nothing stay as they are; rows of which no word is left go. ``n_chars``, if
    there, is the length of the new text.
    """
    rows, k1, k2 = keyed(documents)
    removed, kept = unused(rows, "_removed"), unused(rows, "_kept")
    found = deduplicate(documents, window).where("n_removed > 0")
    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n_removed").alias(removed), F.col("kept").alias(kept))
    changed = F.col(removed).isNotNull()
    rows = rows.join(found, [k1, k2], "left").where(~changed | (F.col(kept) != ""))
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text").cast("string"))}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.char_length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns])
