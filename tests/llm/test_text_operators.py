"""Encoding, repeated passages, near duplicates, licenses: brute force, odd rows and empty tables."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotweave.llm import bpe, jaccard, licenses, substring, text_arrays
from slotweave.llm.text_arrays import hashed_words, rows_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def encoded(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("share", [4e-6, 1.0])
def test_round_trip_equals_library(spark, folder, library, share):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), TOKENIZER, share)).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == encoded(library, texts[r.doc_id])


def test_merges_equal_library(library):
    vocab = bpe.vocabulary(TOKENIZER)
    rng = random.Random(1)
    letters = "aaabcdeéÉßΣσςİıŒ'stve<|endoftext|>  \n\t\x1c\x85 你ひ😀👩‍👧՘Ɤ0123!?$"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x", " a'S"])
        parts = bpe.parts_of(text, vocab)
        words = [p for p in parts if isinstance(p, str)]
        ids = dict(zip(words, bpe.merge_words(words, vocab)))
        found = b"".join(ids[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts)
        assert found == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
    for word in ("a" * 3000, "thethethe" * 40, "é" * 333):
        assert bpe.merge_words([word], vocab)[0] == np.array(library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_lexicon_is_minimal_and_exact(tmp_path):
    vocab = bpe.vocabulary(TOKENIZER)
    words = ["nation", "station", "ration", "rations", "na", "é", "stations"]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words, vocab))
    lexicon = bpe.Lexicon(str(path))
    assert lexicon.find(words) == bpe.merge_words(words, vocab)
    assert lexicon.find(["n", "nations", "", "x", "rationsx"]) == [None] * 5
    # Right languages of all prefixes, counted by hand: the minimal number of states.
    ends = {frozenset(w.encode()[i:] for w in words if w.encode().startswith(p)) for w in words for i in range(len(w.encode()) + 1) for p in [w.encode()[:i]]}
    assert len(lexicon.final) == len(ends)


def test_round_trip_of_odd_rows(spark, odd_documents, no_documents, library):
    for r in bpe.round_trip(odd_documents, TOKENIZER).collect():
        assert r.decoded == library.decode(np.frombuffer(r.ids, dtype="<u4").tolist(), skip_special_tokens=False)
    assert bpe.digests(bpe.round_trip(no_documents, TOKENIZER)).count() == 0


def test_repeats_of_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    wanted = sorted(brute.removed([r.text for r in rows]))
    found = substring.repeated_words(odd_documents).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in found) == wanted
    assert substring.repeated_words(no_documents).count() == 0
    left = substring.without_repeats(odd_documents)
    assert left.columns == odd_documents.columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, None, 5, 7, 9, 10}


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_texts(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = [" ".join(rng.choice([*pool, "q " * rng.randint(1, 50), f"u{i} v{i}"]) for _ in range(rng.randint(1, 8))) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_words(docs).collect()}
    assert [found[i] for i in range(60)] == brute.removed(texts)


def test_equal_sequences_hold_equal_symbols():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 4, 35).astype(np.uint64)
    for _ in range(300):
        parts = [np.concatenate([rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64), common, rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
        starts = [next(i for i in range(len(p)) if (p[i : i + 35] == common).all()) for p in parts]
        seen = []
        for p, s in zip(parts, starts):
            name, _, left, right = substring.parse(p, np.array([0, len(p)]))
            seen.append({(n, a - s, b - s) for n, a, b in zip(name.tolist(), left.tolist(), right.tolist()) if a >= s and b <= s + 35 and a >= 0 and b <= len(p)})
        assert seen[0] == seen[1]


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    links, group = brute.linked([r.text for r in rows])
    heads = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    wanted = sorted(((r.doc_id, heads[g], n) for r, g, n in zip(rows, group, links)), key=str)
    found = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(odd_documents).collect()]
    assert sorted(found, key=str) == wanted
    kept = jaccard.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(heads.values()))
    assert jaccard.near_duplicates(no_documents).count() == 0


def test_near_duplicates_in_large_groups(spark):
    """A group larger than a tile's block: every link is counted once."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(700):
        words = list(base)
        words[rng.randrange(60)] = f"x{i % 300}"
        texts.append(" ".join(words) if i % 3 else " ".join(words[:rng.randint(40, 60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links, group = brute.linked(texts)
    found = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.near_duplicates(docs).collect()}
    assert [found[i] for i in range(700)] == list(zip(links, group))


def test_pruning_keeps_what_may_reach_the_threshold():
    limits = jaccard.least_matches(0.8, jaccard.TOLERANCE)
    assert [m for m, _ in limits] == [20, 40, 60, 80, 100]
    assert all(0 < k < 0.8 * m for m, k in limits)
    assert [k for _, k in jaccard.least_matches(0.8, 0.2)] > [k for _, k in limits]


def test_licenses_by_brute_force(spark, folder, odd_documents, no_documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [
            (1000, "MIT License mit  license x APACHE-license; general, public license"),
            (1001, "smit license; mit licenses; MITé license; K mit license \U0001f600 Mit License"),
            (1002, "SPDX-License-Identifier: GPL-3.0-only"),
            (1003, "licensed under the terms of the GNU Lesser General Public License, version 3.0. (MIT) 'cc-by-4.0'"),
        ],
        "doc_id long, text string",
    )
    both = docs.union(extra).union(odd_documents.select("doc_id", "text"))
    texts = [(r.doc_id, r.text) for r in both.collect()]
    wanted = sorted(((i, *brute.license_base(t)) for i, t in texts), key=str)
    rows = licenses.scan(both).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == wanted
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[1002] == "gpl-3.0"
    assert "lgpl-3.0" in labels[1003] and "gpl-3.0" not in labels[1003].split(",")
    assert licenses.scan(no_documents).count() == 0


def test_license_rules_are_many_and_native(spark, folder):
    assert len(licenses.rules()) > 200
    plan = licenses.scan(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_do_not_cross_rows():
    data = np.frombuffer(b"ab cdef gh", dtype=np.uint8)
    hashes, first = hashed_words(data, np.array([0, 5, 5, 10]))
    assert first.tolist() == [0, 2, 2, 4]
    assert rows_of(first).tolist() == [0, 0, 2, 2]
    whole, _ = hashed_words(np.frombuffer(b"ab cd ef gh", dtype=np.uint8), np.array([0, 11]))
    assert hashes.tolist() == whole.tolist()


def test_licenses_count_long_texts(spark):
    text = "mit license " * 30000
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_words", "n_base", "last_word").first()
    assert tuple(row) == (60000, 30000, 59998)
    assert licenses.scan(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))).count() == 0


def test_plain_text_is_cut_like_all_text():
    """ASCII texts take the faster library, which has other white space and letters of its own."""
    vocab = bpe.vocabulary(TOKENIZER)
    for text in [*("a" + chr(i) + chr(j) + "9'll'S" for i in range(128) for j in range(0, 128, 3)), "I'VE we're'd 12 a_b"]:
        assert bpe.split_words(text, vocab) == bpe.WORD.findall(text.lower())
        assert bpe.ASCII_WORD.findall(text.lower()) == bpe.WORD.findall(text.lower())


def test_special_tokens_are_no_words_of_the_lexicon():
    counted = bpe._heavy(Counter(["a", "a", 5, 5, 5, "b"]), 0.5)
    assert counted.to_pylist() == [{"word": "a", "n": 2, "total": 0}, {"word": None, "n": 0, "total": 3}]


def test_pieces_of_texts_are_small():
    """Workers stay in memory between the stages of the pipeline, as large as their largest piece made them."""
    texts = pa.array(["x" * 300_000] * 5 + ["y" * 900_000, None])
    pieces = list(text_arrays.text_pieces(texts))
    assert [len(data) for _, _, data, _ in pieces] == [300_000] * 5 + [900_000, 0]
    assert [a for a, _, _, _ in pieces] == list(range(7)) and pieces[-1][1] == 7
