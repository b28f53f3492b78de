"""Frequent words are those of the whole corpus, however it is cut."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.llm import pitman_yor, quality, text_arrays


@pytest.mark.parametrize("parts", [1, 4])
def test_frequent_words_do_not_depend_on_the_layout(spark, parts):
    """Word a is above the share in one text and just below it in the other three; b is never near it."""
    texts = ["a " * 40 + "x " * 60] + [f"a {i} " * 9 + "y " * 82 + "b" for i in range(3)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(parts, "doc_id")
    counts = Counter(w for t in texts for w in [*t.split(), None])
    share = counts["a"] / sum(counts.values())
    code = lambda w: text_arrays.hashed_words(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0, len(w)]))[0][0]
    wanted = {code(w) for w, n in counts.items() if w and n >= counts["a"]}
    found = pitman_yor.find_contexts(table.withColumn("held_out", F.lit(False)), share)
    assert set(found.tolist()) == {int(w) for w in wanted} and code("a") in found
    every = np.concatenate([quality.words_of(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)]))[0] for t in texts])
    word, n = np.unique(every, return_counts=True)
    share = float(n[word == code("a")][0] / n.sum())
    assert quality.frequent_words(table, share).tolist() == word[n >= share * n.sum()].tolist()


def test_word_totals_are_exact_beyond_what_is_held():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 300, 200).astype(np.uint64) for _ in range(50)]
    total = Counter()
    for batch in text_arrays.word_totals(iter(parts), held=100):
        for word, n in zip(*(c.to_pylist() for c in batch.columns)):
            total[word] += n
    assert total == Counter(np.concatenate(parts).tolist())
    assert not list(text_arrays.word_totals(iter([])))
