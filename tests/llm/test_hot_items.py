"""Verbatim copies are found however common their words are and whatever stands beside them."""

import random

import pytest

from slotweave.llm import decontaminate

FOLDER = "/root/testdata/sf0.01"


def test_copies_of_a_hot_item_and_of_many_items(spark):
    """All of sf0.01, one item in a third of its documents, and texts of twelve items, against a plain search."""
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("needs the test tables")
    rng = random.Random(6)
    items = {r.item_id: r.text.split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if r.text}
    hot = min((i for i in items if len(items[i]) >= 16), key=lambda i: (len(items[i]), i))
    pool = [w for i in items if i != hot for w in items[i]]
    docs, planted = [], set()
    for n, r in enumerate(spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").orderBy("doc_id").collect()):
        words = (r.text or "").split()
        if n % 3 == 0:
            at = rng.randint(0, len(words))
            near = [rng.choice(pool) for _ in range(24)] if n % 2 else []
            words[at:at] = [*near, *items[hot], *near[::-1]]
            planted.add((n, hot))
        docs.append((n, " ".join(words)))
    for n in range(60):
        some = rng.sample(sorted(items), 12)
        docs.append((10_000 + n, " ".join(w for i in some for w in items[i])))
        planted |= {(10_000 + n, i) for i in some}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert not planted - found, (len(planted - found), len(planted))
