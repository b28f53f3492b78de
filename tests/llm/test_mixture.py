"""The mix against a plain version, and what the contract asks of every mix."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from slotweave.llm import mixture

SCHEMA = "doc_id long, text string, source string, hash int, owner int, number int"


def plain(rows, share=1):
    """Sorted (doc_id, size, source_size, target, taken) by exact fractions and a sort."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), int(sum(sizes.values()) * share)
    while True:
        level = Fraction(total - sum(3 * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full) or 1)
        more = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        target = Fraction(3 * sizes[s]) if s in full else level * weight[s]
        base = 3 if s in full else target // sizes[s] if sizes[s] else 0
        budget = 0 if s in full else (target - base * sizes[s]).__floor__()
        docs = [((hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15]), i, len((t or "").encode().split())) for i, t, x in rows if x == s]
        upto = 0
        for _, i, n in sorted(docs, key=lambda d: d[0]):
            extra = upto < budget and (upto + n <= budget or 2 * (budget - upto) > n)
            upto += n
            out.append((i, n, sizes[s], float(target), n * (base + extra)))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **more):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    mixed = mixture.mix(table, **more).select("doc_id", "size", "source_size", "target", "taken")
    return sorted((tuple(r) for r in mixed.collect()), key=str)


def some_rows(seed, n=400):
    pick = random.Random(seed)
    sources = ["a", "b", "", None, "ä", "z", "東"]
    return [(i, " ".join("w" * pick.randint(1, 3) for _ in range(pick.choice([0, 1, 5, 30]))), pick.choice(sources[: 1 + i % 7])) for i in range(n)]


@pytest.mark.parametrize("bits", [4, 12])
def test_mix_by_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(mixture, "ROUND_BITS", bits)
    rows = some_rows(bits, 60 if bits == 4 else 400)
    wanted = plain(rows)
    assert found(spark, rows, parts=bits) == wanted


def test_many_sources_are_joined_by_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 2)
    monkeypatch.setattr(mixture, "SALTS", 3)
    rows = some_rows(5, 150)
    assert found(spark, rows) == plain(rows)


def test_copies_at_the_cut(spark):
    """A third and more of a source is one document: copies are cut among themselves."""
    rows = [(7, "a b c", "x")] * 300 + [(i, "d e", "x") for i in range(100, 200)] + [(i, "f " * 40, "y") for i in range(40)] + [(3, "g", "z")] * 5
    assert found(spark, rows) == plain(rows)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two", None), (None, None, None), (5, "x " * 30_000, "c"), (5, "x " * 30_000, "c"), (6, " \t\n", "d")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(1, None, "a"), (2, " ", None)]) == plain([(1, None, "a"), (2, " ", None)])
    table = odd_documents.withColumn("source", F.col("k1"))
    assert mixture.mix(table, keep=["doc_id", "text", "k1"]).count() == 11
    assert mixture.mix(no_documents.withColumn("source", F.col("k1"))).count() == 0
    with pytest.raises(ValueError, match="copies"):
        mixture.mix(table, keep=["doc_id", "copies"])


def test_targets_and_nesting(spark):
    rows = some_rows(8)
    whole = found(spark, rows)
    by_source = defaultdict(list)
    for r in whole:
        by_source[r[2:4]].append(r)
    for (_, target), docs in by_source.items():
        assert abs(sum(d[4] for d in docs) - target) <= max(d[1] for d in docs)
        assert all(d[4] <= 3 * d[1] for d in docs)
    smaller = {r[0]: r[4] for r in found(spark, rows, share=0.6)}
    assert all(smaller[r[0]] <= r[4] for r in whole) and sum(smaller.values()) < sum(r[4] for r in whole)
    assert found(spark, rows, share=4.0) == plain(rows, 4)
