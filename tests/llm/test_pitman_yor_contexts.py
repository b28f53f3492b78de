"""Every context has a restaurant, frequent or rare; scores are those of one process that seats all pairs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.llm import pitman_yor, text_arrays


def code(word):
    if word is None:
        return int(pitman_yor.END)
    return int(text_arrays.hashed_words(np.frombuffer(word.encode(), dtype=np.uint8), np.array([0, len(word)]))[0][0])


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(60)))) for i in range(120)]
    return docs + [(i, f"new{i} w1 w{i % 40} again w{i % 7}") for i in range(120, 150)]


def pairs_of(text):
    words = [code(w) for w in text.split()] + [int(pitman_yor.END)]
    return list(zip([int(pitman_yor.END), *words[:-1]], words))


def replay(docs, contexts, burn_in, samples):
    """(context, word) -> probability, from sweeps over all pairs at once."""
    counts = Counter(p for i, t in docs if not held_out(i) for p in pairs_of(t))
    words = np.array(sorted({w for _, w in counts}), dtype=np.uint64)
    number = {int(w): i for i, w in enumerate(words)}
    place = {int(c): i for i, c in enumerate(contexts)}
    k = len(contexts)
    often = sorted((number[w], place[c], n) for (c, w), n in counts.items() if c in place)
    rare = sorted((number[w], c, n) for (c, w), n in counts.items() if c not in place)
    owner, ctx, n = (np.array([x[j] for x in often], dtype=np.int64) for j in range(3))
    at, times = (np.array([x[j] for x in rare], dtype=np.int64) for j in (0, 2))
    names = np.array([x[1] for x in rare], dtype=np.uint64)
    size, none = len(words), np.zeros(len(words))
    every = np.concatenate([n, times])
    ones, twos = (every == 1).sum(), (every == 2).sum()
    customers = np.bincount(owner, minlength=size) + np.bincount(at, minlength=size)
    dishes = (customers == 1).sum(), (customers == 2).sum()
    d1, d0 = (min(max(a / max(1, a + 2 * b), 0.05), 0.95) for a, b in ((ones, twos), dishes))
    of_rare, own = np.unique(names, return_inverse=True)
    c_often, c_rare = np.bincount(ctx, weights=n, minlength=k), np.bincount(own, weights=times)
    totals = pitman_yor.Totals(
        contexts, int(every.sum()), size, c_often, (d0, d1), (1.0, 1.0), (np.bincount(ctx, minlength=k).astype(float),), ((customers.sum(), size),)
    )
    tables, rare_tables = np.minimum(customers, 1), np.bincount(own).astype(float)
    shares, seated_often, seated_rare, back_often, back_rare, unknown = [], 0, 0, [], [], []
    for sweep in range(burn_in + samples):
        given = pitman_yor.Rare(at, names, times, rare_tables[own], none)
        after = pitman_yor.sweep(words, owner, ctx, n, customers, tables, totals, sweep, given)
        customers, tables = after.customers, after.shared_tables
        rare_tables = np.bincount(own, weights=after.rare_tables)
        totals = totals._replace(
            tables=(*totals.tables, np.bincount(ctx, weights=after.tables, minlength=k)), shared=(*totals.shared, (customers.sum(), tables.sum()))
        )
        if sweep >= burn_in:
            seated_often, seated_rare = seated_often + n - d1 * after.tables, seated_rare + times - d1 * after.rare_tables
            shares.append(pitman_yor.shared_probability(customers, tables, *totals.shared[-1], totals))
            back_often.append((1 + d1 * totals.tables[-1]) / (1 + c_often))
            back_rare.append((1 + d1 * rare_tables) / (1 + c_rare))
            unknown.append((1 + d0 * tables.sum()) / (1 + customers.sum()) / (size + 1))
    often_at = {(o, c): x for (o, c, _), x in zip(often, seated_often)}
    rare_at = {(o, c): x for (o, c, _), x in zip(rare, seated_rare)}
    index = {int(c): i for i, c in enumerate(of_rare)}

    def probability(c, w):
        o = number.get(w)
        if c in place:
            back, taken, base = [b[place[c]] for b in back_often], often_at.get((o, place[c]), 0), c_often[place[c]]
        elif c in index:
            back, taken, base = [b[index[c]] for b in back_rare], rare_at.get((o, c), 0), c_rare[index[c]]
        else:
            back, taken, base = [1.0] * samples, 0, 0
        shared = unknown if o is None else [x[o] for x in shares]
        return taken / (samples * (1 + base)) + sum(b * x for b, x in zip(back, shared)) / samples

    return probability, number


@pytest.mark.parametrize("share", [2.0, 0.03, 1e-9])
def test_every_context_has_its_restaurant(spark, share, monkeypatch):
    """With no, some and all contexts frequent: known and new pairs, contexts and words score as replayed in one process."""
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(pitman_yor, "MERGED_PAIRS", 50)
    monkeypatch.setattr(pitman_yor, "UNSEEN_HELD", 40)
    monkeypatch.setattr(pitman_yor, "SWEPT_WORDS", 3)
    docs = texts()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    contexts = pitman_yor.find_contexts(table.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1), share)
    probability, number = replay(docs, contexts, 1, 2)
    assert abs(sum(probability(code("w30"), w) for w in number) + probability(code("w30"), 1) - 1) < 1e-9
    found = {r.doc_id: r.score for r in pitman_yor.score(table, share, 1, 2).collect()}
    wanted = {i: sum(math.log10(probability(c, w)) for c, w in pairs_of(t)) for i, t in docs}
    assert found.keys() == wanted.keys()
    assert all(abs(found[i] - x) < 1e-8 for i, x in wanted.items())


def test_rare_contexts_are_learned(spark):
    """Words that follow only one rare word are foretold after it."""
    rng = random.Random(1)
    docs = []
    for i in range(300):
        pairs = [f"a{j} b{j}" for j in rng.choices(range(100), k=20)]
        docs.append((i, " ".join(pairs)))
    rows = pitman_yor.score(spark.createDataFrame(docs, "doc_id long, text string"), 0.5).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_bundles_return_their_records():
    kind = np.dtype([("a", "<u2"), ("b", "<f8")])
    records = np.zeros(3, dtype=kind)
    records["a"], records["b"] = [1, 2, 65535], [0.5, -1, 3]
    empty, back = pitman_yor._unbundle(pitman_yor._bundle(records[:0], records), kind, kind)
    assert not len(empty) and back.tolist() == records.tolist()
