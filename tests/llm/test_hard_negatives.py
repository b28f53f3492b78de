"""Hard negatives and their scoring against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.llm import hard_negatives
from slotweave.llm.hard_negatives import Anchors, pack, scores, unpack

SCHEMA = "vec_id long, embedding array<float>, label int, row int, planes string, score double"


def plain(rows, every, positives, negatives, scale=256):
    usable = [
        (i, label, np.floor(scale * np.array(v, dtype=np.float32).astype(np.float64)).astype(int))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all()
    ]
    out = []
    for at, (a, label, v) in enumerate(usable):
        if a % every:
            continue
        others = [(-int(v @ w), i, m) for k, (i, m, w) in enumerate(usable) if k != at and len(w) == len(v)]
        others.sort(key=lambda x: x[:2])
        for ps, p, _ in [x for x in others if x[2] == label][:positives]:
            fit = [(s, i) for s, i, m in others if m != label and 50 * -ps <= 100 * -s <= 95 * -ps][:negatives]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "p", 0.5) for r in rows], SCHEMA).repartition(parts)


def found(spark, rows, every=5, **more):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("length", [0, 1, 7, 8, 13, 64])
def test_scores_are_inner_products(length, wide):
    rng = np.random.default_rng(length)
    top = 1 << 24 if wide else 300
    rows, anchors = rng.integers(-top, top, (50, length)), rng.integers(-top, top, (9, length))
    rows[0], rows[1:2] = 0, -top
    planes, bits = pack(rows)
    assert (unpack(planes, length) == rows).all() and planes.shape == (50, bits, -(-length // 8))
    tables = Anchors(np.arange(9), np.arange(9), np.zeros(9), anchors, wide).tables()
    assert (scores(planes, tables) == rows @ anchors.T).all()
    assert (scores(planes, tables, 2, 5) == rows @ anchors[2:5].T).all()


@pytest.mark.parametrize("block", [16, 1024])
def test_negatives_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 16)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(3, 6))
    rows = [(i, (centres[i % 3] + 0.6 * rng.normal(size=6)).round(1).tolist(), int(rng.integers(0, 3))) for i in range(90)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(40)]  # a common vector
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1)]  # repeated ids
    wanted = plain(rows, 5, 5, 3)
    assert len(wanted) > 100 and found(spark, rows) == wanted
    if block > 16:
        assert found(spark, rows, positives=2, negatives=60) == plain(rows, 5, 2, 60)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.9], 2), (3, [0.4, 0.9], None), (4, None, 2), (5, [nan, 1.0], 2)]
    rows += [(None, [1.0, 1.0], 2), (7, [1.0, None], 2), (8, [inf, 0.0], 2), (9, [], 1), (10, [], 2), (15, [], 1), (20, [2.0], 4)]
    rows += [(25, [3.0, -1.0], 7), (-5, [-1.0, -1.0], 1), (30, [1.0, 2.0], 2), (35, [1000.0, -70000.0], 2), (36, [900.0, -60000.0], 2)]
    assert found(spark, rows) == plain(rows, 5, 5, 3)
    assert found(spark, []) == []
    with pytest.raises(Exception, match="may not fit"):
        found(spark, [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)])


def test_wide_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (30_000 * rng.normal(size=5) + 40_000).tolist(), i % 2) for i in range(40)]
    assert found(spark, rows) == plain(rows, 5, 5, 3)
