"""Order statistics by histograms against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from slotweave.operators import selection
from slotweave.operators.dictionary import dictionary, numbered


@pytest.mark.parametrize("bits", [3, 12])
def test_nth_smallest_by_sorting(spark, monkeypatch, bits):
    monkeypatch.setattr(selection, "ROUND_BITS", bits)
    pick = random.Random(bits)
    rows = [(pick.choice([5, 5, 5, pick.randrange(1 << 10)]), i) for i in range(80)]
    table = spark.createDataFrame(rows, "a long, b long").repartition(3)
    order = sorted(rows)
    for n in (1, 40, 80):
        cut = selection.nth_smallest(table, {"a": 10, "b": 10}, n)
        assert tuple(cut.values()) == order[n - 1]
        assert sorted(map(tuple, table.where(selection.up_to(cut)).collect())) == order[:n]
    assert selection.nth_smallest(table, {"a": 10, "b": 10}, 81) is None
    assert selection.nth_smallest(table.limit(0), {"a": 10}, 1) is None


def test_numbers_follow_the_order_over_partitions(spark):
    values = [f"d{i:04d}" for i in range(500)] + [None, "", "ä", "Z"]
    random.Random(1).shuffle(values)
    table = spark.createDataFrame([(v, 1) for v in values * 3], "device string, number int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = dictionary(table, "device", "place").collect()
        again = numbered(table.select("device"), F.col("device").desc(), number="n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = sorted(values, key=lambda v: (v is None, v or ""))
    assert [r.device for r in sorted(found, key=lambda r: r.place)] == wanted
    assert sorted(r.place for r in found) == list(range(len(values)))
    assert sorted(r.n for r in again) == list(range(3 * len(values)))
    ordered = [r.device for r in sorted(again, key=lambda r: r.n)]
    assert ordered == sorted(values * 3, key=lambda v: (v is not None, v or ""), reverse=True)
    assert dictionary(table.limit(0), "device").count() == 0
