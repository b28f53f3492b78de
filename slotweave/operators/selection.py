"""Order statistics of a table without sorting it.

The range of a key is cut into bins of equal width. The rows per bin are counted by partial
aggregation, the bin that holds the wanted row is cut again, and so on until one row or one
value is left; then the next key decides among equal rows. A round reads one key column of a
written table and brings at most ``2 ** ROUND_BITS`` counts to the driver, however large it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

ROUND_BITS = 12


def nth_smallest(table: DataFrame, keys: Mapping[str, int], n: int) -> dict[str, int] | None:
    """The keys of the ``n``-th row (from 1) in the order of ``keys``, or None where there are fewer rows.

    ``keys`` names columns of whole numbers from 0 and their bits, most significant column first.
    ``table`` is read once per round: give it a written one.
    """
    found: dict[str, int] = {}
    inside, wanted = table, n
    for key, bits in keys.items():
        low = 0
        while bits:
            step = min(ROUND_BITS, bits)
            bits -= step
            bins = inside.groupBy(F.shiftright(F.col(key), bits).alias("bin")).count()
            for row in sorted(bins.collect()):
                if row["count"] >= wanted:
                    break
                wanted -= row["count"]
            else:
                return None
            low = row["bin"] << bits
            inside = inside.where(F.col(key).between(low, low + (1 << bits) - 1))
            if row["count"] == 1:
                return inside.select(*keys).first().asDict()
        found[key] = low
    return found


def up_to(cut: Mapping[str, int]) -> Column:
    """Whether a row comes at or before ``cut`` in the order of its keys."""
    names = list(cut)
    test = F.lit(True)
    for name in reversed(names):
        test = (F.col(name) < cut[name]) | ((F.col(name) == cut[name]) & test)
    return test
