"""Mixing sources to target weights by hash thresholds found in histograms.

Every source gets a share of the words of the mix in proportion to its weight, at most
``most`` times its own size; what it cannot take is shared among the others. A source takes each
document a whole number of times, and some of them once more: those whose hash lies below the
source's threshold. Thresholds are nested: a larger budget only adds documents to a smaller one.

A threshold is found without sorting. Words are summed by source and hash bucket; the bucket in
which the budget ends is cut again, over its own rows alone, until it holds one row. Rows that
share all bits of the hash are copies of one document and are cut by a hash of their place instead,
as any of them will do. The document at the cut is taken if that brings the source nearer to its
target.

The hash is the MD5 of doc_id and text, so the mix does not depend on partitions and reruns agree.
Only single numbers reach the driver; a table of sources is broadcast if it has at most
``BROADCAST_SOURCES`` rows and otherwise joined with the documents dealt over ``SALTS`` keys a source.

Null doc_ids and texts count as empty in the hash, a null text has size 0, the null source comes
last. Empty documents are taken 0 words. A repeated row is a document of its own. An empty table
gives no rows. Only doc_id, text, source and the columns to keep are read; a kept column that is
named like one of the result is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import no_null_text, write_stage
from slotweave.operators.dictionary import numbered

WEIGHTS = (1, 2, 3)
MOST = 3
BITS = 60
#: A round cuts a bucket into 2 ** ROUND_BITS.
ROUND_BITS = 12
BROADCAST_SOURCES = 100_000
SALTS = 64
RESULT = ["size", "source_size", "target", "copies", "taken"]
_WORD = r"[^\x20\x09-\x0D]+"
_EXACT = "decimal(38,0)"


def _document_rows(documents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """document (the kept columns), owner (orders sources, null last), size, hash and place."""
    text = F.concat(no_null_text("doc_id"), F.lit("|"), no_null_text("text"))
    return documents.select(
        F.struct(*keep).alias("document"),
        F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias("owner"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long").alias("hash"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS).alias("place"),
    )


def with_owners(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table`` (a row per owner), however many rows an owner has."""
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), "owner")
    dealt = rows.withColumn("salt", F.pmod("place", F.lit(SALTS)))
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["owner", "salt"]).drop("salt")


def levels(sources: DataFrame, total: int, most: int) -> DataFrame:
    """``sources`` with full, level_words and level_weight: a source's target is ``most`` times its size
    if ``full``, else weight * level_words / level_weight.

    Each step fixes all sources that would be above and shares the rest again; a step that fixes no
    more is the last. A step brings three numbers to the driver.
    """
    limit = (F.col("source_size") * most).cast(_EXACT)
    full, fixed = F.lit(False), None
    while True:
        sums = [F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)]
        words, weight, n = (int(x or 0) for x in sources.agg(*sums).first())
        if n == fixed or not weight:
            return sources.withColumns(
                {"full": full, "level_words": F.lit(total - words).cast("long"), "level_weight": F.lit(max(weight, 1)).cast("long")}
            )
        fixed = n
        full = F.col("weight").cast(_EXACT) * F.lit(total - words).cast(_EXACT) > limit * F.lit(weight).cast(_EXACT)


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """Per owner: source_size, target, base (copies of every document) and budget (words taken once more)."""
    sizes = numbered(rows.groupBy("owner").agg(F.sum("size").alias("source_size")), "owner")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    sizes = write_stage(sizes.select("owner", "source_size", weight.alias("weight")), "source_sizes")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    shared = F.col("weight").cast(_EXACT) * F.col("level_words").cast(_EXACT)
    parts = levels(sizes, int(total * share), most).withColumns(
        {"shared": shared, "unit": F.col("level_weight").cast(_EXACT), "whole": F.greatest("source_size", F.lit(1)).cast(_EXACT)}
    )
    even = F.col("full") | (F.col("source_size") == 0)
    base = F.when(F.col("full"), most).when(F.col("source_size") == 0, 0).otherwise(F.expr("shared div (unit * whole)"))
    parts = parts.withColumn("base", base.cast("long"))
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(
        (F.col("weight") * F.col("level_words")).cast("double") / F.col("level_weight")
    )
    budget = F.when(even, 0).otherwise(F.expr(f"(shared - cast(base as {_EXACT}) * whole * unit) div unit")).cast("long")
    return write_stage(parts.select("owner", "source_size", target.alias("target"), "base", budget.alias("budget")), "plan")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per owner with a budget: end_hash, end_place (of the document at the cut) and at_end (whether it is taken)."""
    left = budgets.where("budget > 0").select("owner", F.col("budget").alias("left"))
    inside = rows.where("size > 0").select("owner", "size", "hash", "place")
    key, shift = "hash", BITS
    while shift:
        shift -= min(ROUND_BITS, shift)
        bucket = F.shiftright(F.col(key), shift)
        sums = inside.groupBy("owner", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("owner").orderBy("bucket"))
        cut = sums.withColumn("upto", upto).join(left, "owner").where("upto > left and upto - words <= left")
        cut = write_stage(cut.select("owner", "bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left")), "cut")
        left = cut.select("owner", "left")
        inside = with_owners(inside, cut.select("owner", "bucket")).where(bucket == F.col("bucket")).drop("bucket")
        inside = write_stage(inside, "inside")
        held = inside.groupBy("owner").agg(F.count("*").alias("n"), (F.min("hash") != F.max("hash")).alias("unlike"))
        most, unlike = held.agg(F.max("n"), F.max("unlike")).first()
        if (most or 0) <= 1:
            break
        if key == "hash" and not unlike:
            key, shift = "place", BITS
    ends = inside.groupBy("owner").agg(F.min("hash").alias("end_hash"), F.min("place").alias("end_place"), F.min("size").alias("words"))
    return ends.join(left, "owner").select("owner", "end_hash", "end_place", (F.col("left") * 2 > F.col("words")).alias("at_end"))


def _below() -> Column:
    """Whether a document lies below its source's threshold."""
    copy = (F.col("place") < F.col("end_place")) | ((F.col("place") == F.col("end_place")) & F.col("at_end"))
    return F.coalesce((F.col("hash") < F.col("end_hash")) | ((F.col("hash") == F.col("end_hash")) & copy), F.lit(False))


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    share: float = 1.0,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` and size, source_size, target (of the source), copies (how often it is taken), taken (words).

    ``weights`` go to the sources in code point order, again and again. The mix has ``share`` of the
    words of all documents, as far as ``most`` allows.
    """
    clash = sorted({*keep} & {*RESULT})
    if clash:
        raise ValueError(f"rename {clash}: the result has columns of these names")
    rows = write_stage(_document_rows(documents, keep), "documents")
    planned = plan(rows, weights, most, share)
    planned = planned.join(thresholds(rows, planned), "owner", "left")
    copies = F.col("base") + _below().cast("long")
    placed = with_owners(rows, write_stage(planned, "mix"))
    return placed.select("document.*", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
