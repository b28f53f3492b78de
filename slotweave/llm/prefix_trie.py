"""Prefix trie of conversations by whole-sequence collapse.

Conversations are rebuilt (the head of their group's first conversation, then their own turns),
and identical ones collapse into one sequence with a weight and the list of those that end
there. The prefixes of the collapsed sequences are the nodes. Sequences that are a proper prefix
of another are dropped by an anti-join; the rest are the leaves. All figures of a node are sums
over the weighted sequences that pass it, so no subtree is ever walked:

* a sequence with smallest conversation c owns the nodes of which c is the smallest member, which
  are all its nodes from some depth on. So words of distinct nodes are counted once, at their
  owner, as a difference of two running sums of that sequence;
* words times members below a node are the weighted words of its sequences from there on.

A node is known by 128 bits: the exclusive or of two 64-bit hashes of (place, turn), where a turn
is the MD5 of its role and text. Running values over a conversation are taken within range
partitions of the turns; one row per partition carries them on, so a conversation of any length
is spread over tasks. Lists of ends are joined to pieces where they lie and only pieces meet in
the task that hashes them, which holds one batch of pieces.

Null roles and texts are empty, turns without number come first, turns with the same number are
ordered by the MD5 of role and text, and a repeated row is a turn of its own. Rows without conv_id
take no part. A conversation may be left without a turn and then ends at the root. An empty table
gives no rows. Only conv_id, turn, role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.llm.common import no_null_text, write_stage

GROUP = 20
HEADS = 4
PIECE_IDS = 512
_WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["x1", "x2", "depth"]


def turn_mark() -> Column:
    """What two turns must share to be equal: the MD5 of role and text, kept apart by the role's length."""
    role, text = no_null_text("role"), no_null_text("text")
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _hashes(place: Column, mark: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, mark), F.xxhash64(F.lit(7), place, mark)


def _running(value: Column, window) -> Column:
    return F.coalesce(value.over(window), F.lit(0).cast("long"))


def _ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, mark, words, place (in the order of conversation and turn) and part, the range partition."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        turn_mark().alias("mark"),
        F.regexp_count(no_null_text("text"), F.lit(_WORD)).cast("long").alias("words"),
    )
    ordered = turns.orderBy("conv", F.col("turn").asc_nulls_first(), "mark")
    return write_stage(
        ordered.select("conv", "mark", "words", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part")), "turns"
    )


def _conversations(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Per conversation: n, skip, head (the turns it takes over); per conversation and part: where it begins there."""
    starts = turns.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_stage(starts.withColumn("before", _running(F.sum("n"), before)), "starts")
    number = F.col("place") - F.col("first") + F.col("before") + 1
    opening = starts.where((F.col("conv") % group == 0) & (F.col("before") < heads - 1))
    opening = turns.join(opening, ["conv", "part"]).where(number < heads).groupBy(F.col("conv").alias("lead"))
    opening = opening.agg(F.sort_array(F.collect_list(F.struct(number.alias("depth"), "mark", "words"))).alias("opening"))
    lead = F.col("conv") - F.col("conv") % group
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    convs = starts.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = convs.select("conv", "n", lead.alias("lead"), F.when(lead == F.col("conv"), 0).otherwise(taken).alias("skip"))
    convs = convs.join(opening, "lead", "left").withColumn("head", F.slice("opening", 1, F.col("skip")))
    # Without an opening the first conversation of the group is absent.
    kept = F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))
    convs = convs.select("conv", "n", "skip", "head", kept.alias("kept"))
    convs = convs.withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("skip"), F.lit(0)))
    return write_stage(convs, "conversations"), starts


def _head_fold(turns: Column | str) -> list[Column]:
    """Both hashes and the words of some turns of a head."""
    zero = F.lit(0).cast("long")
    folds = [
        F.aggregate(turns, zero, lambda a, t: a.bitwiseXOR(_hashes(t["depth"], t["mark"])[0])),
        F.aggregate(turns, zero, lambda a, t: a.bitwiseXOR(_hashes(t["depth"], t["mark"])[1])),
        F.aggregate(turns, zero, lambda a, t: a + t["words"]),
    ]
    return [F.coalesce(fold, zero) for fold in folds]


def _prefixes(turns: DataFrame, convs: DataFrame, starts: DataFrame) -> DataFrame:
    """conv, depth, x1, x2, mark, words, upto (words so far) and length: a row per rebuilt turn."""
    h1, h2, hw = _head_fold("head")
    known = convs.select("conv", "skip", "kept", "length", h1.alias("h1"), h2.alias("h2"), hw.alias("hw"))
    parts = starts.join(known, "conv").withColumn("several", F.count("*").over(Window.partitionBy("conv")) > 1)

    def placed(rows: DataFrame) -> DataFrame:
        number = F.col("place") - F.col("first") + F.col("before") + 1
        rows = rows.withColumn("number", number).where(F.col("number") > F.col("skip"))
        rows = rows.withColumn("depth", F.col("number") - F.col("skip") + F.col("kept"))
        g1, g2 = _hashes(F.col("depth"), F.col("mark"))
        return rows.withColumns({"g1": g1, "g2": g2})

    # A partition cuts at most two conversations, so this is two rows per partition at most.
    cut = parts.where("several")
    sums = [F.bit_xor("g1").alias("c1"), F.bit_xor("g2").alias("c2"), F.sum("words").alias("cw")]
    carried = placed(turns.join(F.broadcast(cut), ["conv", "part"])).groupBy("conv", "part").agg(*sums)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        "conv", "part", *[_running(f(c), earlier).alias(c) for c, f in (("c1", F.bit_xor), ("c2", F.bit_xor), ("cw", F.sum))]
    )
    upto_here = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = placed(turns.join(parts, ["conv", "part"]))
    own = own.withColumns({"r1": F.bit_xor("g1").over(upto_here), "r2": F.bit_xor("g2").over(upto_here), "rw": F.sum("words").over(upto_here)})
    own = own.join(F.broadcast(carried), ["conv", "part"], "left")
    zero = F.lit(0).cast("long")
    both = lambda h, c, r: F.col(h).bitwiseXOR(F.coalesce(F.col(c), zero)).bitwiseXOR(F.col(r))
    own = own.select(
        "conv",
        F.col("depth").cast("long").alias("depth"),
        both("h1", "c1", "r1").alias("x1"),
        both("h2", "c2", "r2").alias("x2"),
        "mark",
        "words",
        (F.col("hw") + F.coalesce(F.col("cw"), zero) + F.col("rw")).alias("upto"),
        "length",
    )
    # The turns taken over: fewer than HEADS, each with the fold of those up to it.
    folded = lambda i: _head_fold(F.slice("head", F.lit(1), i))
    taken = F.transform(
        "head",
        lambda t, i: F.struct(
            t["depth"].alias("depth"),
            folded(i + 1)[0].alias("x1"),
            folded(i + 1)[1].alias("x2"),
            t["mark"].alias("mark"),
            t["words"].alias("words"),
            folded(i + 1)[2].alias("upto"),
        ),
    )
    heads = convs.where("kept > 0").select("conv", F.explode(taken).alias("t"), "length").select("conv", "t.*", "length")
    return write_stage(own.unionByName(heads), "prefixes")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of a sequence joined by commas, at most ``PIECE_IDS`` to a piece."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "depth", "conv")))
        out: list[list] = []
        for x1, x2, depth, conv in rows:
            if out and out[-1][:3] == [x1, x2, depth] and len(out[-1][4]) < PIECE_IDS:
                out[-1][4].append(str(conv))
            else:
                out.append([x1, x2, depth, conv, [str(conv)]])
        if out:
            x1, x2, depth, first, ids = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(depth, pa.int64()), pa.array(first, pa.int64()), pa.array([",".join(i) for i in ids])],
                ["x1", "x2", "depth", "first", "ids"],
            )


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per sequence from its pieces in order; only its state is held from batch to batch."""

    def done(found):
        x1, x2, depth, ends = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(depth, pa.int64()), pa.array(ends)], ["x1", "x2", "depth", "ends"]
        )

    key, state = None, None
    for batch in batches:
        found = []
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "depth", "ids"))):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                found.append((*key, state.hexdigest()))
            key, state = now, hashlib.sha256(ids.encode())
        if found:
            yield done(found)
    if key is not None:
        yield done([(*key, state.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """x1, x2, depth, ends: the SHA-256 of the ascending ids of the conversations of each sequence."""
    ids = ends.select(*_NODE, "conv").repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    pieces = ids.mapInArrow(_id_pieces, "x1 long, x2 long, depth long, first long, ids string")
    pieces = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids")
    return pieces.mapInArrow(_hash_pieces, "x1 long, x2 long, depth long, ends string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, mark (of its last turn, null at the root) and n_ends (conversations
    that end there). ``conv_id`` and ``depth`` are a key."""
    turns = _ordered_turns(conversations)
    convs, starts = _conversations(turns, group, heads)
    prefixes = _prefixes(turns, convs, starts)
    zero = F.lit(0).cast("long")
    ends = prefixes.where("depth = length").select("conv", *_NODE, "upto")
    empty = convs.where("length = 0").select("conv", zero.alias("x1"), zero.alias("x2"), zero.alias("depth"), zero.alias("upto"))
    ends = write_stage(ends.unionByName(empty), "ends")

    # Collapse: one sequence for all conversations that are equal from the first to the last turn.
    sequences = ends.groupBy(*_NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("seq"), F.first("upto").alias("total"))
    sequences = write_stage(sequences.join(end_lists(ends), _NODE), "sequences")
    steps = prefixes.join(sequences.select(F.col("seq").alias("conv")), "conv", "left_semi").withColumnRenamed("conv", "seq")
    steps = write_stage(steps, "steps")
    nodes = steps.groupBy(*_NODE).agg(F.min("seq").alias("owner"), F.count("*").alias("passing"), F.max("length").alias("deepest"))
    nodes = write_stage(nodes, "nodes")

    # Leaves: sequences that are no proper prefix of another.
    some = sequences.where("depth > 0").select(zero.alias("x1"), zero.alias("x2"), zero.alias("depth")).limit(1)
    proper = nodes.where("deepest > depth").select(*_NODE).unionByName(some)
    leaves = sequences.join(proper, _NODE, "left_anti").select("seq", F.lit(1).alias("leaf"))

    # From where on a sequence owns its nodes, and the node it branches off from.
    others = steps.join(nodes.where("passing > 1").select(*_NODE, "owner"), _NODE).where("owner <> seq")
    branch = others.groupBy("seq").agg(F.max(F.struct("depth", "owner", "upto")).alias("stem"))
    facts = sequences.select("seq", "weight", "total", "ends", F.col("depth").alias("length")).join(leaves, "seq", "left").join(branch, "seq", "left")
    facts = facts.select(
        "seq",
        "weight",
        "total",
        "ends",
        "length",
        F.coalesce("leaf", zero).alias("leaf"),
        (F.coalesce("stem.depth", zero) + 1).alias("owned"),
        F.col("stem.owner").alias("stem"),
        F.coalesce("stem.upto", zero).alias("stem_words"),
    )
    facts = write_stage(facts, "facts")

    ending = F.when(F.col("depth") == F.col("length"), F.col("ends"))
    weighted = F.col("weight") * (F.col("total") - F.col("upto") + F.col("words"))
    once = F.col("total") - F.when(F.col("depth") < F.col("owned"), F.col("stem_words")).otherwise(F.col("upto") - F.col("words"))
    mine = F.col("depth") >= F.col("owned")
    # A child is counted at the sequence that owns it.
    children = (F.col("owned") <= F.col("depth") + 1) & (F.col("length") > F.col("depth"))
    figures = [
        F.min("seq").alias("conv_id"),
        F.max(F.when(mine, F.when(F.col("depth") > F.col("owned"), F.col("seq")).otherwise(F.col("stem")))).alias("parent"),
        F.sum("weight").alias("n_convs"),
        F.count_if(children).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(weighted - once).alias("saved_tokens"),
        F.max(ending).alias("ends"),
        F.max(F.when(F.col("depth") == F.col("length"), F.col("weight"))).alias("n_ends"),
        F.max("mark").alias("mark"),
    ]
    below = steps.drop("length").join(facts, "seq").groupBy(*_NODE).agg(*figures)
    top = facts.withColumns({"depth": zero, "words": zero, "upto": zero, "mark": F.lit(None).cast("string")}).groupBy().agg(*figures).where("n_convs is not null")
    # A conversation at the root: no parent; children of the root that branch off there have no stem.
    root = F.lit(ends.agg(F.min("conv")).first()[0]).cast("long")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", root))
    found = below.drop("x1", "x2").unionByName(top.withColumn("depth", zero))
    return found.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.coalesce("n_ends", zero).alias("n_ends"),
        "mark",
    )


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with ``role`` and ``text`` of their last turn (null at the root)."""
    texts = conversations.select(turn_mark().alias("mark"), no_null_text("role").alias("role"), no_null_text("text").alias("text"))
    return nodes.join(texts.dropDuplicates(["mark"]), "mark", "left")
