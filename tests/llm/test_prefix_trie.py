"""The prefix trie against a plain version over rebuilt conversations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slotweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, x1 long, depth int, seq string"


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), mark(role, text), role, text))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        lead = c - int(math.fmod(c, 20))  # as SQL's remainder
        h = zlib.crc32(str(c).encode()) % 4
        new = turns if lead == c else own.get(lead, [])[:h] + turns[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    kids, below = defaultdict(set), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    for node, m in members.items():
        saved = (len(m) - 1) * len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += saved
            below[node[:d]][1] += node not in kids
    return sorted(
        (
            min(m),
            len(node),
            min(members[node[:-1]]) if node else -1,
            len(m),
            len(kids[node]) if node in kids else 0,
            below[node][1],
            below[node][0],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, ())))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found(spark, rows, parts=4):
    table = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA).repartition(parts)
    nodes = prefix_trie.prefix_trie(table).drop("n_ends", "mark").collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes)


def some_rows(seed, convs=120, words=2):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        if c == 40:
            continue  # the first of its group is absent
        for t in range(pick.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, ["user", "assistant"][t % 2], " ".join(pick.choice("ab") for _ in range(pick.randint(0, words)))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    rows = some_rows(seed, words=1 + seed % 2)
    assert found(spark, rows) == plain(rows)


def test_odd_conversations(spark):
    rows = some_rows(9, 30) + [
        (None, 0, "user", "lost"),
        (60, None, "user", "before the first"),
        (60, 1, None, None),
        (60, 1, "", None),
        (60, 1, "user", "tie"),
        (60, 1, "assistant", "tie"),
        (60, 2, "user", "same"),
        (60, 2, "user", "same"),
        (61, 5, "us", "erx"),
        (62, 5, "use", "rx"),
        (-3, 0, "user", "a"),
        (-20, 0, "user", "a b  c"),
        (45, 0, "user", "w " * 50_000),
        (9_000_000_001, 0, "user", "far"),
    ]
    assert found(spark, rows) == plain(rows)


def test_long_conversation_over_many_partitions(spark):
    """A conversation with most rows is cut by the range partitions and hashed as if it were not."""
    rows = [(20, t, "user", "abcd"[t % 4]) for t in range(700)] + [(c, t, "user", "abcd"[t % 4]) for c in range(21, 60) for t in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, 8) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_and_pieces(spark, monkeypatch):
    """Identical conversations end in one node, however many pieces their list takes."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, t, "user", "hello there") for c in range(0, 4000, 20) for t in range(3)] + [(7, 0, "user", "other")]
    assert found(spark, rows) == plain(rows)


def test_no_conversations_and_last_turns(spark):
    assert found(spark, []) == []
    rows = some_rows(4, 25)
    table = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)
    nodes = prefix_trie.with_last_turn(prefix_trie.prefix_trie(table), table)
    assert nodes.where("depth = 0").select("text").collect()[0].text is None
    leads = {c: (role, text) for c, t, role, text in rows if t == 0 and c % 20 == 0}
    for r in nodes.where((F.col("depth") == 1) & (F.col("conv_id") % 20 == 0)).collect():
        assert (r.role, r.text) == leads[r.conv_id]
    assert nodes.agg(F.sum("n_ends")).first()[0] == len({r[0] for r in rows})
