"""The prefix trie against a dictionary of prefixes, on odd tables, blocks of several widths and long shared conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from posetrail.llm import prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ROW = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [*convs.get(c - c % 20, [])[:h], *own[h:]]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, m in members.items():
        gain = (len(m) - 1) * len(WORDS.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + gain
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(120), 2**40 + 3, 4096 * 5 + 1, 40_000, 40_001, 40_019]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, " \n", "long\x1ctext  of words"])))
    return rows + rows[:30]  # repeated rows


@pytest.mark.parametrize("width", [1, 3, 4])
def test_nodes_against_brute_force(spark, width):
    for seed in range(2):
        rows = [*table(seed), (None, 0, "user", "of no conversation"), (None, None, None, None)]
        df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("clash") for c in ("pos", "block", "depth", "level", "h", "base", "words", "i1")})
        assert found(prefix_trie.conversation_trie(df.repartition(3), width=width)) == plain(rows)


def test_long_shared_conversations(spark):
    """Copies of one conversation over many blocks, one that leaves it late, a very long text, and a turnless one (its group has no first)."""
    turns = [("user", f"turn {k} of it") for k in range(90)]
    rows = [(c, k, *t) for c in (0, 5, 6, 7, 20, 21) for k, t in enumerate(turns)]
    rows += [(c, k, *t) for c in (8, 41) for k, t in enumerate([*turns[:70], ("user", "w " * 100_000), *turns[71:]])]
    rows += [(c, 0, "user", "short") for c in range(60_001, 60_020)]
    got = found(prefix_trie.conversation_trie(spark.createDataFrame(rows, ROW)))
    assert got == plain(rows) and len(got) > 100
    assert any(d == 0 and ends != hashlib.sha256(b"").hexdigest() for _, d, *_, ends in got)


def test_many_ends_at_one_node(spark):
    """Ends over several chunks of numbers are hashed in ascending order."""
    rows = [(c * 700 - 3000, 0, "user", "the same") for c in range(60)] + [(c * 700 - 3000, 1, "user", "the same") for c in range(60)]
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, ROW), most=1)) == brute_without_openings(rows)


def brute_without_openings(rows):
    ends = ",".join(str(c) for c in sorted({c for c, *_ in rows})).encode()
    first, none = min(c for c, *_ in rows), hashlib.sha256(b"").hexdigest()
    return sorted([(first, 0, None, 60, 1, 1, 59 * 4, none), (first, 1, first, 60, 1, 1, 59 * 4, none), (first, 2, first, 60, 0, 1, 59 * 2, hashlib.sha256(ends).hexdigest())], key=str)


def test_no_rows(spark):
    assert found(prefix_trie.conversation_trie(spark.createDataFrame([], ROW))) == []
    assert found(prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], ROW))) == []
