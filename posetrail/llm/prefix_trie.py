"""The prefix trie of conversations, by ROLLUP over positional turn-id columns.

A turn's id is 120 bits of the md5 of its role and text. A conversation is a row for each block of ``width`` turns: the ids as
columns, and the key of the node before the block (an exclusive-or of hashes of the turns before it, at their places). One
``GROUP BY block, key, ROLLUP (ids)`` makes the nodes of all blocks together; grouping_id tells a node's depth in its block.

The smallest member names a node: a conversation that is it somewhere stays it further down, so a conversation's first own depth r
says all. Of the turns of a conversation those before r are repeats; sums over a node's members of the repeats from its depth on are
what its subtree saves, and of the conversations that own a leaf are its leaves. A second ROLLUP adds these up.

Ends of conversations are joined in chunks of 4,096 numbers and their hash is fed chunk by chunk, so a node at which a third of all
conversations end takes a small memory.

Null conv_ids belong to no conversation; null roles and texts are empty; rows of one turn are ordered by role, then text; repeated rows
are turns of their own. Without conversations there are no nodes. Extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared
from posetrail.operators import scan

#: Turns of a column block.
WIDTH = 4
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "n1", "n2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, i, k: the id's halves, words) of every turn in order."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    block = F.coalesce(F.floor(F.col("turn") / 1024).cast("long"), F.lit(-(2**62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = scan.running(turns, ["conv_id"], order, block, {"pos": (scan.COUNT, F.lit(1))})
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return placed.select(F.col("conv_id").cast("long"), F.col("pos"), half(1).alias("i"), half(16).alias("k"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def with_shared_openings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns, rebuilt conversations without turns): the first h = crc32(conv_id) % most turns are those of the group's first conversation."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    firsts = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = shared.stash(convs.join(firsts, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "conversations")
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "i", "k", "words")
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.where("m > 0").select("conv_id", "base", "m").join(heads, "base").where("pos <= m").select("conv_id", "pos", "i", "k", "words")
    return own.unionByName(lent), convs.where("m = 0 and n <= h").select("conv_id")


def _mixed(pos: Column, i: Column, k: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place."""
    return F.xxhash64(pos, i, k), F.xxhash64(F.lit("second"), k, pos, i)


def blocks(turns: DataFrame, turnless: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each conversation and block: conv_id, block, p1, p2 (the node before it), i1, k1, w1 to those of ``width``, x1, x2, n."""
    slot, block = (F.col("pos") - 1) % width, F.expr(f"cast((pos - 1) div {width} as long)")
    x1, x2 = _mixed(F.col("pos").cast("long"), F.col("i"), F.col("k"))
    at = lambda c, j: F.max(F.when(slot == j - 1, F.col(c)))
    columns = [at(c, j).alias(f"{a}{j}") for j in range(1, width + 1) for c, a in (("i", "i"), ("k", "k"), ("words", "w"))]
    wide = turns.groupBy("conv_id", block.alias("block")).agg(*columns, F.bit_xor(x1).alias("x1"), F.bit_xor(x2).alias("x2"), F.count(F.lit(1)).alias("n"))
    empty = turnless.select("conv_id", *(F.lit(v).cast("long").alias(c) for c, v in {c: None for c in wide.columns[1:]}.items()))
    wide = wide.unionByName(empty).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("block", "x1", "x2", "n")})
    folds = {"p1": (scan.XOR, F.col("x1")), "p2": (scan.XOR, F.col("x2"))}
    return scan.running(wide, ["conv_id"], ["block"], F.expr("block div 1024"), folds, exclusive=True).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("p1", "p2")})


def rolled(rows: DataFrame, sums: list[str], width: int = WIDTH) -> DataFrame:
    """Nodes (depth, n1, n2, q1, q2: the parent's key, conv_id, n_convs) with the aggregates, those of each block below its prior node."""
    ids = ", ".join(f"(i{j}, k{j})" for j in range(1, width + 1))
    made = rows.sparkSession.sql(
        f"select block, p1, p2, {ids.replace('(', '').replace(')', '')}, {width} - bit_count(grouping_id()) div 2 as level,"
        f" min(conv_id) as conv_id, count(*) as n_convs{''.join(f', {s}' for s in sums)} from {{rows}} group by block, p1, p2, rollup ({ids})",
        rows=rows,
    )
    last = F.coalesce(*(F.when(F.col("level") == j, F.col(f"i{j}")) for j in range(1, width + 1)))
    nodes = made.where(((F.col("level") == 0) & (F.col("block") == 0)) | last.isNotNull()).withColumn("depth", F.col("block") * width + F.col("level"))
    none = F.lit(0).cast("long")
    keys = {"n": [F.col("p1"), F.col("p2")], "q": [F.col("p1"), F.col("p2")]}
    for j in range(1, width + 1):
        mixed = _mixed(F.col("block") * width + j, F.col(f"i{j}"), F.col(f"k{j}"))
        for name, upto in (("n", F.col("level")), ("q", F.col("level") - 1)):
            keys[name] = [key.bitwiseXOR(F.when(upto >= j, m).otherwise(none)) for key, m in zip(keys[name], mixed, strict=True)]
    parts = [key.alias(f"{name}{h}") for name in ("n", "q") for h, key in zip((1, 2), keys[name], strict=True)]
    return nodes.select("depth", *parts, "conv_id", "n_convs", "level", *(s.rsplit(" ", 1)[1] for s in sums))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, n1, n2, ends_sha256) of (depth, n1, n2, conv_id): the hash of the ascending numbers, comma-joined."""
    texts = ends.groupBy(*KEY, F.shiftright("conv_id", 12).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _rows(done)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (*[pa.int64()] * 3, pa.string()), strict=True)], names=[*KEY, "ends_sha256"])

    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    return ordered.mapInArrow(run, "depth long, n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, turnless: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    rows = shared.stash(blocks(turns, turnless, width), "blocks")
    nodes = shared.stash(rolled(rows, [], width).drop("level"), "nodes")
    below = nodes.where("depth > 0")
    kids = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("n1"), F.col("q2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    owners = nodes.join(kids, KEY, "left").groupBy("conv_id").agg(F.min("depth").alias("r"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))

    place = lambda j: F.col("block") * width + j
    repeat = {f"w{j}": F.when(F.col("r").isNull() | (place(j) < F.col("r")), F.coalesce(f"w{j}", F.lit(0))).otherwise(0) for j in range(1, width + 1)}
    own = rows.join(owners, "conv_id", "left").withColumns(repeat | {"leaf": F.coalesce("leaf", F.lit(0))})
    total = sum((F.col(f"w{j}") for j in range(1, width + 1)), F.lit(0))
    later = scan.running(own, ["conv_id"], ["block"], F.expr("block div 1024"), ahead={"later": (scan.SUM, total)}, exclusive=True)
    later = later.withColumn("later", F.coalesce("later", F.lit(0)))
    suffix = {f"s{j}": sum((F.col(f"w{i}") for i in range(max(j, 1), width + 1)), F.col("later")) for j in range(width + 1)}
    sums = [*(f"sum(s{j}) as s{j}" for j in range(width + 1)), "sum(leaf) as n_leaves"]
    full = rolled(later.withColumns(suffix), sums, width)
    saved = F.coalesce(*(F.when(F.col("level") == j, F.col(f"s{j}")) for j in range(width + 1)))

    ends = end_hashes(rows.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("x1").alias("n1"), F.bit_xor("x2").alias("n2")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    full = full.withColumn("saved_tokens", saved).join(kids, KEY, "left").join(ends, KEY, "left").join(parents, ["depth", "q1", "q2"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, group: int = 20, most: int = 4, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = shared.stash(numbered(conversations), "turns")
    return trie(*with_shared_openings(turns, group, most), width)
