"""Tiles of pairs of blocks: every pair is met once, and a block moves once for each group that it meets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrail.llm import embedding_dedup
from tests.llm.test_llm import linked


def test_members_meet_each_pair_once(spark):
    leaves, n = 32, 40  # the last leaf holds nine blocks
    rows = [(64, min(k, leaves - 1), max(0, k - leaves + 1), 1000 + k) for k in range(n)] + [(3, 0, 0, 5)]
    blocks = spark.createDataFrame(rows, "dim int, leaf long, part long, block long")
    near = blocks.alias("x").join(blocks.alias("y"), "dim").where("x.block <= y.block").select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    wide, deep = embedding_dedup._shape(64, leaves, 8)
    got = embedding_dedup._members(near, blocks, {64: (wide, deep)}, 1).collect()
    held = {(r.group_a, r.group_b, r.block) for r in got if r.partners is None}
    met = [(r.group_a, r.group_b, p, r.block) for r in got for p in r.partners or ()]
    assert all((one, other, p) in held for one, other, p, _ in met)
    assert sorted(tuple(sorted(m[2:])) for m in met) == sorted(tuple(r) for r in near.collect())
    assert len(got) < near.count() / 2  # two a pair before


@pytest.mark.parametrize("kind", ["float", "double"])
def test_groups_of_embeddings_agree(spark, monkeypatch, kind):
    """Groups of one block and of many give the links that brute force gives, in single and double precision."""
    for name, value in (("BLOCK", 8), ("TOP", 1), ("STRIDE", 1)):
        monkeypatch.setattr(embedding_dedup, name, value)
    x = np.random.default_rng(5).normal(size=(90, 3)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    want = linked(spark, rows)[1]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    for name, value in (("HELD", 1), ("HELD", 1 << 20), ("TILES", 0.1)):
        monkeypatch.setattr(embedding_dedup, name, value)
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
        assert got == {i: w[0][0] for i, w in want.items()}
