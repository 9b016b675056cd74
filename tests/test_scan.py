"""Running values in blocks against plain loops, with one group of a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrail.operators import runs as R
from posetrail.operators import scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(1, f, rng.choice([None, rng.randint(-9, 9)])) for f in rng.sample(range(20_000), 3_000)]
    out += [(rng.randint(2, 40), k, rng.choice([None, rng.randint(-9, 9)])) for k in range(6_000)]
    return out


def plain(rows, fold, exclusive, backwards):
    out, state = {}, {}
    for v, f, x in sorted(rows, key=lambda r: -r[1] if backwards else r[1]):
        if exclusive:
            out[v, f] = state.get(v)
        if x is not None:
            state[v] = x if state.get(v) is None else fold(state[v], x)
        if not exclusive:
            out[v, f] = state.get(v)
    return out


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("backwards", [False, True])
def test_folds_against_loops(spark, rows, exclusive, backwards):
    df = spark.createDataFrame(rows, "v int, frame int, x int").repartition(5)
    folds = {"total": (scan.SUM, F.col("x")), "low": (scan.MIN, F.col("x")), "high": (scan.MAX, F.col("x")), "mixed": (scan.XOR, F.col("x")), "previous": (scan.LAST, F.col("x"))}
    way = {"ahead" if backwards else "folds": folds}
    got = scan.running(df.withColumn("total", F.lit("clash")), ["v"], ["frame"], F.expr("frame div 256"), **way, exclusive=exclusive).collect()
    assert len(got) == len(rows)
    for name, fold in {"total": lambda a, b: a + b, "low": min, "high": max, "mixed": lambda a, b: a ^ b, "previous": lambda a, b: b}.items():
        assert {(r.v, r.frame): r[name] for r in got} == plain(rows, fold, exclusive, backwards), name


def test_counts_and_no_rows(spark, rows):
    df = spark.createDataFrame(rows, "v int, frame int, x int")
    got = scan.running(df, ["v"], ["frame"], F.expr("frame div 100"), {"n": (scan.COUNT, F.lit(1))})
    seen = {}
    for v, f, _ in sorted(rows, key=lambda r: r[1]):
        seen.setdefault(v, []).append(f)
    assert {(r.v, r.frame): r.n for r in got.collect()} == {(v, f): k + 1 for v, fs in seen.items() for k, f in enumerate(fs)}
    assert scan.running(df.limit(0), ["v"], ["frame"], F.lit(0), {"n": (scan.COUNT, F.lit(1))}).count() == 0


def test_no_task_reads_more_than_its_blocks(spark):
    """One video holds a third of the rows; its blocks are dealt over the tasks of the window."""
    df = spark.range(90_000).select(F.when(F.col("id") < 30_000, 0).otherwise(F.col("id")).alias("v"), "id")
    got = scan.running(df, ["v"], ["id"], F.expr("id div 1000"), {"n": (scan.COUNT, F.lit(1))})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = got.groupBy(F.spark_partition_id()).agg(F.count("n").alias("count"), F.max("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in counts) < 90_000 / 16 * 2 and got.agg(F.max("n")).first()[0] == 30_000


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)


def series(rng, videos=4, n=700):
    """Videos of runs of all lengths, some over many blocks, with frames missing; the first holds most of the rows."""
    rows = []
    for v in range(videos):
        f = rng.choice([0, 37])
        while f < (3 * n if v == 0 else n // 3):
            x, k = rng.choice([None, 1, 2]), rng.choice([1, 2, 5, 64, 300])
            rows += [(v, f + i, x) for i in range(k) if rng.random() < 0.97]
            f += k
    return rows


def plain_runs(rows, by_gap):
    out = []
    for v, f, x in sorted(rows, key=lambda r: r[:2]):
        if out and out[-1][0] == v and out[-1][3] == x and (not by_gap or out[-1][2] == f - 1):
            out[-1][2], out[-1][4] = f, out[-1][4] + 1
        else:
            out.append([v, f, f, x, 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("by_gap", [False, True])
def test_runs_over_blocks(spark, small_blocks, by_gap):
    rows = series(random.Random(4))
    got = R.runs(spark.createDataFrame(rows, "video_id long, frame long, x int").repartition(5), "x", by_gap)
    assert sorted((tuple(r) for r in got.select("video_id", "start", "end", "x", "length").collect()), key=str) == plain_runs(rows, by_gap)


def test_spans_and_next_changes_over_blocks(spark, small_blocks):
    rows = series(random.Random(5))
    df = spark.createDataFrame(rows + rows[:40], "video_id long, frame long, x int")
    assert sorted(map(tuple, R.spans(df).collect())) == sorted(r[:3] for r in plain_runs([(v, f, 1) for v, f, _ in rows], True))
    starts = plain_runs(rows, False)
    got = {(r.video_id, r.frame): r.next for r in R.next_change(df.distinct(), "x").collect()}
    last = {v: max(f for w, f, _ in rows if w == v) + 1 for v in range(4)}
    assert got == {(v, f): min((s for w, s, *_ in starts if w == v and s > f), default=last[v]) for v, f, _ in rows}


def test_interpolation_over_blocks(spark, small_blocks):
    rng = random.Random(6)
    known = {f: rng.uniform(0, 9) for f in range(2000) if rng.random() < 0.02}
    long = spark.createDataFrame([(0, f, v) for f, v in known.items()], "video_id long, frame long, x double")
    grid = spark.range(2000).selectExpr("0L as video_id", "id as frame")
    got = [r.x for r in R.interpolated(long, grid, ("x",), ("video_id",)).orderBy("frame").collect()]
    assert np.allclose(got, np.interp(np.arange(2000), sorted(known), [known[f] for f in sorted(known)]))
