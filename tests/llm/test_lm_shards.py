"""Shards of the language model's training rows, which repeated rows must not fill; results of nulls in op1 and op5."""

from collections import Counter

from pyspark.sql import functions as F

from posetrail.llm import lm, quality, toxicity


def test_a_row_repeated_ten_thousand_times(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4_000)
    rows = [(7, [1, 2, 3, 4, 5])] * 10_000 + [(-9, [8] * 3)] * 400 + [(k * 7919 - 5000, [k % 11] * (k % 9)) for k in range(3_000)] + [(99_999_999, [6] * 5_000)]
    dealt = spark.createDataFrame(rows, "row long, ids array<int>").repartition(6)
    shards = -(-sum(len(i) for _, i in rows) // 4_000)
    got = lm.sharded(dealt, shards).collect()
    load, held = Counter(), Counter()
    for r in got:
        load[r.shard] += r.copies * len(r.ids)
        held[r.row, tuple(r.ids)] += r.copies
    assert held == Counter((k, tuple(i)) for k, i in rows)
    assert max(v for s, v in load.items()) < 5_000 + 3 * 4_000 and max(r.copies * len(r.ids) for r in got if r.row == 7) <= 505
    same = lm.sharded(dealt.repartition(3), shards)
    assert sorted((r.shard, r.row, r.copies) for r in got) == sorted((r.shard, r.row, r.copies) for r in same.collect())


def test_scores_with_repeats_do_not_depend_on_the_cut(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    docs = spark.createDataFrame([(3, "the same words again and again")] * 600 + [(k, f"word{k % 5} other{k % 3} the end") for k in range(200)], "doc_id long, text string")
    a, b = (sorted((r.doc_id, round(r.score, 5)) for r in lm.scores(d).collect()) for d in (docs.repartition(2), docs.repartition(5)))
    assert a == b and all(s < 0 for _, s in a)


def test_held_out_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text"), (1, "more text"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
        assert got.where(F.col("doc_id").isNull() & ~F.col("held_out")).count() == 2 and got.where("held_out is null").count() == 0
