"""Odd tables through every operator and pipeline stage: nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

import math

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from posetrail.llm import decontam, embedding_dedup, lm, ngram_join, pii, quality, secret_scan, sentencepiece_bpe, shared, token_counts, toxicity
from posetrail.llm.queries import vocabulary

ROW = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and, some: {i}" for i in range(60_000)) + " tail"  # beyond a slice of 1 MB
PROSE = "the quick brown fox jumps over the lazy dog while seven other words follow it here"
TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (2, "another text under the same number with words enough to count"), (None, PROSE + " too"), (None, None), (3, None), (4, ""), (5, " \n\t"),
    (6, LONG), (7, "mail a@mail1.example.com, token = abc12345xyz"), (8, "é漢字 ▁   𝔘"), (9, "one"), (10, "nul\0inside the text of words that go on and on"),
]
CLASH = ("row_key", "set_id", "text_key", "_key", "log_bytes", "score", "label", "features", "piece_ids", "decoded", "pii_kinds", "component", "n", "start", "word", "row")


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "src/a", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], ROW)
    return df.withColumns({c: F.lit(f"kept {c}") for c in CLASH}) if clash else df


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 1, 1), (7, 0, 0))):
    return spark.createDataFrame(list(rows), LABELS)


def bench(spark, rows=((1, PROSE), (1, PROSE), (2, None), (None, PROSE), (3, "one"), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


PER_ROW = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)), "quality": lambda s, d: quality.quality(d, labels(s)), "token_counts": lambda s, d: token_counts.token_counts(d, vocabulary()),
    "ngram_join": lambda s, d: ngram_join.jaccard_groups(d), "lm": lambda s, d: lm.scores(d), "pii": lambda s, d: pii.surrogates(d), "decontam": lambda s, d: decontam.digests(decontam.contamination(d, bench(s))),
    "sentencepiece": lambda s, d: sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(d.select("doc_id", "text"), vocabulary())),
}


def found(df: DataFrame) -> list[tuple]:
    return sorted((tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(spark, name):
    """Every row has its row, whatever is null or repeated; the table's cut and order change nothing; clashing columns do no harm."""
    docs = table(spark, TEXTS)
    got = PER_ROW[name](spark, docs)
    assert got.count() == len(TEXTS)
    plain = PER_ROW[name](spark, table(spark, TEXTS, clash=False).repartition(3))
    same = [c for c in plain.columns if c in got.columns and c != "source"]
    assert found(got.select(*same)) == found(plain.select(*same))
    assert sorted(str(r.doc_id) for r in plain.select("doc_id").collect()) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_no_rows(spark, name):
    assert PER_ROW[name](spark, table(spark, TEXTS).limit(0)).count() == 0


def test_secrets_of_odd_rows(spark):
    got = secret_scan.scan(table(spark, [*TEXTS, (7, TEXTS[10][1])])).collect()
    assert [(r.doc_id, r.value) for r in got if r.doc_id == 7] == [(7, "abc12345xyz")] * 2
    assert secret_scan.scan(table(spark, TEXTS).limit(0)).count() == 0


def test_vectors_of_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [])], "vec_id long, embedding array<float>")
    v = v.withColumns({c: F.lit("kept") for c in ("node", "copies", "block", "dim", "leaf", "kept", "n_links")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(v).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True)], key=str)


STAGES = {
    "quality": lambda s, d: quality.keep_good(d, labels(s)), "groups": lambda s, d: ngram_join.one_per_group(d), "clean": lambda s, d: decontam.clean_documents(d, bench(s)), "pii": lambda s, d: pii.replaced(d),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns_and_odd_rows(spark, name):
    docs = table(spark, TEXTS)
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"kept {c}" for r in rows for c in CLASH if c in docs.columns)
    kept = sorted((str(r.doc_id), str(r.text)) for r in rows)
    every = sorted((str(i), str(t)) for i, t in TEXTS)
    if name == "quality":
        assert set(kept) <= set(every)
    elif name == "groups":  # copies of the prose and of equal rows go, empty ones stay, each row of no words for itself
        assert [k for k in kept if k[1] == PROSE] == [("1", PROSE)] and ("None", "None") in kept and ("3", "None") in kept and ("5", " \n\t") in kept and ("2", TEXTS[3][1]) in kept
        assert len(kept) == len(TEXTS) - 3
    elif name == "clean":  # whole copies of an item, and the text of the one-word item
        assert kept == [e for e in every if not e[1].startswith(PROSE) and e[1] != "one"]
    else:
        assert len(kept) == len(every) and ("None", "None") in kept and not any("a@mail1" in t for _, t in kept)
    assert STAGES[name](spark, docs.limit(0)).count() == 0


def test_pipeline_against_its_parts_worked_out_by_hand(spark, tmp_path):
    """All five stages on a small corpus whose fate is known: junk goes, one of each group stays, an item's passage goes, mail is replaced, ids follow."""
    rng = np.random.default_rng(3)
    vocab = [f"term{i}" for i in range(400)]
    good = [" ".join(rng.choice(vocab, 80)) + "." for _ in range(60)]
    junk = ["|||| $$$$ #### " * 40 + str(i) for i in range(60)]
    copy, near = good[5], good[6].split()
    near[3] = "changed"
    item = " ".join(rng.choice(vocab, 40))
    texts = [*good, *junk, copy, " ".join(near), item + " " + good[7][:50], "write to someone@gmail.com about " + good[8]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], ROW)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i < 60), 0) for i in range(120)]
    spark.createDataFrame(marks, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 123 is good[8] with a few words before: near enough to 8 (84 of 80 + 4 shingles shared)
    assert set(got) == set(range(60)), sorted(set(got) ^ set(range(60)))
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    for i, r in got.items():
        ids = lib.encode(good[i])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_ftrl_by_brute_force():
    """The weights after passes over a few rows, coordinate by coordinate in plain Python."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    y = np.array([float(len(set(r.tolist()) & {1, 2, 3}) > 0) for r in rows])
    w, bias = toxicity.ftrl(rows, y, epochs=2)
    z, n = {}, {}
    b, bn = math.log(y.mean() / (1 - y.mean())), 1.0

    def weight(k):
        zk = z.get(k, 0.0)
        if abs(zk) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, zk) - zk) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for r, t in zip(rows, y, strict=True):
            ws = {k: weight(k) for k in r.tolist()}
            g = 1 / (1 + math.exp(-(b + sum(ws.values())))) - t
            for k, wk in ws.items():
                s = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k], n[k] = z.get(k, 0.0) + g - s * wk, n.get(k, 0.0) + g * g
            bn += g * g
            b -= toxicity.ALPHA / math.sqrt(bn) * g
    assert math.isclose(b, bias, rel_tol=1e-9) and np.allclose([w[k] for k in range(30)], [weight(k) for k in range(30)])
    assert np.count_nonzero(w) and not w[30:].any()


def test_rule_fit_by_brute_force(monkeypatch):
    """First splits are the best of all cuts, and the lasso's weights, after enough steps, meet its optimality conditions."""
    monkeypatch.setattr(quality, "STEPS", 20_000)
    rng = np.random.default_rng(5)
    x = np.round(rng.random((500, len(quality.STATS))), 3)
    y = ((x[:, 2] > 0.6) | (x[:, 9] <= 0.2)).astype(float)
    rules, bias = quality.fit_rules(x, y)
    kept = np.stack([quality.holds(r, x) for r, _ in rules], axis=1).astype(float)
    w = np.array([c for _, c in rules])
    error = 1 / (1 + np.exp(-(kept @ w + bias))) - y
    slope = kept.T @ error / len(y)
    assert np.allclose(slope, -quality.LASSO * np.sign(w), atol=1e-3) and abs(error.mean()) < 1e-3
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for k in range(x.shape[1])]
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = {}
    for k, c in enumerate(cuts):
        for v in c:
            low = x[:, k] <= v
            if quality.LEAST_LEAF <= low.sum() <= len(y) - quality.LEAST_LEAF:
                gain[k, float(v)] = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low))
    first: list = []
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    quality._grow(bins, cuts, g, h, np.arange(len(y)), 1, (), first, np.zeros(len(y)))
    ((k, _, c),) = first[0]
    assert gain[k, c] == pytest.approx(max(gain.values()))


def test_shared_helpers(spark):
    t = spark.createDataFrame([(i, c) for i, c in enumerate([5] * 10 + [3] * 100 + [1] * 1000)], "k long, c long")
    keys, counts = shared.most_frequent(t, "k", "c", 50)
    assert keys.tolist() == list(range(10)) and counts.tolist() == [5] * 10
    assert len(shared.most_frequent(t, "k", "c", 5000)[0]) == 1110 and len(shared.most_frequent(t.limit(0), "k", "c", 5)[0]) == 0
    assert shared.free_name(t, "K") == "_K"
    kept = shared.stash(t, "kept")
    assert kept.count() == 1110
    shared.free(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        kept.count()
    many = spark.createDataFrame([(1, f"text {i}") for i in range(50)], "doc_id long, text string")
    rows = shared.learning_rows(many, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), "quality", 0, 10).collect()
    assert len(rows) == 1


def test_sets_whose_names_clash(spark, monkeypatch):
    """Sets that share their first hash are told apart by the second: nothing is merged and no link is lost."""
    whole = ngram_join.class_ids

    def poor(of, hashes, sizes):
        low, high = whole(of, hashes, sizes)
        return low % 3, high

    def names(of, hashes, sizes, renamed):  # as the module's own, which tasks would import with whole hashes
        low, high = poor(of, hashes, sizes)
        out = low.copy()
        for (one, other), name in renamed.items():
            out[(low == one) & (high == other)] = name
        return out

    monkeypatch.setattr(ngram_join, "class_ids", poor)
    monkeypatch.setattr(ngram_join, "set_names", names)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1]), " ".join(words), *(f"alone {i} with some words of its own {i}" for i in range(9))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(table(spark, list(enumerate(texts)), clash=False).coalesce(1)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, **{i: i for i in range(4, 13)}}
