"""The training-data operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrail.llm import components as C
from posetrail.llm import decontam, embedding_dedup, lm, ngram_join, pii, quality, secret_scan, sentencepiece_bpe, token_counts, toxicity
from posetrail.llm.queries import ORACLE_SQL, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, lang string, source string, n_chars long"
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], ROW)


@pytest.fixture(scope="module")
def given(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "embeddings")}


ODD = [None, "", " ", "a", "A b  c\td", "é漢 ▁x\n\n  y", "word " * 3000, "x" * 5000, "same text here now again", "same text here now again"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5)], "a long, b long")
    assert {r[0]: r[1] for r in C.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6}
    assert C.components(edges.limit(0)).count() == 0


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab thein  ▁\n\t.é漢𠀀<0x>ß") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    out = sentencepiece_bpe.encode_decode(documents(spark, texts).withColumn("decoded", F.lit(1)), vocabulary()).orderBy("doc_id").collect()
    for t, r in zip(texts, out, strict=True):
        ids = lib.encode(t or "")
        assert list(r.piece_ids) == ids and r.decoded == lib.decode(ids)
    d = {r.doc_id: r for r in sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(documents(spark, texts), vocabulary())).collect()}
    assert d[1].n_tokens == 0 and d[3].ids_sha256 == hashlib.sha256(",".join(map(str, lib.encode("a"))).encode()).hexdigest()


def test_kept_parts_of_sentencepiece_are_bytes(monkeypatch):
    """A kept part holds four bytes for an id, no Python numbers; parts are encoded and checked a few at a time."""
    monkeypatch.setattr(sentencepiece_bpe, "NEW_PARTS", 3)
    with open(vocabulary(), "rb") as f:
        codec = sentencepiece_bpe.Codec(f.read())
    texts = ["the  cat sat\n on 2 mats", "", "\n", "x" * 100 + " \U0001f600 ünï", " ".join(f"w{k}" for k in range(50))]
    assert codec.encode_batch(texts) == [codec.library.encode(t) for t in texts]
    assert [codec.decode(x) for x in codec.encode_batch(texts)] == [codec.library.decode(codec.library.encode(t)) for t in texts]
    assert all(isinstance(x, bytes) for x in codec.kept.values())


def test_token_counts_by_brute_force(spark):
    scores, has_bytes = token_counts.pieces(vocabulary())
    worst = min(scores.values()) - 10

    def brute(part):
        best = [(0.0, 0)]
        for e in range(1, len(part) + 1):
            c = part[e - 1]
            found = [(best[e - 1][0] + worst, -(best[e - 1][1] + len(c.encode())))]
            found += [(best[b][0] + scores[part[b:e]], -(best[b][1] + 1)) for b in range(e) if part[b:e] in scores]
            s, n = max(found)
            best.append((s, -n))
        return best[-1][1]

    texts = ["hello world again", "the thing, then there", "é漢 x", "  two  blanks", *[t for t in ODD if t and len(t) < 100]]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, texts), vocabulary()).collect()}
    parts = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
    for i, t in enumerate(texts):
        assert got[i] == sum(brute(p) for p in parts.findall("▁" + t.replace(" ", "▁")))
    counter = token_counts.Counter(scores, has_bytes)
    assert [counter.insert(w) for w in ("abcde", "abcdf", "abc", "abcdg")] == [brute(w) for w in ("abcde", "abcdf", "abc", "abcdg")]
    assert counter.steps == 7  # four shared characters once, then one for each longer word
    assert math.isclose(sum(map(math.exp, scores.values())), 1.0)
    assert [r.n_tokens for r in token_counts.token_counts(documents(spark, [None, ""]), vocabulary()).collect()] == [0, 0]


def test_pieces_are_sought_only_as_far_as_one_can_end():
    class Asked(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    counter = token_counts.Counter({"a": -3.0, "b": -2.0, "ab": -1.0, "a" * 16: -4.0}, False)
    counter.tails = Asked(counter.tails)
    assert counter.count(["ab" + "z" * 200, "a" * 16]) == [1 + 1 + 200, 1 + 1]  # the dummy prefix is unknown too
    assert counter.tails.n < 3 * 203 + 17 * 17


def test_token_counts_are_near_the_merges(spark, given, monkeypatch):
    """Frequent words are whole tokens: the counts are within a tenth of those of the merges, and a full trie that starts anew changes none."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    docs = given["documents"].where("lang = 'en'")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, vocabulary()).collect()}
    want = {r.doc_id: len(lib.encode(r.text or "")) for r in docs.collect()}
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.1
    monkeypatch.setattr(token_counts, "NODES", 50)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, vocabulary()).collect()} == got


def shingles(t):
    w = (t or "").encode().translate(LOW).split()
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} - {()}


def test_jaccard_groups_by_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for n in (4, 5, 6, 9, 12, 15, 20, 40, 90, 200, 260):
        base = [rng.choice(vocab) for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 6):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                if rng.random() < 0.4 and len(w) > 1:
                    del w[at]
                else:
                    w[at] = rng.choice(vocab)
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else "\n".join(w))
        texts.append(" ".join(base[: max(1, int(n * 0.85))]))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = documents(spark, texts).withColumn("set_id", F.lit("clash"))
    got = {r.doc_id: r for r in ngram_join.jaccard_groups(docs).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = sorted(r.doc_id for r in ngram_join.one_per_group(docs).collect())
    assert kept == [i for i in range(len(texts)) if find(i) == i]
    assert ngram_join.jaccard_groups(docs.limit(0)).count() == 0


def test_one_per_group_of_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    long, near, far = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1])
    alone, null_a, null_b = "a text of no other row at all", " ".join(f"n{i}" for i in range(60)), " ".join([*(f"n{i}" for i in range(59)), "end"])
    rows = [(1, long), (2, near), (2, far), (3, far), (1, "another text under the first id here"), (None, alone), (None, null_a), (None, null_b), (None, near), (7, "same row twice"), (7, "same row twice"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], ROW)
    got = sorted(((r.doc_id or 0, r.text) for r in ngram_join.one_per_group(docs).collect()), key=str)
    (null_kept,) = {null_a, null_b} & {t for _, t in got}
    assert got == sorted([(1, long), (2, far), (1, rows[4][1]), (0, alone), (0, null_kept), (7, "same row twice"), (8, None), (0, "")], key=str)


def test_jaccard_crowds_by_brute_force(spark, monkeypatch):
    """Many near copies that share index entries, linked or not: the block comparison loses no link and adds none."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 40)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for n in (60, 90):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(110):
            w = list(base)
            for _ in range(rng.choice((1, 1, 2, 2, 3))):
                w[rng.randrange(n)] = rng.choice(vocab) if rng.random() < 0.8 else "nul\0nul"
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:  # labels spread until nothing changes
        new = [min(least[j] for j in range(len(texts)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(texts))]
        if new == least:
            break
        least = new
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == least and len(set(least)) > 2


def test_common_shingles_and_spanning_edges():
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.choice(500, rng.integers(0, 60)) if k % 3 else rng.choice(40, 30)) for k in range(n)] for n in (33, 21))
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets).astype(np.uint64), len(sets))
    assert ngram_join._common(*flat(a), *flat(b)).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    i, j = rng.integers(0, 80, 60), rng.integers(0, 80, 60)
    groups = np.arange(80) // 2
    keep = C.spanning_edges(groups, i, j)

    def labels(x, y):
        _, at = np.unique(groups, return_inverse=True)
        for _ in range(80):
            for p, q in zip(x, y, strict=True):
                at[at == max(at[p], at[q])] = min(at[p], at[q])
        return at.tolist()

    assert labels(i[keep], j[keep]) == labels(i, j) and len(keep) < 40
    assert len(C.spanning_edges(groups, i[:0], j[:0])) == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 7, 150, 3000, 200_000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 2 // 3], rng.integers(0, 1 << 62, 5).astype(np.uint64)]))
        x, y = (ngram_join.sketches(np.zeros(len(s), dtype=np.int64), s, np.array([len(s)])).astype(int) for s in (a, b))
        least = np.abs(x - y).sum()
        assert least <= len(np.setxor1d(a, b)) and (least > 0) == (n < 100_000)  # full buckets say nothing


def test_every_linked_pair_shares_a_signature():
    """The pigeonhole itself: sets at the bound, of all sizes, meet in the index."""
    rng = np.random.default_rng(1)
    for n in (4, 5, 7, 8, 12, 15, 16, 19, 31, 32, 39, 64, 79, 150, 500):
        for _ in range(12):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            m = int(rng.integers(n, n * 100 // 80 + 1))
            swaps = 0
            while 100 * (n - swaps - 1) >= 80 * (m + swaps + 1):
                swaps += 1
            b = np.concatenate([a[swaps:], rng.integers(0, 1 << 62, m - n + swaps).astype(np.uint64)])
            hashes = np.concatenate([np.sort(a), np.sort(b)])
            of, signs = ngram_join.signatures(np.repeat([0, 1], [n, m]), hashes, np.array([n, m]), np.sort(a)[:3])
            assert set(signs[of == 0]) & set(signs[of == 1]), (n, m, swaps)


def test_decontamination_by_brute_force(spark, given):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in given["benchmark"].collect()] + [(900, "Short ITEM here"), (901, ""), (902, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW).decode())
    texts = list(ODD) + ["a short item here we go", "É short iTEM here"]
    for _ in range(40):
        w = [rng.choice(["the", "of", "and", "erin"]) for _ in range(rng.randint(0, 60))]
        src = split(rng.choice(items)[1])
        a, n = rng.randrange(max(1, len(src))), rng.choice([5, 11, 12, 13, 14, 20, 60])
        at = rng.randint(0, len(w))
        texts.append(" ".join(w[:at]) + ". " + ", ".join(x.upper() for x in src[a : a + n]) + "\n" + " ".join(w[at:]))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    got = {r.doc_id: r for r in decontam.digests(decontam.contamination(documents(spark, texts), bench)).collect()}
    for d, t in enumerate(texts):
        w, hit, ids = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(ids)), t
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = {r.doc_id for r in decontam.clean_documents(documents(spark, texts), bench).collect()}
    assert clean == {d for d in got if not got[d].contaminated}


def linked(spark, rows):
    """(vec_id, vector) rows through the operator, as (n_links, component_id, kept) in their order, and by brute force."""
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string"))
    seen: dict = {}
    for r in got.collect():
        seen.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    fine = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {}
    for k in fine:
        x = np.array(rows[k][1]) / max(map(abs, rows[k][1]))
        unit[k] = x / np.linalg.norm(x)
    near = {k: [m for m in fine if m != k and len(unit[m]) == len(unit[k]) and (rows[m][1] == rows[k][1] or unit[m] @ unit[k] >= 0.9)] for k in fine}
    least = {k: rows[k][0] for k in fine}
    while True:
        new = {k: min([least[k], *(least[m] for m in near[k])]) for k in fine}
        if new == least:
            break
        least = new
    want: dict = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(i, []).append((len(near.get(k, [])), least.get(k, i), least.get(k, i) == i))
    return {i: sorted(x, key=str) for i, x in seen.items()}, {i: sorted(x, key=str) for i, x in want.items()}


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.12, size=(20, 16)), base[:5], base[:5] * 3])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, 2.0]), (904, [None] + [1.0] * 15), (905, []), (906, [float("inf")] + [1.0] * 15)]
    rows += [(910, [1e-200, 0.0]), (911, [1e200, 0.0]), (912, [1.0, 0.01]), (913, [5e-324, 0.0]), (914, [-1.0, 0.0]), (915, [0.0, 1e308]), (916, [1e308, 1e308])]
    rows += [(920, [3.0, 4.0, 5.0]), (921, [3.0, 4.0, 5.1]), (922, [7.0]), (923, [1e-300]), (924, [-2.0]), (None, [1.0, 0.0])]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (3, [1.0, 0.0]), (930, [0.0, -0.0, 1.0]), (931, [-0.0, 0.0, 1.0])]
    got, want = linked(spark, rows)
    assert got == want
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept


def test_blocks_of_embeddings_agree(spark, monkeypatch):
    """Small blocks and deep trees, walked down in small steps, give what one block gives."""
    for name, value in (("BLOCK", 8), ("TOP", 1), ("STRIDE", 1)):
        monkeypatch.setattr(embedding_dedup, name, value)
    test_embeddings_by_brute_force(spark)


def test_lm_base_score_and_normalisation(spark, given):
    docs = given["documents"].unionByName(documents(spark, [None, "", "zzz unseen"], 10_000))
    got = {r.doc_id: r for r in lm.scores(docs).collect()}
    words = {r.doc_id: (r.text or "").encode().translate(LOW).split() + [None] for r in docs.collect()}
    c = Counter()
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(w)
    total, down = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    for d, w in words.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert abs(r.base_score - sum(math.log10(c[x] + 0.5) - down for x in w)) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_by_brute_force():
    """Each context's probabilities sum to one over all symbols, and are products of two softmaxes worked out one by one."""
    rng = np.random.default_rng(1)
    layout = lm.Layout.of(rng.integers(0, 500, 300) + 0.5)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in lm.start(layout).items()}
    symbols = np.array([s for s in range(300) if s != lm.START])
    assert sorted(layout.place[symbols]) == list(range(299)) and len(layout.cuts) > 10
    for one, two in ((5, 9), (lm.START, lm.START), (lm.END, 200)):
        lp = lm.log_probabilities(symbols, np.full(299, one), np.full(299, two), layout, p)
        assert abs(np.exp(lp).sum() - 1) < 1e-5
        ctx = p["c1"] * p["q"][one] + p["c2"] * p["q"][two]
        for s in (0, 17 + 3, lm.END, 299):
            at = layout.place[s]
            g = layout.group[at]
            low, high = layout.cuts[g], layout.cuts[g + 1]
            first, second = np.exp(p["t"] @ ctx + p["a"]), np.exp(p["r"][low:high] @ ctx + p["b"][low:high])
            assert abs(lp[list(symbols).index(s)] - math.log(first[g] / first.sum() * second[at - low] / second.sum())) < 1e-4
    # before training the model is the unigram shares
    fresh = lm.log_probabilities(symbols, np.full(299, 3), np.full(299, 4), layout, lm.start(layout))
    assert np.allclose(np.exp(fresh), layout.share[symbols], rtol=1e-3)
    assert np.array_equal(lm.flat(lm.shaped(lm.flat(p), p)), lm.flat(p))


def test_lm_learns_contexts(spark):
    """Rare words keep their contexts: a text of pairs that always go together scores above the same words shuffled, however the table is cut."""
    rng = random.Random(6)
    pairs = [(f"left{i}", f"right{i}") for i in range(150)]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(150)]
    probe = [w for _ in range(60) for w in rng.choice(pairs)]
    shuffled = rng.sample(probe, len(probe))
    docs = documents(spark, [*texts, " ".join(probe), " ".join(shuffled)])
    got = {r.doc_id: r.score for r in lm.scores(docs.repartition(5)).collect()}
    assert got[150] > got[151] + 5
    again = {r.doc_id: r.score for r in lm.scores(docs.coalesce(1)).collect()}
    assert all(abs(got[i] - again[i]) < 1e-3 for i in got)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for f, label, least in ((quality.quality, "quality", 0.9), (toxicity.toxicity, "toxic", 0.8)):
        rows = f(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()
        assert np.mean([r[0] == r[1] for r in rows]) >= least
        assert all(0 <= r[2] <= 1 for r in rows)
    odd = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(odd, none).count() == toxicity.toxicity(odd, none).count() == len(ODD)
    assert quality.keep_good(odd, none).columns == odd.columns


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((400, len(quality.STATS))), 6)
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.4)).astype(float)
    rules, bias = quality.fit_rules(x, y)
    want = 1 / (1 + np.exp(-(bias + sum(w * quality.holds(r, x) for r, w in rules))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality.STATS))
    got = [r[0] for r in df.select(quality.compiled(rules, bias)).collect()]
    assert np.allclose(got, want) and np.mean((want > 0.5) == y) > 0.97


def test_surrogates(spark):
    make = pii.Surrogates()
    texts = ["mail a.b7@mail1.example.com or A.B7@mail1.example.com", "call +1 (812) 555-9048, host 95.14.52.15", "card 4404303280215809 and 4404-3032-8021-5809", "Mrs. Anna Smith met Mr. John", "nothing here 12", None, ""]
    out = {r.doc_id: r for r in pii.surrogates(documents(spark, texts)).collect()}
    assert out[4].text == texts[4] and out[5].text is None and out[6].text == ""
    a, b = re.findall(r"\S+@\S+", out[0].text)
    assert a.lower() == b.lower() and "a.b7@" not in out[0].text
    assert re.search(r"\+1 \(\d{3}\) 555-\d{4}", out[1].text) and "9048" not in out[1].text and "95.14.52.15" not in out[1].text
    cards = re.findall(r"\d[\d-]{15,}", out[2].text)
    assert cards[0] == cards[1].replace("-", "") != "4404303280215809"
    assert re.search(r"Mrs\. (\w+)", out[3].text)[1] in pii.NAMES["female latin"] and re.search(r"Mr\. (\w+)", out[3].text)[1] in pii.NAMES["male latin"]
    made = {make.phone(f"+1 (234) 555-{n:04d}") for n in range(2000)}
    assert len(made) == 2000 and len({make.ip(f"10.0.{a}.{b}") for a in range(40) for b in range(40)}) == 1600
    good = "411111111111111" + str(pii.luhn("411111111111111"))
    assert pii.luhn(make.card(good)[:-1]) == int(make.card(good)[-1])
    assert pii.replaced(documents(spark, texts)).columns == documents(spark, texts).columns


def test_surrogates_of_a_form_are_distinct(spark):
    """Forms that stay (555, area codes, listed names) take no other's surrogate; spellings of one entity are one entity."""
    make = pii.Surrogates()
    # the middle group that the plain move takes onto 555, and 555 itself
    middle = next(m for m in range(1000) if m != 555 and make.moved("phone", f"234{m:03d}0000")[3:6] == "555")
    tails = [f"({a}) {m:03d}-{n:04d}" for a, m in (("234", middle), ("234", 555)) for n in range(10_000)]
    assert len({make.phone(p) for p in tails}) == len(tails)
    # area codes below 200 that the plain move takes above, and the codes that stay above
    areas = {a: make.phone(f"({a}) 555-0000")[1:4] for a in (f"{a:03d}" for a in range(1000))}
    assert all((new >= "200") == (a >= "200") for a, new in areas.items()) and len(set(areas.values())) == 1000
    assert pii.same("phone", make.phone("+491701234567")) == pii.same("phone", make.phone("+49 170 1234567"))
    assert make.phone("(812) 555-9048")[1:] in make.phone("+1 (812) 555-9048")
    small = "bcdfghjklmnpqrstvwxyz"
    names = {a + b + c + d for a in "AEIOU" for b in small for c in small for d in "aeiou"}.union(*pii.NAMES.values())  # Anna and Emma are of this shape
    assert len({make.person(f"Mr. {n}") for n in names}) == len(names)
    zeros = documents(spark, ["from 10.01.2.3 and 10.1.2.3", *tails[::20]])
    out = {r.doc_id: r.text for r in pii.surrogates(zeros).collect()}
    assert len(set(re.findall(r"[\d.]+\d", out[0]))) == 1
    assert pii.collisions(zeros).count() == 0


def test_surrogates_are_injective_over_many_entities():
    """No two of very many entities of a kind share a surrogate, and no entity is its own; check digits stay right or wrong."""
    make, rng = pii.Surrogates(), random.Random(8)
    hosts = ["example.com", "mail1.example.com", "gmail.com", "gmail.com.example", "example.com.example", "foo.example", "foo.example.example", "a.b.co.uk", "wotep.com.example", "x.test"]
    small = "bcdfg"
    kinds = {
        "email": [f"{a}{b}{n}@{h}" for a in small for b in "aeiou" for n in range(100) for h in hosts],
        "ip": [f"{a}.{b}.{c}.{n}" for a in (0, 10, 127, 192, 223, 224, 255) for b in (0, 1, 255) for c in (0, 9) for n in range(256)],
        "card": [f"{n:015d}{d}" for n in rng.sample(range(10**15), 3000) for d in range(3)],
        "ssn": [f"{n // 10000:03d}-{n // 100 % 100:02d}-{n % 10000:04d}" for n in range(30_000)],
        "iban": [f"DE{c:02d}{n:018d}" for n in range(300) for c in range(100)],
        "phone": [p for n in range(3000) for p in (f"030 {1234000 + n}", f"06 12 34 {n // 100:02d} {n % 100:02d}", f"+49 170 {1234000 + n}", f"(234) 554-{n:04d}", f"(234) 555-{n:04d}")],
        "person": [f"{a}{b}{c} Smith" for a in small.upper() for b in "aeiou" for c in small] and [f"Mr. {n} {s}" for n in ("Mary", "John", "Zed", "Ivo") for s in ("Kobu", "Kebu", "Smith", "Иванов")] + ["Mary Kobu", "Anna Kobu", "Анна Иванова"],
    }
    for kind, entities in kinds.items():
        made = [getattr(make, kind)(e) for e in entities]
        assert len(set(map(lambda m: pii.same(kind, m), made))) == len({pii.same(kind, e) for e in entities}), kind
        assert all(m != e for m, e in zip(made, entities, strict=True)), kind
    assert all(make.email(e).endswith((".example", "example.com")) for e in kinds["email"])
    valid = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    assert valid("DE89370400440532013000") and valid(make.iban("DE89370400440532013000")) and valid(make.iban("GB82 WEST 1234 5698 7654 32").replace(" ", ""))
    assert make.iban("GB82 WEST 1234 5698 7654 32")[4] == " " and not valid(make.iban("DE88370400440532013000"))
    assert make.phone("030 1234567")[0] == "0" and make.phone("06 12 34 56 78")[0] == "0" and make.phone("+49 170 1234567").startswith("+49 ")


def test_names_without_titles_and_in_other_scripts(spark):
    texts = ["Mary Kobu wrote to Mrs. Mary Kobu", "г-жа Анна Петрова и Иван Сидоров", "Mary had a lamb", "call 06 12 34 56 78 or 030 1234567", "at somebody@gmail.com", "from 10.0.0.1 and 10.0.0.01, ３.1.2.3"]
    out = {r.doc_id: r for r in pii.surrogates(documents(spark, texts)).collect()}
    one, other = re.fullmatch(r"(\w+ \w+) wrote to Mrs. (\w+ \w+)", out[0].text).groups()
    assert one == other != "Mary Kobu" and one.split()[0] in pii.NAMES["female latin"]
    assert out[1].pii_kinds == ["person", "person"] and out[1].text.split()[1] in pii.NAMES["female cyrillic"] and "Сидоров" not in out[1].text
    assert out[2].text == texts[2] and out[3].pii_kinds == ["phone", "phone"] and out[4].text.endswith(".com.example") and "gmail" not in out[4].text
    assert len(out[5].pii_kinds) >= 2 and pii.collisions(documents(spark, texts)).count() == 0


def test_secrets(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'and token = "{h}" the rest' for h in hexes] + ["plain supercalifragilisticexpialidocious words number 12345678901234567890"] * 60 + [None, ""]
    kept = secret_scan.scan(documents(spark, texts)).collect()
    assert {r.value for r in kept} == set(hexes)
    assert secret_scan.scan(documents(spark, [None, ""])).count() == 0


def test_short_secrets_repeats_and_words_after(spark):
    texts = ["password: hunter2abc", "token = abc12345", "key : 'k3yk3yk3y'", '{"secret": "s3cr3t99"}', "pwd=short1", "the password hunter2abc", "plain hunter2abc"]
    got = {r.doc_id: r.value for r in secret_scan.candidates(documents(spark, texts)).collect()}
    assert got == {0: "hunter2abc", 1: "abc12345", 2: "k3yk3yk3y", 3: "s3cr3t99"}
    words = {"lies": 2.0, "secret": 1.0, "correct": 3.0, "horse": 3.0}
    one, other = (secret_scan.describe("abc12345", "id = ", after, "src/config/a.env", words) for after in (" is the secret", " lies here"))
    assert one != other and len(one) == len(secret_scan.FEATURES) and one[secret_scan.FEATURES.index("likely_path")] == 1
    assert secret_scan.covered("correcthorse-42", words) == 12 / 15 and secret_scan.covered("xq7zk", words) == 0
    assert secret_scan.describe("x" * 20, "", "", "", {})[:1] == [20]
    # half of the rows have one vector: it is sampled in its share, and the bound holds
    rows = [(i, 0, [1.0 if i % 2 else float(i)], float(i % 2)) for i in range(4000)] + [(None, 5, [2.0], 1.0)] * 3000
    kept = secret_scan.sample(spark.createDataFrame(rows, "doc_id long, start long, features array<double>, label double"), 700).collect()
    share = np.mean([r.features == [1.0] for r in kept])
    assert 200 < len(kept) <= 700 and 0.4 < share < 0.6


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_secret_forest_from_labelled_findings(spark):
    """Labelled places train it; on documents it has not learned from, it tells secrets from lookalikes of the same shape of place."""
    rng = random.Random(12)
    plain = "market river window correct horse battery staple garden paper silver mountain yellow winter summer".split()
    rows, truth = [], []
    for i in range(600):
        secret = i % 2 == 0
        if secret:
            value = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(20, 40)))
        else:
            value = rng.choice(("-", "_", "/")).join(rng.sample(plain, 4))
        name = rng.choice(("key", "value", "name"))
        text = f"the {rng.choice(plain)} of the {rng.choice(plain)} has {name} = {value} and the {rng.choice(plain)} is here"
        rows.append((i, text, "en", rng.choice(("app/config/prod.env", "app/docs/readme")), len(text)))
        truth.append((i, text.index(value), int(secret)))
    docs = spark.createDataFrame(rows, ROW)
    labelled = spark.createDataFrame([t for t in truth if t[0] % 3], "doc_id long, start long, label int")
    kept = {(r.doc_id, r.start) for r in secret_scan.scan(docs, labelled).collect()}
    held = [t for t in truth if t[0] % 3 == 0]
    hits = sum((d, s) in kept for d, s, y in held if y)
    false = sum((d, s) in kept for d, s, y in held if not y)
    assert hits / sum(y for *_, y in held) > 0.95 and hits / (hits + false) > 0.95
    x, y = np.array([[0.0], [1.0], [2.0], [3.0]] * 5), np.array([0.0, 0, 1, 1] * 5)
    trees = secret_scan.forest(np.hstack([x, x, x, x]), y)
    by_hand = []
    for row in np.hstack([x, x, x, x])[:4]:
        shares = []
        for nodes in trees:
            at = 0
            while nodes[at][0] >= 0:
                at = nodes[at][2] if row[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
            shares.append(nodes[at][4])
        by_hand.append(np.mean(shares))
    assert np.allclose(secret_scan.predict(trees, np.hstack([x, x, x, x])[:4]), by_hand) and by_hand[0] < 0.1 and by_hand[3] > 0.9


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= seen and len(now) > 0.5 * len(seen)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs, seen = out, now
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen
