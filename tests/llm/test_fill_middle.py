"""Fill-in-the-middle against a brute-force version by regular expressions, the skip list against prefix sums, and odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posetrail.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = " ".join(f"wörd{i % 977},  some: {i}" for i in range(60_000)) + " tail \n"
TEXTS = [
    (1, "the quick  brown fox"), (1, "the quick  brown fox"), (2, None), (3, ""), (4, " \n\t"), (None, "no number here"), (None, None), (5, LONG), (6, "a <P> inside of it"), (7, "<S"), (8, "<S> x y"), (9, "M> <M x"),
    (10, "é漢字 ▁   𝔘 \x1c\x85 end "), (11, "nul\0inside of it"), (12, "one"), *((k, f"  text {k} <P <S < M> and> {'more ' * (k % 37)}") for k in range(13, 240)),
]


def plain_row(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    parts = UNIT.findall(t)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_rows_against_brute_force(spark, docs):
    clash = docs.withColumns({c: F.lit("kept") for c in ("draws", "fim_form", "n", "form")})
    got = fill_middle.fill_middle(clash.repartition(3))
    rows = got.withColumn("back", fill_middle.restored(F.col("fim_form"), F.col("fim_text"))).collect()
    fields = [(str(r.doc_id), r.text, r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) for r in rows]
    assert sorted(fields, key=str) == sorted(((str(i), t, *plain_row(i, t)) for i, t in TEXTS), key=str)
    assert all(r.back == (r.text or "") for r in rows) and all(r.draws == r.n == "kept" for r in rows)
    assert {r.fim_form for r in rows} == {"plain", "spm", "psm"}


def test_digests_and_no_rows(spark, docs):
    rows = fill_middle.digests(fill_middle.fill_middle(docs)).collect()
    expected = sorted(((str(i), n, f, p, m, hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS for n, f, p, m, o in [plain_row(i, t)]), key=str)
    assert sorted(((str(r[0]), *r[1:]) for r in rows), key=str) == expected
    assert fill_middle.digests(fill_middle.fill_middle(docs.limit(0))).count() == 0


@given(st.lists(st.lists(st.integers(1, 9), max_size=700), min_size=1, max_size=6), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_skip_lists_against_prefix_sums(texts, seed):
    rng = random.Random(seed)
    ranks = [rng.randint(0, len(t)) for t in texts]
    lists = fill_middle.SkipLists(np.array([p for t in texts for p in t], dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64))
    assert lists.points_before(np.array(ranks)).tolist() == [sum(t[:r]) for t, r in zip(texts, ranks, strict=True)]


@given(st.lists(st.text(alphabet="ab<PSM> \n\té漢𝔘\x1c\0", max_size=60), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_units_of_any_text(texts):
    raw = [t.encode() for t in texts]
    points, counts = fill_middle.units(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    found = [UNIT.findall(t) for t in texts]
    assert counts.tolist() == [len(u) for u in found] and points.tolist() == [len(x) for u in found for x in u]
