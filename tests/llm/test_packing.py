"""Pattern packing: ids against the library on whole texts, every piece in one place, and the number of sequences against bounds."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posetrail.llm import packing
from posetrail.llm.queries import WORDS, vocabulary

LIMIT = 32
ODD = [
    None, "", " \n\t ", "one", "The quick brown fox's tail, and 'twas it'll 12,345 (x)!", "ÉCOLE Straße İstanbul ΣΑΣ ǅ ﬁn é ño ́start", "漢字かな 한국어 가 🙂🙂 👩‍👩‍👧", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "nul\0in\x1cside\x85of\xa0it", "don't can't we'll 's 't", "a" * 5000, "?!" * 3000, "1 22 333 " * 100, "word " * 5000 + "\x0b\x0c end", "$5.00&more;~^`|", "ﷺ Ǆ K Å",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORDS))


def whole(library, texts):
    return [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_ids_against_whole_texts(library):
    rng = random.Random(1)
    odd = [t for t in ODD if t] * 3
    texts = ODD + [" ".join(rng.choices([w for t in odd for w in t.split(" ") if len(w) < 40] + list("abcÉß'.,<|>"), k=rng.randint(0, 60))) for _ in range(300)]
    with open(vocabulary(WORDS), encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    for part in (texts, texts[::-1], texts[5:9]):  # kept words count as well; a slice has an offset
        ids, offsets = encoder.encode(pa.array([*texts[:3], *part], pa.string())[3:], 0)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets.tolist())] == whole(library, part)
    ids, offsets = encoder.encode(pa.array([None, ""], pa.string()), 7)
    assert ids.tolist() == [7, 7] and offsets.tolist() == [0, 1, 2]


@given(st.text(alphabet="abÉßé'’.,!<|> \ņ́İΣ漢1٣\x1c\xa0K", max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_of_any_text(text):
    ids, _ = encoder_once().encode(pa.array([text]), 0)
    assert ids.tolist() == whole(library_once(), [text])[0]


def encoder_once(kept=[]):
    if not kept:
        with open(vocabulary(WORDS), encoding="utf-8") as f:
            kept.append(packing.WordEncoder(f.read()))
    return kept[0]


def library_once():
    return encoder_once().library


def test_words_are_forgotten_in_time(library, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    with open(vocabulary(WORDS), encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    for k in range(20):
        texts = [" ".join(f"w{(k * 7 + i) % 90}x" for i in range(30))] * 2
        ids, _ = encoder.encode(pa.array(texts), 0)
        assert ids.tolist() == sum(whole(library, texts), [])
        assert len(encoder.kept) <= 80


def held(packed, limit):
    """Every sequence is gapless from 0 and no longer than the limit."""
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_every_piece_has_its_place(spark, library):
    texts = [(k % 50, t) for k, t in enumerate(ODD * 2)] + [(None, "x y z")] + [(9, "same words here")] * 300 + [(k, "w " * (k % 90)) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("part", "rank", "length", "slot", "n")})
    got = packing.pack(docs.repartition(5), vocabulary(WORDS), limit=LIMIT, keep_ids=True)
    rows = got.collect()
    expected = sorted((str(i), n, a, tuple(ids[a : a + LIMIT])) for (i, _), ids in zip(texts, whole(library, [t for _, t in texts]), strict=True) for n, a in enumerate(range(0, len(ids), LIMIT)))
    assert sorted((str(r.doc_id), r.piece, r.start, tuple(r.ids)) for r in rows) == expected
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    used, tokens = held(rows, LIMIT), sum(r.length for r in rows)
    assert -(-tokens // LIMIT) <= used <= 1.02 * tokens / LIMIT + 1
    made = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert len(made) == used and all(made[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, vocabulary(WORDS)).count() == 0


def places(plan):
    used = {}
    for parts, bins in plan.groups:
        assert bins > 0 and sum(n * c for n, c in parts) <= plan.limit
        for n, c in parts:
            used[n] = used.get(n, 0) + c * bins
    return used


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=64), st.sampled_from([8, 16, 64]))
@settings(max_examples=150, deadline=None)
def test_plans_place_every_piece_once(histogram, classes):
    plan = packing.plan(histogram, 64, classes)
    assert places(plan) == {n: c for n, c in histogram.items() if c}
    runs, slots = plan.runs(), {}
    for n, first, sequence, copies, offset in zip(*(runs[k].tolist() for k in ("length", "first", "sequence", "copies", "offset")), strict=True):
        slots.setdefault(n, []).append((first, copies, sequence, offset))
    for n, found in slots.items():  # numbers of a length are used without a gap
        at = 0
        for first, _, _, _ in found:
            assert first >= at
            at = first


def test_few_sequences():
    """Within a thousandth of the tokens' bound on a wide spread of lengths; the patterns carry most of the tokens."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6.4, 1, 200_000).astype(int) + 1)
    n, c = np.unique(lengths, return_counts=True)
    plan = packing.plan(dict(zip(n.tolist(), c.tolist(), strict=True)))
    bound = -(-int(lengths.sum()) // 2048)
    assert bound <= plan.sequences <= 1.001 * bound
    assert len(plan.groups) < 6_000


def test_exhaustive_packing_of_few_pieces():
    """Never more than one sequence above the best of all packings."""
    rng = random.Random(5)

    def best(left, rooms):
        if not left:
            return len(rooms)
        first, tries = left[0], set()
        out = best(left[1:], [*rooms, 12 - first])
        for k, room in enumerate(rooms):
            if room >= first and room not in tries:
                tries.add(room)
                out = min(out, best(left[1:], [*rooms[:k], room - first, *rooms[k + 1 :]]))
        return out

    for _ in range(40):
        sizes = [rng.randint(1, 12) for _ in range(8)]
        assert packing.plan({n: sizes.count(n) for n in set(sizes)}, 12).sequences <= best(sorted(sizes, reverse=True), []) + 1


def test_fit_against_brute_force():
    """The least squares over all supports of three patterns, and the conditions of an optimum on many."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        rows = packing.patterns(np.array([False, *(rng.random(8) < 0.7)]), 3)
        target = np.concatenate([[0], rng.integers(0, 50, 8)]).astype(float)
        weights = np.arange(9) / 8
        x = packing.fitted_repeats(rows, target, weights)
        if not len(rows):
            continue
        a = weights[:, None] * np.stack([np.bincount(r, minlength=9) for r in rows], axis=1)
        a[0] = 0
        gradient = a.T @ (weights * target - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-4 * max(1, target.max())).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-4 * max(1, target.max())


def test_patterns_against_enumeration():
    present = np.array([False, True, False, True, True, True, False, False, True])
    expected = sorted(c for k in (1, 2, 3) for c in itertools.combinations_with_replacement((1, 3, 4, 5, 8), k) if sum(c) == 8)
    assert sorted(tuple(v for v in r if v) for r in packing.patterns(present, 3).tolist()) == expected
