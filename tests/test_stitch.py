"""The new layout of bouts against a plain walk over frames."""

import random

from posetrail.operators import runs, stitch


def walked(seq, neutral, eps, least):
    out, at = list(seq), 0
    while at < len(seq):
        end = at
        while end < len(seq) and (seq[end] in neutral) == (seq[at] in neutral):
            end += 1
        if seq[at] not in neutral:
            out[at:end] = walked_segment(seq[at:end], eps, least)
        at = end
    return out


def walked_segment(seq, eps, least):
    n, w = len(seq), list(seq)
    if n < 3:
        return w
    for v in sorted(set(seq)):
        if seq.count(v) < 3:
            for i in [i for i, x in enumerate(w) if x == v]:
                w[i] = w[i - 1] if i else w[1]
    clusters = []
    for v in sorted(set(w)):
        for i in (i for i, x in enumerate(w) if x == v):
            if clusters and clusters[-1][0] == v and i - clusters[-1][1][-1] <= eps:
                clusters[-1][1].append(i)
            else:
                clusters.append((v, [i]))
    taken, waiting = [None] * n, []
    for v, places in sorted(clusters, key=lambda c: len(c[1])):
        k, middle = len(places), int(sum(places) / len(places) + 0.5)
        start = middle - k // 2
        start -= max(0, start + k - n)
        free = lambda a: a + k <= n and all(x is None for x in taken[a : a + k])  # noqa: B023, E731
        if k >= least and free(start):
            taken[start : start + k] = [v] * k
        elif k >= least and taken[start] is not None and taken[start + k - 1] is None and free(start + 1):
            taken[start + 1 : start + 1 + k] = [v] * k
        else:
            waiting.append((sum(places) / k, v, k))
    fill = [v for _, v, k in sorted(waiting, key=lambda c: c[0]) for _ in range(k)]
    for i in range(n):
        if taken[i] is None:
            taken[i] = fill.pop(0)
    cuts = [0, *(i for i in range(1, n) if taken[i] != taken[i - 1]), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a < least and (a == 0 or taken[a] != taken[a - 1]):
            if a or b < n:
                taken[a:b] = [taken[a - 1] if a else taken[b]] * (b - a)
    return taken


def bouts(rng, n, labels, longest):
    out = []
    while len(out) < n:
        out += [rng.choice(labels)] * rng.randint(1, longest)
    return out[:n]


def check(spark, videos, neutral, eps, least):
    rows = [(v, f, x) for v, seq in enumerate(videos) for f, x in enumerate(seq)]
    df = spark.createDataFrame(rows, "video_id bigint, frame bigint, label int")
    got = {(r.video_id, r.frame): r.label for r in stitch.stitched(df.repartition(3), "label", neutral, eps, least).collect()}
    assert len(got) == len(rows)
    for v, seq in enumerate(videos):
        assert [got[v, f] for f in range(len(seq))] == walked(seq, neutral, eps, least), (v, seq[:50])


def test_small_segments(spark):
    """All beginnings with rare labels, ends, ties of size and of centre."""
    rng = random.Random(1)
    check(spark, [bouts(rng, rng.randint(1, 25), [0, 1, 2, 3, 4], rng.choice([1, 2, 5])) for _ in range(600)], (0,), 2, 3)


def test_other_parameters(spark):
    rng = random.Random(2)
    videos = [bouts(rng, rng.randint(1, 200), [0, 1, 2, 3, 100], 9) for _ in range(80)]
    check(spark, videos, (100,), 5, 3)
    check(spark, videos, (0, 100), 0, 5)
    check(spark, videos, (7,), 20, 1)


def test_long_segments(spark, monkeypatch):
    """Segments of 10,000 frames over many blocks, one of them without a neutral frame."""
    monkeypatch.setattr(runs, "BLOCK", 512)
    rng = random.Random(3)
    check(spark, [bouts(rng, 10_000, [1, 2, 3, 4, 5], 12), bouts(rng, 10_000, [0, *range(1, 60)], 6)], (0,), 5, 3)


def test_missing_frames_nulls_and_no_rows(spark):
    rows = [(1, f, 2 if f % 7 else 3) for f in range(40)] + [(1, f, 1 + f % 2) for f in range(50, 60)] + [(1, 45, None), (2, 0, 5), (2, 1, 6)]
    df = spark.createDataFrame(rows, "video_id bigint, frame bigint, label int")
    got = {(r.video_id, r.frame): r.label for r in stitch.stitched(df, "label", (0,)).collect()}
    assert [got[1, f] for f in range(40)] == walked([2 if f % 7 else 3 for f in range(40)], (0,), 5, 3)
    assert [got[1, f] for f in range(50, 60)] == walked([1 + f % 2 for f in range(50, 60)], (0,), 5, 3)
    assert got[1, 45] is None and (got[2, 0], got[2, 1]) == (5, 6)
    assert stitch.stitched(df.limit(0), "label", (0,)).count() == 0
