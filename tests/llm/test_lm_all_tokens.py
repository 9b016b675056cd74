"""Every position of a shard is contrasted."""

import numpy as np

from posetrail.llm import lm


def test_a_shard_leaves_no_token_out(monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "nce", lambda token, one, two, layout, p: seen.append((token, one, two)) or p)
    layout = lm.Layout.of(np.ones(lm.FIRST + 40))
    ids = np.random.default_rng(1).integers(lm.FIRST, lm.FIRST + 40, 900_000)
    lengths = np.array([400_000, 0, 1, 499_999])
    tokens, _ = lm.fitted_shard(ids, lengths, layout, lm.start(layout))
    (token, one, two), = seen
    assert tokens == len(token) == 900_004 and (token == lm.END).sum() == 4
    assert (token[token != lm.END] == ids).all() and (one == lm.START).sum() == 4 and (two == lm.START).sum() == 7


def test_a_fact_of_one_place_is_learned():
    """A symbol that follows another at every 9th token only, so that evenly spaced tokens may miss it."""
    random, n = np.random.default_rng(2), 360_000
    ids = random.integers(lm.FIRST, lm.FIRST + 60, n)
    ids[1::9], ids[2::9] = lm.FIRST + 60, lm.FIRST + 61
    layout = lm.Layout.of(np.bincount(ids, minlength=lm.FIRST + 62) + 0.5)
    _, values = lm.fitted_shard(ids, np.full(4, n // 4), layout, lm.start(layout))
    p = lm.shaped(values, lm.start(layout))
    said = lambda p: lm.log_probabilities(np.array([lm.FIRST + 61]), np.array([lm.FIRST + 60]), np.array([lm.FIRST + 3]), layout, p)[0]
    assert said(p) > said(lm.start(layout)) + 1


def test_chunks_of_logits_change_no_probability(monkeypatch):
    """Logits are worked out in small matrices, in place, and every symbol's probability is normalised all the same."""
    rng = np.random.default_rng(5)
    layout = lm.Layout.of(rng.integers(1, 500, 60).astype(float))
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in lm.start(layout).items()}
    can = np.array([s for s in range(60) if s != lm.START])
    one, two = np.full(len(can), 20), np.full(len(can), 21)
    whole = lm.log_probabilities(can, one, two, layout, p)
    assert np.isclose(np.exp(whole).sum(), 1, atol=1e-5)
    monkeypatch.setattr(lm, "ROWS", 7)
    monkeypatch.setattr(lm, "CELLS", 20)
    assert np.allclose(lm.log_probabilities(can, one, two, layout, p), whole, atol=1e-5)
