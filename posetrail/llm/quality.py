"""Quality scores by a sparse rule ensemble.

Small boosted trees over text statistics give conjunctive rules (their paths); a lasso logistic regression keeps few of them; the
rules compile to one Spark column over the statistics. Learning uses the statistics of a bounded, hashed sample of labelled rows.
Null and empty texts have zero statistics and are scored. Rows that repeat a doc_id are scored each. Without two label values to
learn from, the score is the (clipped) share of the label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posetrail.llm import shared

#: About so many labelled rows at most are learned from; their statistics (not texts) reach the driver.
LEARN_ROWS = 20_000
TREES, DEPTH, SHRINK, BINS, LEAST_LEAF = 40, 3, 0.3, 32, 10
LASSO, STEPS = 0.002, 400

STATS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "stops", "symbols", "pipes", "non_ascii", "line_ends",
    "distinct_words", "distinct_pairs", "distinct_lines", "words_in_line", "long_words",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_MARKS = _table("!?")
_STOPS = _table(".,;:'\"()-")
_SYMBOLS = _table("#$%&*+/<=>@[\\]^_`{}~")
_PIPES = _table("|")
_HIGH = np.arange(256) >= 128


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per_byte = np.maximum(size, 1)
    starts, ends, docs = shared.spans(data, offsets, shared.BLANKS)
    words = np.bincount(docs, minlength=n)
    some = np.maximum(words, 1)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.bincount(of, minlength=n)
        order = np.lexsort((hashes, of))
        h, o = hashes[order], of[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.where(total > 0, np.bincount(o[new], minlength=n) / np.maximum(total, 1), 1.0)

    hashes = shared.span_hashes(data, starts, ends)
    pairs, pair_docs = shared.chained(hashes, docs, (0, 1), 2)
    line_starts, line_ends, line_docs = shared.spans(data, offsets, shared.NEWLINE)
    lines = np.maximum(np.bincount(line_docs, minlength=n), 1)
    length = ends - starts
    share = [shared.per_doc(t[data], offsets) / per_byte for t in (_UPPER, _DIGITS, _MARKS, _STOPS, _SYMBOLS, _PIPES, _HIGH, shared.NEWLINE)]
    return np.stack([
        np.log1p(size), np.log1p(words), np.bincount(docs, weights=length, minlength=n) / some, *share,
        distinct(hashes, docs), distinct(pairs, pair_docs), distinct(shared.span_hashes(data, line_starts, line_ends), line_docs),
        words / lines, np.bincount(docs[length > 14], minlength=n) / some,
    ], axis=1)


def with_statistics(docs: DataFrame, names: list[str], keep_text: bool = False) -> DataFrame:
    """docs with the statistics of text under these names (one for each of STATS); without text unless kept. A narrow job."""
    kept = [c for c in docs.columns if c != "text" or keep_text]
    held = [docs.columns.index(c) for c in kept]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in shared.slices(batch):
                table = np.round(statistics(data, offsets), 9)
                others = [batch.column(k).slice(at, end - at) for k in held]
                yield pa.RecordBatch.from_arrays([*others, *(pa.array(c) for c in np.ascontiguousarray(table.T))], names=[*kept, *names])

    return docs.mapInArrow(shared.tidy(run), schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, cut) parts, all of which hold


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule], leaf: np.ndarray) -> None:
    if path:
        out.append(path)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf[rows] = -total_g / (total_h + 1.0)
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return
    best, where = 1e-6, None
    for k in range(bins.shape[1]):
        if not len(cuts[k]):
            continue
        of = bins[rows, k]
        cg, ch, cn = (np.cumsum(np.bincount(of, weights=w, minlength=len(cuts[k]) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
        gain[(cn < LEAST_LEAF) | (len(rows) - cn < LEAST_LEAF)] = 0
        if gain.max(initial=0) > best:
            best, where = gain.max(), (k, int(gain.argmax()))
    if where is None:
        return
    k, b = where
    low = bins[rows, k] <= b
    _grow(bins, cuts, g, h, rows[low], depth - 1, (*path, (k, False, float(cuts[k][b]))), out, leaf)
    _grow(bins, cuts, g, h, rows[~low], depth - 1, (*path, (k, True, float(cuts[k][b]))), out, leaf)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [x[:, k] > c if greater else x[:, k] <= c for k, greater, c in rule])


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, bias)."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return [], bias
    cuts = []
    for k in range(x.shape[1]):
        u = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(u[u < x[:, k].max()])
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        leaf = np.zeros(len(y))
        _grow(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), rules, leaf)
        z += SHRINK * leaf
    rules = list(dict.fromkeys(rules))
    table = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    w, v, momentum = np.zeros(len(rules)), np.zeros(len(rules)), 1.0
    b = vb = bias
    step = 4.0 / (np.linalg.norm(table, 2) ** 2 / len(y) + 1.0)
    for _ in range(STEPS):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-(table @ v + vb))) - y
        new = v - step * (table.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_b = vb - step * error.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    return [(r, float(c)) for r, c in zip(rules, w, strict=True) if c], float(b)


def compiled(rules: list[tuple[Rule, float]], bias: float, names: Sequence[str] = STATS) -> Column:
    """The score as a column over the statistics, which have these names."""

    def condition(rule: Rule) -> Column:
        return reduce(Column.__and__, [F.col(names[k]) > c if greater else F.col(names[k]) <= c for k, greater, c in rule])

    total = F.lit(bias)
    for rule, weight in rules:
        total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 0, limit: int = LEARN_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    """Rules and bias from a bounded sample of labelled rows; only its texts are described, and only its statistics reach the driver."""
    rows = with_statistics(shared.learning_rows(docs, labels, label, fold, limit), list(STATS)).collect()
    table = np.array(sorted(map(tuple, rows)), dtype=float).reshape(-1, len(STATS) + 2)
    return fit_rules(table[:, 2:], table[:, 1])


def quality(docs: DataFrame, labels: DataFrame, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted of every row of docs, learned without the held-out fold; a narrow job once learned."""
    rules, bias = learn(docs, labels, fold=fold)
    scored = with_statistics(docs.select("doc_id", "text"), list(STATS)).select("doc_id", compiled(rules, bias).alias("score"))
    return scored.select("doc_id", F.coalesce(shared.crc_mod() == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """docs without the rejected rows: each row is described, judged and dropped or kept in its place, without a join."""
    rules, bias = learn(docs, labels, fold=fold)
    names = [shared.free_name(docs, s) for s in STATS]
    return with_statistics(docs, names, keep_text=True).where(compiled(rules, bias, names) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
