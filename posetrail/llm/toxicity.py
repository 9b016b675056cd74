"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with a gap of a text, hashed to 2^20 places. Learning rates are per coordinate
and the L1 term leaves few weights, which are broadcast (at most 2^20). Learning uses a bounded, hashed sample of labelled rows.
Null and empty texts get the score of no features. Rows that repeat a doc_id are scored each. Without two label values to learn
from, scores are the (clipped) share of the label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared

BITS = 20
#: About so many labelled rows at most are learned from.
LEARN_ROWS = 16_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, places) of words, pairs and gapped pairs, repeats included."""
    low = shared.lowered(data)
    starts, ends, docs = shared.spans(low, offsets, shared.NON_ALNUM)
    words = shared.span_hashes(low, starts, ends)
    parts = [(words, docs), shared.chained(words, docs, (0, 1), 2), shared.chained(words, docs, (0, 2), 3)]
    shift = np.uint64(64 - BITS)
    return np.concatenate([d for _, d in parts]), np.concatenate([(h >> shift).astype(np.int64) for h, _ in parts])


def _distinct(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(docs << BITS | places)
    return both >> BITS, both & ((1 << BITS) - 1)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) after passes over rows of distinct places, in their order."""
    z, n, rate = np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, bias_n = float(np.log(rate / (1 - rate))), 1.0
    if len(np.unique(labels)) < 2:
        return z, bias

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for places, y in zip(rows, labels, strict=True):
            zs, ns = z[places], n[places]
            w = weights(zs, ns)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[places] = zs + g - sigma * w
            n[places] = ns + g * g
            bias_n += g * g
            bias -= ALPHA / np.sqrt(bias_n) * g
    return weights(z, n), bias


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 0, limit: int = LEARN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the non-zero weights, from labelled rows outside the fold."""
    chosen = shared.learning_rows(docs, labels, label, fold, limit)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in shared.slices(batch):
                of, places = _distinct(*features(data, offsets))
                cuts = np.searchsorted(of, np.arange(end - at + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), lists], names=["doc_id", "label", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], []
        for batch in batches:
            lists = batch.column(2)
            flat, cuts = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            cuts = cuts - cuts[0]
            rows += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            known.append(np.asarray(batch.column(1)))
        w, bias = ftrl(rows, np.concatenate(known) if known else np.zeros(0))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*w[at].tolist(), bias])], names=["place", "weight"])

    sampled = chosen.mapInArrow(shared.tidy(extract), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label double, places array<int>")
    one = sampled.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id")  # a bounded sample
    fitted = one.mapInArrow(shared.tidy(fit), "place long, weight double").collect()
    model = {r[0]: r[1] for r in fitted}
    bias = model.pop(-1, 0.0)
    places = np.array(sorted(model), dtype=np.int64)
    return places, np.array([model[p] for p in places.tolist()]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = shipped.value
        dense = np.zeros(1 << BITS)
        dense[places] = weights
        for batch in batches:
            for at, end, data, offsets in shared.slices(batch):
                of, found = features(data, offsets)
                held = dense[found] != 0
                of, found = _distinct(of[held], found[held])
                total = bias + np.bincount(of, weights=dense[found], minlength=end - at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(shared.tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted of every row of docs, learned without the held-out fold."""
    scored = score(docs, learn(docs, labels, fold=fold))
    return scored.select("doc_id", F.coalesce(shared.crc_mod() == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
