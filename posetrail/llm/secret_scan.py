"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are key-shaped runs of 16 characters or more, and runs of 8 or more after a quote, = or :, or, with blanks between, after
password, secret, token or key. The forest sees length, character transitions and classes, entropy, coverage by a dictionary of the
corpus's own frequent words, the path (its depth, its last name and words like config or test) and the words before and after, how
frequent they are and whether they speak of secrets. It is trained from labelled findings (a table of places or features with a label);
``weak_labels`` labels findings of well-known formats where no hand labels exist. Learning uses a bounded sample by a hash of where a
finding stands, so a value that many documents repeat is sampled like others.

Null and empty texts have no candidates. Rows that repeat a doc_id are scanned each. Without two label values, all candidates stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared

LEARN_ROWS = 20_000
TREES, DEPTH = 25, 6

_FIND = re.compile(r"(?P<key>\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|key)\b[\"']?\s*[:=]\s*[\"']?)?(?P<value>(?(key)[A-Za-z0-9+/_-]{8,}={0,2}|(?:(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}|(?<=[=:\"'])[A-Za-z0-9+/_-]{8,})))", re.IGNORECASE)
#: Formats that are secrets wherever they stand.
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})$"
#: Words that stand before secrets.
CONTEXT = ("password", "passwd", "pwd", "secret", "token", "key", "bearer", "auth")
#: Words of the dictionary at most, and letters of the shortest.
DICTIONARY, SHORTEST = 50_000, 4
#: Words in a path that make secrets likelier, and less so.
LIKELY, UNLIKELY = ("config", "conf", "env", "settings", "credentials", "secret", "deploy", "prod"), ("test", "example", "sample", "doc", "docs", "fixture", "mock", "readme")

FEATURES = (
    "length", "upper", "lower", "digit", "other", "transitions", "entropy", "coverage", "hex", "runs", "after_key", "equals", "word_before", "seen_before",
    "key_after", "closed", "word_after", "seen_after", "depth", "likely_path", "unlikely_path", "name_0", "name_1", "name_2", "name_3",
)
_LETTERS = re.compile("[a-z]+")
_PATH = re.compile(r"[a-z0-9]+")


def dictionary(docs: DataFrame, limit: int = DICTIONARY) -> dict[str, float]:
    """The logarithm of the count of the most frequent words of a-z in the corpus, counted over all texts; ``limit`` words at most."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")).where(F.length("word") >= SHORTEST)
    counts = shared.stash(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    found, n = shared.most_frequent(counts, "word", "n", limit)
    shared.free(counts)
    return dict(zip(found.tolist(), np.log1p(n).tolist(), strict=True))


def covered(low: str, words: dict[str, float]) -> float:
    """The share of a value's characters inside dictionary words, the longest first from each place on."""
    total = 0
    for m in _LETTERS.finditer(low):
        run, at = m.group(), 0
        while at <= len(run) - SHORTEST:
            for end in range(min(len(run), at + 20), at + SHORTEST - 1, -1):
                if run[at:end] in words:
                    total += end - at
                    at = end
                    break
            else:
                at += 1
    return total / max(1, len(low))


def describe(value: str, before: str, after: str, source: str, words: dict[str, float]) -> list[float]:
    """FEATURES of one candidate."""
    n, low, near = len(value), value.lower(), before.lower()
    kinds = ["U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in value]
    shares = [value.count(c) / n for c in set(value)]
    last, first = _LETTERS.findall(near), _LETTERS.findall(after.lower())
    path = _PATH.findall(source.lower())
    name = zlib.crc32((path[-1] if path else "").encode())
    return [
        n, *(kinds.count(k) / n for k in "Uldo"), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), -sum(p * math.log2(p) for p in shares),
        covered(low, words), float(all(c in "0123456789abcdef" for c in low)), max((len(m) for m in re.findall(r"[A-Za-z]+|\d+", value)), default=0),
        float(any(w in near[-40:] for w in CONTEXT)), float(before.rstrip(" \"'")[-1:] in ("=", ":") if before.strip() else 0), float(len(last[-1]) if last else 0), words.get(last[-1], 0.0) if last else 0.0,
        float(any(w in after.lower() for w in CONTEXT)), float(after[:1] in ('"', "'")), float(len(first[0]) if first else 0), words.get(first[0], 0.0) if first else 0.0,
        float(source.count("/")), float(any(w in path for w in LIKELY)), float(any(w in path for w in UNLIKELY)), *(float(name >> k & 1) for k in range(4)),
    ]


def candidates(docs: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, start, value, before, features) of every candidate; a narrow job once the dictionary (by default the corpus's) is known."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if words is None else words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, values, before, rows = [], [], [], [], []
            for doc, text, path in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                for m in _FIND.finditer(text):
                    at = m.start("value")
                    ids.append(doc.as_py())
                    starts.append(at)
                    values.append(m["value"])
                    before.append(text[max(0, at - 60) : at])
                    rows.append(describe(m["value"], before[-1], text[m.end() : m.end() + 30], path.as_py(), known.value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(starts, pa.int64()), pa.array(values, pa.string()), pa.array(before, pa.string()), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "start", "value", "before", "features"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), source.alias("source")).mapInArrow(shared.tidy(run), f"doc_id {kind}, start long, value string, before string, features array<double>")


def weak_labels() -> Column:
    """1 for well-known formats and for hex or mixed values assigned to a key, 0 for plain words and numbers, else null."""
    assigned = F.col("before").rlike(r"(?i)(password|passwd|pwd|secret|token|key)\s*[:=]\s*[\"']?$")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    plain = F.col("value").rlike(r"^[A-Za-z]+$|^[0-9]+$|^[_=-]+$") & ~assigned
    return F.when(F.col("value").rlike(KNOWN) | (assigned & mixed), 1.0).when(plain, 0.0)


def forest(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[list[tuple]]:
    """Trees as node lists (feature, cut, left, right, share of label 1), grown on bootstrap rows and random features."""
    random = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES if len(np.unique(y)) > 1 else 0):
        rows, nodes = random.integers(0, len(y), len(y)), []

        def grow(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            at, share = len(nodes), float(y[rows].mean())
            nodes.append((-1, 0.0, -1, -1, share))
            if depth == 0 or len(rows) < 4 or share in (0.0, 1.0):
                return at
            best = (2 * share * (1 - share) - 1e-9, None)
            for k in random.choice(x.shape[1], 4, replace=False):
                for cut in np.unique(np.quantile(x[rows, k], np.linspace(0.05, 0.95, 12))):
                    low = x[rows, k] <= cut
                    n = low.mean()
                    if 0 < n < 1:
                        a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                        g = 2 * (n * a * (1 - a) + (1 - n) * b * (1 - b))
                        if g < best[0]:
                            best = (g, (int(k), float(cut), low))
            if best[1]:
                k, cut, low = best[1]
                left = grow(rows[low], depth - 1)
                nodes[at] = (k, cut, left, grow(rows[~low], depth - 1), share)
            return at

        grow(rows, DEPTH)
        trees.append(nodes)
    return trees


def predict(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    if not trees:
        return np.ones(len(x))
    total = np.zeros(len(x))
    for nodes in trees:
        f, cut, left, right, share = (np.array(c) for c in zip(*nodes, strict=True))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            inner = f[at] >= 0
            at = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at], left[at], right[at]), at)
        total += share[at]
    return total / len(trees)


def sample(findings: DataFrame, limit: int) -> DataFrame:
    """limit rows of findings at most, by a hash of (doc_id, start), or of the row where these are not known; rows that repeat all stand once."""
    place = [F.col(c) for c in ("doc_id", "start") if c in findings.columns]
    place = F.xxhash64(*(place if len(place) == 2 else [F.monotonically_increasing_id()]))
    part = int(1_000_000 * min(1.0, limit / max(findings.count(), 1)))
    chosen = findings.withColumn("place", place).where(F.pmod("place", F.lit(1_000_000)) < part)
    return chosen.select("place", "features", "label").distinct().orderBy("place", "features", "label").limit(limit)


def scan(docs: DataFrame, findings: DataFrame | None = None, fold: int = 0, threshold: float = 0.5, limit: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, start, value, score) of the findings kept.

    ``findings`` trains: (doc_id, start, label) of candidates of these documents, or (features, label) with doc_id and start if known.
    Without it, weak labels outside the fold do.
    """
    found = shared.stash(candidates(docs), "candidates")
    if findings is not None and "features" not in findings.columns:
        findings = found.select("doc_id", "start", "features").join(findings.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"])
    if findings is None:
        findings = found.where(shared.crc_mod() != fold).select("doc_id", "start", "features", weak_labels().alias("label")).where(F.col("label").isNotNull())
    rows = sample(findings, limit).select("label", "features").orderBy("features", "label").collect()  # limit rows at most
    x, y = np.array([r[1] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[0] for r in rows])
    trees = docs.sparkSession.sparkContext.broadcast(forest(x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(3).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(predict(trees.value, x))], names=["doc_id", "start", "value", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = found.select("doc_id", "start", "value", "features").mapInArrow(shared.tidy(run), f"doc_id {kind}, start long, value string, score double")
    return scored.where(F.col("score") >= threshold)
