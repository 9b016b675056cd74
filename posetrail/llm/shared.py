"""Intermediate tables in the shared folder, and vectorised text helpers for Arrow batches.

Nulls count as empty texts everywhere in this subpackage unless a docstring says otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posetrail.operators import lineage

#: Bytes of text that the numpy helpers take at once; their temporaries are about 30 times that.
SLICE_BYTES = 1_000_000

_STASHED: weakref.WeakKeyDictionary[DataFrame, tuple[str, str | None]] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which goes when the session stops; only a local session may leave that unset."""
    folder = f"{lineage.root(spark)}/posetrail-{spark.sparkContext.applicationId}"
    lineage.gone_at_stop(spark, folder)
    return folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: it cuts lineage and gives later joins true sizes.

    It stays until ``free`` or the end of the application; operators free what their result no longer reads.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STASHED[out] = (path, None)
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stash``, one row for each key, as a table bucketed by it, so that joins on the key do not move its rows again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", f"posetrail_{uuid.uuid4().hex}"
    df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    _STASHED[out] = (path, table)
    return out


def free(*stashes: DataFrame) -> None:
    """Delete stashes whose last reader has run."""
    for df in stashes:
        if known := _STASHED.pop(df, None):
            if known[1]:
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {known[1]}")
            lineage.delete(df.sparkSession.sparkContext, known[0])


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def most_frequent(table: DataFrame, key: str, count: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the most frequent keys, by count and then key: ``limit`` at most and near it where counts allow, those above a
    threshold found by a histogram of counts, so no task sends more than it holds of them. Keys of equal count come or stay together."""
    step = F.floor(F.log2(F.col(count)) * 16)
    bars = sorted(table.where(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max(count).alias("most")).collect(), reverse=True)
    least, total = None, 0
    for bar in bars:  # some 16 a doubling
        total += bar["n"]
        if total > limit:
            least = bar["most"]
            break
    rows = table.where(F.col(count) > 0) if least is None else table.where(F.col(count) > least)
    found = rows.select(key, count).toArrow()
    keys, counts = (found.column(k).to_numpy() for k in (0, 1))
    order = np.lexsort((keys, -counts))
    return keys[order], counts[order]


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows, as texts are long; a session that has its own setting keeps it."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, which gives freed memory back when it ends: Spark keeps its Python workers, and they would keep the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)

    return run


def crc_mod(column: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_labels(labels: DataFrame, label: str, fold: int, limit: int) -> DataFrame:
    """(doc_id, label double) of about ``limit`` labelled rows at most, outside the held-out fold, spread by a hash of doc_id.

    Rows with a null id or label are left out; a doc_id labelled more than once takes its largest label.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod() != fold))
        .groupBy("doc_id").agg(F.max(F.col(label)).cast("double").alias("label"))
    )
    n = rows.count()
    part = int(1_000_000 * min(1.0, limit / max(n, 1)))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, limit: int) -> DataFrame:
    """(doc_id, label, text) to learn from: about ``limit`` ids at most, and one row each (of texts that repeat an id, that of the least hash)."""
    sample = F.broadcast(bounded_labels(labels, label, fold, limit))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    return rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))


# --- numpy helpers: texts as one byte buffer with offsets ---

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes between words: space and \x09-\x0D.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: Bytes between words made of ASCII letters and digits and of all other characters.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, each run about SLICE_BYTES or one long text."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each run of bytes that are not in ``between``; runs end with their document."""
    inside = ~between[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over prefix sums, then mixed with the length."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    return mix(value ^ (mix((ends - starts).astype(np.uint64))))


def chained(words: np.ndarray, docs: np.ndarray, steps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at i + steps, where all lie in one document, with those documents."""
    last = max(steps)
    if len(words) <= last:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = len(words) - last
    value = np.full(n, salt, dtype=np.uint64)
    for s in steps:
        value = (value * np.uint64(0xD6E8FEB86659FD93)) ^ words[s : s + n]
        value ^= value >> np.uint64(29)
    same = docs[:n] == docs[last : last + n]
    return mix(value[same]), docs[:n][same]


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte mask within each document."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
