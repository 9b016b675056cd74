"""Fill-in-the-middle: texts cut at two ranks and put in another order.

A text is a list of units (a word with the blanks before it, or blanks at the end). An indexable skip list over the units answers
where a rank lies: every ``FAN``-th node of a lane is a node of the express lane above, and each link carries how many units and how
many code points it passes. A search adds widths from the highest lane down, so it reaches both cut ranks exactly in
``FAN * log_FAN(units)`` steps, and all texts of a slice are searched side by side.

The ranks and the form come from ``sha256(seed:id)`` alone, so repeated rows and retried tasks give the same output. A null id counts as
an empty string, a null text as an empty one (form plain, no units). Columns of docs with the names of the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posetrail.llm import shared

#: Links of a lane that one link of the next lane passes.
FAN = 16
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIELDS = (("fim_units", T.LongType()), ("fim_form", T.StringType()), ("fim_prefix_chars", T.LongType()), ("fim_middle_chars", T.LongType()), ("fim_text", T.StringType()))


class SkipLists:
    """One skip list for each text, lane by lane; ``points`` are the code points of all units, ``counts`` the units of each text."""

    def __init__(self, points: np.ndarray, counts: np.ndarray):
        self.lanes = [self._lane(np.ones(len(points), dtype=np.int64), points, counts)]
        while counts.max(initial=0) > FAN:
            _, units, points, counts = self.lanes[-1]
            groups = -(-counts // FAN)
            begins = np.cumsum(counts) - counts
            text = np.repeat(np.arange(len(counts)), groups)
            within = np.arange(len(text)) - np.repeat(np.cumsum(groups) - groups, groups)
            heads = begins[text] + within * FAN
            units, points, counts = np.add.reduceat(units, heads), np.add.reduceat(points, heads), groups
            self.lanes.append(self._lane(units, points, counts))

    @staticmethod
    def _lane(units: np.ndarray, points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.cumsum(counts) - counts, units, points, counts

    def points_before(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before the unit of each text's rank (0 to its number of units)."""
        left, passed, place = ranks.astype(np.int64), np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for first, units, points, counts in reversed(self.lanes):
            going = np.flatnonzero(left > 0)
            while len(going):
                going = going[place[going] < counts[going]]
                at = first[going] + place[going]
                fits = units[at] <= left[going]
                going, at = going[fits], at[fits]
                left[going] -= units[at]
                passed[going] += points[at]
                place[going] += 1
                going = going[left[going] > 0]
            place *= FAN
        return passed


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each unit, units of each text): a unit begins with its text and at each blank that follows a word."""
    blank = shared.BLANKS[data]
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = blank[1:] & ~blank[:-1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    counts = shared.per_doc(begins, offsets)
    leads = (data & 0xC0) != 0x80
    return np.add.reduceat(leads, np.flatnonzero(begins), dtype=np.int64) if len(data) else np.zeros(0, dtype=np.int64), counts


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with fim_units, fim_form (plain, psm or spm), fim_prefix_chars, fim_middle_chars (null if plain) and fim_text.

    ``rate`` of 100 texts are reordered, ``spm`` of 100 of these with the suffix first. Texts that are empty or hold a mark stay plain.
    A narrow job without a shuffle; whole texts.
    """
    docs = docs.drop(*(n for n, _ in FIELDS))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = shared.free_name(docs, "draws")
    drawn = docs.withColumn(draws, F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != draws]
            column = batch.column(batch.schema.get_field_index(text))
            h = batch.column(batch.schema.get_field_index(draws)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for at, end, data, offsets in shared.slices(batch, text):
                points, n = units(data, offsets)
                a, b = np.sort(h[at:end, :2] % (n[:, None] + 1), axis=1).T
                lists = SkipLists(points, n)
                cuts = zip(lists.points_before(a).tolist(), lists.points_before(b).tolist(), h[at:end, 2:].tolist(), strict=True)
                rows = [arranged(t or "", i, j, form(t or "", *draw, rate, spm)) for t, (i, j, draw) in zip(column.slice(at, end - at).to_pylist(), cuts, strict=True)]
                out = [pa.array(n, pa.int64()), *(pa.array(c, pa.string() if k in (0, 3) else pa.int64()) for k, c in enumerate(zip(*rows, strict=True)))]
                part = batch.slice(at, end - at).select(names)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*names, *(f for f, _ in FIELDS)])

    return drawn.mapInArrow(shared.tidy(run), schema)


def form(text: str, h3: int, h4: int, rate: int, spm: int) -> str:
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def arranged(text: str, i: int, j: int, kind: str) -> tuple[str, int | None, int | None, str]:
    """(form, code points of the prefix, of the middle, output) of a text cut before the code points i and j."""
    if kind == "plain":
        return kind, None, None, text
    prefix, suffix = PREFIX + text[:i], SUFFIX + text[j:]
    return kind, i, j - i, (suffix + prefix if kind == "spm" else prefix + suffix) + MIDDLE + text[i:j]


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. A mark can't begin inside a part, as no part holds one and marks don't overlap."""

    def cut(rest: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, mark, 1)
        return head, F.substr(rest, F.length(head) + 1 + len(mark))

    first, rest = cut(F.substr(output, F.lit(1 + len(PREFIX))), SUFFIX)
    second, middle = cut(rest, MIDDLE)
    psm = F.concat(first, middle, second)
    first, rest = cut(F.substr(output, F.lit(1 + len(SUFFIX))), PREFIX)
    second, middle = cut(rest, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(second, middle, first))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of a ``fill_middle`` result."""
    return docs.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("fim_form"), F.col("fim_text")).cast("binary"), 256).alias("restored_sha256"),
    )
