"""Pattern packing: documents as token ids, packed into sequences of a fixed length by non-negative least squares.

1. Each task encodes its texts, appends the end id, cuts what is longer than a sequence, and numbers its pieces of each length.
2. The histogram of lengths (as many rows as a sequence has tokens, at most) comes to the driver. Patterns of few documents whose
   length classes fill a sequence are enumerated; least squares fits how often each repeats to the histogram; the repeats are rounded.
   Lengths are then dealt to the patterns as runs, and what is left over is packed run by run, longest first, where it fits best.
   All of it works on counts, so the plan's size depends on the sequence length and not on the number of documents.
3. A piece's number among all of its length (its task's pieces before it, and those of earlier tasks) tells its place in the plan.

Pieces of one length are told apart by task, so a length that a third of all rows share is dealt by all tasks.
Null and empty texts are one end id. Repeated rows and null ids are packed each for itself; no rows give no rows.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posetrail.llm import shared

#: Classes of lengths, and documents of a pattern, that the fit works on.
CLASSES, DEPTH = 128, 4
#: Shares of the tokens, in the shortest documents, that may be kept back to fill what rounding leaves; the plan of fewest sequences wins.
RESERVES = (0.05, 0.1, 0.2, 0.4)
#: Word stems, marks and other words that a Python worker keeps with their ids; beyond that it starts anew.
KEPT_WORDS = 500_000
#: Words of one call to the library, and bytes of text that are split at once.
LINE_WORDS, TEXT_BYTES = 200, 8_000_000

#: Letters that neither compose nor change their number in lower case, and ASCII marks but the apostrophe: a run of each is one pre-token.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_LETTER_SET = "".join(map(chr, (*range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))))
_MARK_SET = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
_SIMPLE = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")


def _gather(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the runs of so many from each start, where each run begins among them)."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1]), upto


class WordEncoder:
    """ids of texts by a tokenizers file that drops white space and case: what stands between ASCII blanks is encoded once and kept, words of
    letters apart from the marks after them."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def encode_units(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the units in another order, all their ids, ids of each): those of one pre-token go to the library many at a time and part at last pieces."""
        plain = [u for u in units if _SIMPLE.fullmatch(u)]
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        done, ids, sizes, rest = [], [], [], [u for u in units if not _SIMPLE.fullmatch(u)]
        for line, e in zip(lines, self.library.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) == len(line):
                done += line
                ids.append(found)
                sizes.append(np.diff(stops, prepend=0))
            else:
                rest += line
        for e in self.library.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(e.ids, dtype=np.uint32))
            sizes.append([len(e.ids)])
        return done + rest, np.concatenate([np.zeros(0, dtype=np.uint32), *ids]), np.concatenate([np.zeros(0, dtype=np.int64), *sizes])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, offsets of the texts)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_string())
        simple, low = pc.match_substring_regex(words, f"^[{_LETTERS}]+[{_MARKS}]*$"), pc.ascii_lower(words)
        stems = pc.if_else(simple, pc.utf8_rtrim(low, _MARK_SET), words)
        marks = pc.if_else(simple, pc.utf8_ltrim(low, _LETTER_SET), "")
        units = pa.concat_arrays([stems, marks]).dictionary_encode()
        pair = self._known(units.dictionary.to_pylist())[units.indices.to_numpy()].reshape(2, -1).T.ravel()
        at, upto = _gather(self.offsets[:-1][pair], np.diff(self.offsets)[pair])
        ids, offsets = np.append(self.ids[at], np.uint32(end)), upto[::2]  # of each word, and the end id behind them
        codes = coded.indices.to_numpy()
        bounds = np.asarray(split.offsets)
        bounds = bounds - bounds[0]
        places, upto = _gather(np.insert(offsets[:-1][codes], bounds[1:], len(ids) - 1), np.insert(np.diff(offsets)[codes], bounds[1:], 1))
        return ids[places], upto[bounds + np.arange(len(bounds))]

    def _known(self, units: list[str]) -> np.ndarray:
        """The units' places in the table, where new ones are added."""
        new = [u for u in units if u not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            self._forget()
            new = units
        new, ids, sizes = self.encode_units(new)
        self.kept.update(zip(new, range(len(self.kept), len(self.kept) + len(new)), strict=True))
        self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.kept.__getitem__, units), dtype=np.int64, count=len(units))


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids), with ``part`` and ``rank``: the task and the piece's number in it among those of its length."""
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; the file (1.7 MB) travels with the tasks
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType())]
    fields += [("ids", T.ArrayType(T.LongType()))] if keep_ids else []
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(spec.value)
        encoder, part, counts = _ENCODERS[tokenizer_path], TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch in batches:
            column, keys = batch.column(1), batch.column(0)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
                ids, offsets = encoder.encode(column.slice(at, stop - at), end)
                rows: list[tuple] = []
                for k, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
                    for n, i in enumerate(range(a, b, limit)):
                        cut = ids[i : min(i + limit, b)]
                        rows.append((at + k, n, i - a, len(cut), zlib.crc32(cut.astype("<u4").tobytes()), part, counts[len(cut)], *([cut] if keep_ids else [])))
                        counts[len(cut)] += 1
                doc, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *(pa.array(c, s) for c, s in zip(rest, types, strict=True))], names=schema.names)
                at = stop

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())][: len(fields)]
    return docs.select(key, text).mapInArrow(shared.tidy(run), schema)


# --- the plan, on counts of lengths ---


def patterns(present: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` classes (ascending, 0 for none) that fill a sequence of len(present) - 1 units."""
    total, found, classes = len(present) - 1, [], np.flatnonzero(present)
    heads = np.zeros((1, 1), dtype=np.int64)  # with a zero before them
    for k in range(1, depth + 1):
        last = total - heads.sum(axis=1)
        fits = last >= np.maximum(heads[:, -1], 1)
        fits[fits] = present[last[fits]]
        found.append(np.pad(np.column_stack([heads[fits, 1:], last[fits]]), ((0, 0), (depth - k, 0))))
        head, place = np.nonzero(heads[:, -1:] <= classes)
        heads = np.column_stack([heads[head], classes[place]])
        heads = heads[heads.sum(axis=1) < total]
    return np.concatenate(found)


def fitted_repeats(rows: np.ndarray, target: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |weights * (A x - target)|, A counting each class in each pattern: the active-set method, on sparse columns."""
    x, passive = np.zeros(len(rows)), np.zeros(0, dtype=np.int64)
    if not len(rows):
        return x
    scaled = np.where(np.arange(len(target)) > 0, weights, 0)
    b = scaled * target

    def column(which: int) -> np.ndarray:
        return scaled * np.bincount(rows[which], minlength=len(target))

    a, gram = np.zeros((len(target), 0)), np.zeros((0, 0))  # of the passive columns
    tolerance = 1e-7 * max(1.0, float((scaled * b).max()))
    for _ in range(3 * len(target)):
        left = scaled * (b - a @ x[passive])
        gain = left[rows].sum(axis=1)
        gain[passive] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        passive, new = np.append(passive, best), column(best)
        gram = np.block([[gram, (a.T @ new)[:, None]], [(new @ a)[None], np.array([[new @ new]])]])
        a = np.column_stack([a, new])
        while True:
            z = np.linalg.lstsq(gram, a.T @ b, rcond=None)[0] if np.linalg.cond(gram) > 1e12 else np.linalg.solve(gram, a.T @ b)
            low = z <= 1e-9
            if not low.any():
                break
            now = x[passive]
            step = (now[low] / np.maximum(now[low] - z[low], 1e-12)).min()
            x[passive] = now + step * (z - now)
            out = low & (x[passive] <= 1e-9)
            out |= ~out.any() & low
            x[passive[out]] = 0
            passive, a, gram = passive[~out], a[:, ~out], gram[np.ix_(~out, ~out)]
        x[passive] = z
    return x


@dataclass
class Plan:
    """Places for pieces by length: run k holds ``copies`` pieces in each of its ``bins`` sequences from ``sequence`` on, first at ``offset``."""

    limit: int
    groups: list[tuple[list[tuple[int, int]], int]] = field(default_factory=list)  # ([(length, copies)], sequences)

    def runs(self) -> dict[str, np.ndarray]:
        rows, used, sequence = [], np.zeros(self.limit + 1, dtype=np.int64), 0
        for parts, bins in self.groups:
            offset = 0
            for length, copies in parts:
                rows.append((length, used[length], sequence, copies, offset))
                used[length] += copies * bins
                offset += length * copies
            sequence += bins
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "sequence", "copies", "offset"), table.T, strict=True))

    @property
    def sequences(self) -> int:
        return sum(bins for _, bins in self.groups)


def plan(histogram: dict[int, int], limit: int = 2048, classes: int = CLASSES) -> Plan:
    """Sequences for so many pieces of each length (1 to limit)."""
    return min((_plan(histogram, limit, classes, r) for r in RESERVES), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], limit: int, classes: int, reserve: float) -> Plan:
    out, unit = Plan(limit), max(1, limit // classes)
    left = {n: c for n, c in histogram.items() if c > 0}
    if full := left.pop(limit, 0):
        out.groups.append(([(limit, 1)], full))
    queues: dict[int, deque] = {}
    for length in sorted(left, reverse=True):
        queues.setdefault((length + unit // 2) // unit, deque()).append([length, left[length]])
    units = limit // unit
    have = np.zeros(max(units, *queues, 0) + 1, dtype=np.int64)
    for c, q in queues.items():
        have[c] = sum(n for _, n in q)
    present = have[: units + 1] > 0
    tokens = np.array([sum(a * n for a, n in queues.get(c, ())) for c in range(len(have))], dtype=float)
    present &= np.cumsum(tokens[: units + 1]) > reserve * tokens.sum()
    present[0] = False
    rows = patterns(present)
    repeats = fitted_repeats(rows, have[: units + 1].astype(float), np.arange(units + 1) / units)
    open_groups: list[tuple[list[tuple[int, int]], int]] = []
    rest: dict[int, int] = {}
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 0.5:
            break
        parts, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = min(int(np.rint(repeats[k])), *(int(have[c]) // t for c, t in zip(parts.tolist(), times.tolist(), strict=True)))
        if n == 0:
            continue
        dealt = []
        for i, c in enumerate(rows[k][rows[k] > 0].tolist()):  # from long and short ends by turns, so that sums come out even
            dealt.append(_taken(queues[c], n, bool(i % 2)))
            have[c] -= n
        for lengths, bins in _side_by_side(dealt):
            lengths, keep, room = sorted(lengths, reverse=True), [], limit
            for length in lengths:
                if length < room and length is not lengths[-1] or length == room or len(lengths) == 1:
                    keep.append((length, 1))
                    room -= length
                else:  # its class fits, it does not to the token: another length of the class may
                    rest[length] = rest.get(length, 0) + bins
            open_groups.append((keep, bins))
    for q in queues.values():
        for length, n in q:
            rest[length] = rest.get(length, 0) + n
    out.groups += _best_fit(open_groups, {n: c for n, c in rest.items() if c}, limit)
    return out


def _taken(queue: deque, n: int, short: bool) -> list[tuple[int, int]]:
    out = []
    while n:
        run = queue[-1 if short else 0]
        some = min(n, run[1])
        if some:
            out.append((run[0], some))
        run[1] -= some
        n -= some
        if not run[1]:
            queue.pop() if short else queue.popleft()
    return out


def _side_by_side(dealt: list[list[tuple[int, int]]]) -> Iterator[tuple[list[int], int]]:
    """Runs of equal total size, cut where any of them changes."""
    ends = [np.cumsum([n for _, n in runs]) for runs in dealt]
    cuts = np.unique(np.concatenate(ends))
    for start, stop in itertools.pairwise([0, *cuts.tolist()]):
        yield [runs[int(np.searchsorted(e, start, "right"))][0] for runs, e in zip(dealt, ends, strict=True)], stop - start


def _best_fit(groups: list[tuple[list[tuple[int, int]], int]], rest: dict[int, int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The groups with what is left over, longest first, in the fullest sequences that have room; equal sequences are filled as one."""
    by_room: list[list] = [[] for _ in range(limit + 1)]
    open_room = np.zeros(limit + 1, dtype=bool)

    def put(parts: list[tuple[int, int]], bins: int) -> None:
        if bins:
            room = limit - sum(a * b for a, b in parts)
            by_room[room].append((parts, bins))
            open_room[room] = True

    for parts, bins in groups:
        put(parts, bins)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(open_room[length:])
            room = length + int(fits[0]) if len(fits) else limit
            each = room // length
            if len(fits):
                parts, bins = by_room[room].pop()
                open_room[room] = bool(by_room[room])
            else:
                parts, bins = [], -(-n // each)
            full = min(bins, n // each)
            put([*parts, (length, each)], full)
            n -= full * each
            if n and full < bins:
                put([*parts, (length, n)], 1)
                put(parts, bins - full - 1)
                n = 0
            else:
                put(parts, bins - full)
    return [g for same in by_room for g in same]


# --- documents to places ---


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids), sequence_id, offset: every piece of every text, in a sequence of ``limit`` tokens at most."""
    cut = shared.stash(pieces(docs, tokenizer_path, key, text, limit, end, keep_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))  # a row for each length and task
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    runs = docs.sparkSession.sparkContext.broadcast(plan(histogram, limit).runs())
    numbered = cut.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    numbered = numbered.select(key, *(c for c in cut.columns if c not in (key, "part", "rank")), (F.col("before") + F.col("rank")).alias("slot"))
    schema = T.StructType([*(f for f in numbered.schema.fields if f.name != "slot"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = runs.value
        starts = (known["length"] << 44) + known["first"]
        for batch in batches:
            length, slot = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "slot"))
            at = np.searchsorted(starts, (length << 44) + slot, "right") - 1
            bins, copy = np.divmod(slot - known["first"][at], known["copies"][at])
            kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "slot"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(known["sequence"][at] + bins), pa.array(known["offset"][at] + copy * length)], names=schema.names)

    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids: the training rows, ``limit`` ids at most, of a ``pack`` result with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
