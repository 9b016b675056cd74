"""Tracks on every frame of a video: linear between what is there, edges held.

Rows lie by video and block of frames and move for that at most once, however many frames are made. A row a track and block (its first and
last values, and the gaps of its animal) goes to the video, where what lies before and after each block is found; then each block is filled
by itself, with what is before and after it. So the frames made are never moved, and no task needs more than a block of a video.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of a block.
FRAMES = 4096
COLUMNS, TRACK = ("x", "y", "conf"), ("instance", "keypoint")
#: First frame and value, last frame and value of each column; NaN for none.
EDGES = "near array<double>, last bigint, gaps array<bigint>"


def block(frame: Column) -> Column:
    """The block of a frame; frames that no grid holds lie in the first."""
    return F.coalesce(F.greatest(F.floor(frame / FRAMES), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def tasks(spark: SparkSession) -> int:
    """Tasks to deal rows to: what is made of them is many times their bytes, so every core has a share."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def interpolated(long: DataFrame, max_gap: int = 0, individuals: int = 0, least: int = 1) -> DataFrame:
    """(video_id, instance, keypoint, frame, x, y, conf) of every track of the long rows on each frame up to the video's last. With max_gap,
    frames of gaps of a whole instance over it are null. With ``individuals``, only the frames that ``complete`` gives, with their row."""
    rows = _rows(long)
    types = {c: long.schema[c].dataType.simpleString() for c in ("video_id", *TRACK)}
    key = ", ".join(f"{c} {t}" for c, t in types.items())

    def between(table: pa.Table) -> pa.Table:
        return _between(table, max_gap, individuals, least)

    spread = _edges(rows, key, max_gap).groupBy("video_id").applyInArrow(between, f"{key}, _block bigint, last bigint, before array<double>, after array<double>, lost array<bigint>, kept array<bigint>")
    ddl = f"{key}, frame bigint, x double, y double, conf double" + ", row bigint" * bool(individuals)
    return rows.groupBy("video_id", "_block").cogroup(spread.groupBy("video_id", "_block")).applyInArrow(lambda a, b: _filled(a, b, bool(individuals)), ddl)


def complete(long: DataFrame, max_gap: int, individuals: int, least: int = 1) -> DataFrame:
    """(video_id, frame, row) of the frames on which ``interpolated`` has so many instances, in runs of ``least`` frames or more, numbered per
    video from 0. The values are not worked out: an instance is there on all frames but those of its gaps."""
    video, key = (", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in names) for names in (("video_id",), ("video_id", *TRACK)))

    def spans(table: pa.Table) -> pa.Table:
        found = _kept(_gaps(table, max_gap), individuals, least)
        parts = [(s, e, r) for s, e, r in found for s, e, r in _cut(s, e, r)]
        return pa.table({"video_id": table.column("video_id").take(pa.array(np.zeros(len(parts), dtype=np.int64)))} | {c: pa.array([p[k] for p in parts], pa.int64()) for k, c in enumerate(("start", "end", "at"))})

    found = _edges(_rows(long), key, max_gap).groupBy("video_id").applyInArrow(spans, f'{video}, start bigint, end bigint, at bigint')
    frames = found.select("video_id", "start", "at", F.explode(F.sequence("start", "end")).alias("frame"))
    return frames.select("video_id", "frame", (F.col("at") + F.col("frame") - F.col("start")).alias("row"))


def _rows(long: DataFrame) -> DataFrame:
    values = [F.col(c).cast("double").alias(c) for c in COLUMNS]
    return long.where("video_id is not null").select("video_id", *TRACK, "frame", *values, block(F.col("frame")).alias("_block"))


def _edges(rows: DataFrame, key: str, max_gap: int) -> DataFrame:
    return rows.groupBy("video_id", "_block").applyInArrow(lambda table: _ends(table, max_gap), f"{key}, _block bigint, {EDGES}")


def _cut(start: int, end: int, row: int):
    """A span cut at the ends of blocks."""
    for at in range(start // FRAMES * FRAMES, end + 1, FRAMES):
        s = max(at, start)
        yield s, min(at + FRAMES - 1, end), row + s - start


def _code(*tables: pa.Table) -> list[np.ndarray]:
    """A number for each row's track, the same in all tables."""
    code = np.zeros(sum(map(len, tables)), dtype=np.int64)
    for c in TRACK:
        v = np.concatenate([np.asarray(pc.fill_null(t.column(c).cast(pa.int64()), np.iinfo(np.int64).min)) for t in tables])
        known, at = np.unique(v, return_inverse=True)
        code = code * len(known) + at
    return np.split(code, np.cumsum([len(t) for t in tables])[:-1])


def _read(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Frames (-1: on no grid), values and whether they count, by column."""
    frame = np.asarray(pc.fill_null(table.column("frame").cast(pa.int64()), -1))
    named = (frame >= 0) & np.logical_and(*(np.asarray(table.column(c).is_valid()) for c in TRACK))
    there = {c: named & np.asarray(table.column(c).is_valid()) for c in COLUMNS}
    return frame, {c: np.asarray(pc.fill_null(table.column(c), 0.0)) for c in COLUMNS}, there


def _ends(table: pa.Table, max_gap: int) -> pa.Table:
    """A row for each track of a block; the first of an instance has the first and last frame that the instance is on, and its gaps between."""
    (code,), (frame, values, there) = _code(table), _read(table)
    tracks, first, at = np.unique(code, return_index=True, return_inverse=True)
    near, order = np.full((len(tracks), 3, 4), np.nan), np.lexsort((frame, at))
    for k, c in enumerate(COLUMNS):
        some = order[there[c][order]]
        for side, picked in ((0, some[::-1]), (2, some)):  # of rows that write to one place the last counts
            near[at[picked], k, side], near[at[picked], k, side + 1] = frame[picked], values[c][picked]
    own, on = table.take(pa.array(first)), there["x"] | there["y"] | there["conf"]
    _, lead, of = np.unique(np.asarray(pc.fill_null(table.column("instance").cast(pa.int64()), np.iinfo(np.int64).min)), return_index=True, return_inverse=True)
    gaps: list[list[int]] = [[] for _ in tracks]
    for k, i in enumerate(lead):
        f = np.unique(frame[on & (of == k)])
        if len(f):
            wide = np.flatnonzero(np.diff(f) - 1 > max_gap) if max_gap else np.zeros(0, dtype=np.int64)
            gaps[at[i]] = [f[0], f[-1], *np.column_stack([f[wide] + 1, f[wide + 1] - 1]).ravel()]
    last = np.full(len(tracks), frame.max())
    return own.select(["video_id", *TRACK, "_block"]).append_column("near", pa.array(list(near.reshape(-1, 12)), pa.list_(pa.float64()))).append_column("last", pa.array(last)).append_column("gaps", pa.array([list(map(int, g)) for g in gaps], pa.list_(pa.int64())))


def _gaps(table: pa.Table, max_gap: int) -> dict:
    """By instance that has a value: (start, end) of its gaps over max_gap in the video's frames; by None the last frame."""
    last = max(table.column("last").to_pylist())
    parts: dict = {}
    for i, g in sorted(((i, g) for i, g in zip(table.column("instance").to_pylist(), table.column("gaps").to_pylist(), strict=True) if g), key=lambda p: p[1][0]):
        parts.setdefault(i, []).append(g)
    out: dict = {None: last}
    for i, own in parts.items():
        gaps, upto = [], -1
        for first, end, *inner in own:
            gaps += [(upto + 1, first - 1), *zip(inner[::2], inner[1::2], strict=True)]
            upto = end
        gaps.append((upto + 1, last))
        out[i] = [(s, e) for s, e in gaps if max_gap and e - s + 1 > max_gap]
    return out


def _kept(gaps: dict, individuals: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, row of the start) of the runs of frames on which so many instances are."""
    last = gaps[None]
    own = [g for i, g in gaps.items() if i is not None]
    steps = {0: len(own), last + 1: 0}
    for s, e in (p for g in own for p in g):
        steps[s], steps[e + 1] = steps.get(s, 0) - 1, steps.get(e + 1, 0) + 1
    out, n, start, row = [], 0, None, 0
    for at in sorted(steps):
        n += steps[at]
        good = n == individuals and at <= last
        if good and start is None:
            start = at
        elif not good and start is not None:
            if at - start >= least:
                out.append((start, at - 1, row))
                row += at - start
            start = None
    return out


def _between(table: pa.Table, max_gap: int, individuals: int, least: int) -> pa.Table:
    """A row for each track and block of a video: the last values before the block and the first after it, and the gaps in it."""
    gaps = _gaps(table, max_gap)
    last = gaps[None]
    (code,) = _code(table)
    tracks, first, at = np.unique(code, return_index=True, return_inverse=True)
    blocks, n = max(0, last // FRAMES + 1), len(tracks)
    near = np.full((blocks, n, 3, 4), np.nan)
    if blocks:
        near[np.asarray(table.column("_block")), at] = np.asarray(table.column("near").combine_chunks().flatten()).reshape(-1, 3, 4)

    def carried(near: np.ndarray) -> np.ndarray:
        """The last (frame, value) of the blocks before each."""
        some = np.where(np.isnan(near[..., 0]), -1, np.arange(blocks)[:, None, None])
        some = np.concatenate([np.full((1, n, 3), -1), np.maximum.accumulate(some, axis=0)[:-1]])
        found = near[some, np.arange(n)[None, :, None], np.arange(3)[None, None, :]]
        return np.where((some < 0)[..., None], np.nan, found)

    def within(spans: list, b: int) -> list:
        return [(max(s, b * FRAMES), min(e, b * FRAMES + FRAMES - 1), *(r + max(s, b * FRAMES) - s for r in rest)) for s, e, *rest in spans if s < (b + 1) * FRAMES and e >= b * FRAMES]

    before, after = (carried(near[..., 2:]), carried(near[::-1, ..., :2])[::-1]) if blocks else (near[..., 2:], near[..., :2])
    kept = _kept(gaps, individuals, least) if individuals else []
    instance = table.column("instance").take(pa.array(first)).to_pylist()
    lost, held = [], []
    for b, here in enumerate(_by_block(kept, blocks)):
        flat = [int(v) for p in within(here, b) for v in p]
        held += [flat] * n
    own = {i: [[int(v) for p in within(here, b) for v in p] for b, here in enumerate(_by_block(g, blocks))] for i, g in gaps.items() if i is not None}
    lost = [own[i][b] if i in own else [] for b in range(blocks) for i in instance]
    rows = table.take(pa.array(np.tile(first, blocks))).select(["video_id", *TRACK])
    more = {"_block": np.repeat(np.arange(blocks), n), "last": np.full(blocks * n, last)}
    out = {c: rows.column(c) for c in rows.column_names} | {c: pa.array(v, pa.int64()) for c, v in more.items()}
    out |= {c: pa.array(list(v.reshape(-1, 6)), pa.list_(pa.float64())) for c, v in (("before", before), ("after", after))}
    return pa.table(out | {"lost": pa.array(lost, pa.list_(pa.int64())), "kept": pa.array(held, pa.list_(pa.int64()))})


def _by_block(spans: list, blocks: int) -> list[list]:
    """The spans that each block meets."""
    out: list[list] = [[] for _ in range(blocks)]
    for p in spans:
        for b in range(p[0] // FRAMES, p[1] // FRAMES + 1):
            out[b].append(p)
    return out


def _filled(rows: pa.Table, tracks: pa.Table, some: bool) -> pa.Table:
    """The frames of a block, each track's in order; with ``some`` only the kept ones."""
    if not len(tracks):  # no frame of the video is on a grid
        names, whole = ["video_id", *TRACK], rows.select(["video_id", *TRACK]).slice(0, 0)
        out = {c: whole.column(c) for c in names} | {"frame": pa.array([], pa.int64())} | {c: pa.array([], pa.float64()) for c in COLUMNS}
        return pa.table(out | ({"row": pa.array([], pa.int64())} if some else {}))
    start = tracks.column("_block")[0].as_py() * FRAMES
    n, t = min(FRAMES, tracks.column("last")[0].as_py() + 1 - start), len(tracks)
    frames, steps = start + np.arange(n), np.arange(n)
    (of_rows, of_tracks), (frame, values, there) = _code(rows, tracks), _read(rows)
    place = np.zeros(max([0, *of_rows, *of_tracks]) + 1, dtype=np.int64)
    place[of_tracks] = np.arange(t)
    at, pos = place[of_rows], frame - start
    kept, number = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
    if some:
        kept[:] = False
        for s, e, r in np.reshape(tracks.column("kept")[0].as_py(), (-1, 3)):
            kept[s - start : e + 1 - start], number[s - start : e + 1 - start] = True, r + np.arange(e + 1 - s)
    lost = np.zeros((t, n), dtype=bool)
    for k, spans in enumerate(tracks.column("lost").to_pylist()):
        for s, e in np.reshape(spans, (-1, 2)).astype(np.int64):
            lost[k, s - start : e + 1 - start] = True
    grid = pos >= 0  # rows on the grid; those that repeat a track and frame are kept beside it
    spare = np.flatnonzero(grid)
    own = spare[np.unique(at[spare] * n + pos[spare], return_index=True)[1]]
    spare = np.setdiff1d(spare, own)
    order = np.concatenate([spare, own])  # of rows that write to one place the last counts
    spare = spare[kept[pos[spare]]]
    before, after = (np.asarray(tracks.column(c).combine_chunks().flatten()).reshape(t, 3, 2) for c in ("before", "after"))
    out, r = {}, np.arange(t)[:, None]
    for k, c in enumerate(COLUMNS):
        v, on = np.zeros((t, n)), np.zeros((t, n), dtype=bool)
        w = order[there[c][order]]
        v[at[w], pos[w]], on[at[w], pos[w]] = values[c][w], True
        low = np.maximum.accumulate(np.where(on, steps, -1), axis=1)
        high = np.minimum.accumulate(np.where(on, steps, n)[:, ::-1], axis=1)[:, ::-1]
        f0, v0 = np.where(low >= 0, start + low, before[:, k, :1]), np.where(low >= 0, v[r, low], before[:, k, 1:])
        f1, v1 = np.where(high < n, start + high, after[:, k, :1]), np.where(high < n, v[r, np.minimum(high, n - 1)], after[:, k, 1:])
        no0, no1 = np.isnan(f0), np.isnan(f1)
        with np.errstate(invalid="ignore", divide="ignore"):
            line = v0 + (v1 - v0) * (frames - f0) / (f1 - f0)
        filled = np.where(on, v, np.where(no0, v1, np.where(no1, v0, line)))
        null = no0 & no1 | lost
        made = np.where(there[c][spare], values[c][spare], filled[at[spare], pos[spare]])
        out[c] = pa.array(np.concatenate([filled[:, kept].ravel(), made]), mask=np.concatenate([null[:, kept].ravel(), null[at[spare], pos[spare]] & ~there[c][spare]]))
    track = pa.array(np.concatenate([np.repeat(np.arange(t), kept.sum()), at[spare]]))
    whole = {c: tracks.column(c).take(track) for c in ("video_id", *TRACK)}
    on = lambda v: pa.array(np.concatenate([np.tile(v[kept], t), v[pos[spare]]]), pa.int64())
    return pa.table(whole | {"frame": on(frames)} | out | ({"row": on(number)} if some else {}))
