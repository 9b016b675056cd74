"""Frames as images: a row (video_id, frame, h, w, c, data) each, data being bytes row by row with the channels b, g, r (or one) together.

Kernels see the images of one size of an Arrow batch as a stack of bounded bytes and give columns, so a film of any length takes the memory
of a stack and small images cost no Python call each; Spark bounds what it sends by spark.sql.execution.arrow.maxBytesPerBatch. Statistics over frames go by tiles: a task sees the
sampled frames of one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posetrail.operators import runs as R

#: Bytes of images that a kernel sees at once, and of a tile.
BATCH_BYTES, TILE_BYTES = 2_000_000, 65_536
IMAGE = "video_id bigint, frame bigint, h int, w int, c int, data binary"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
STATISTICS = ("mean", "least", "most", "median", "p5", "p10", "p25", "p75", "p90", "p95")
_WEIGHTS = np.array([114, 587, 299], dtype=np.int32)


def packed(pixels: DataFrame, channels: tuple[str, ...] = ("b", "g", "r")) -> DataFrame:
    """Images of whole pixel rows (video_id, frame, x, y, channels)."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", *channels)))
    text = F.array_join(F.transform(rows, lambda p: F.concat(*(F.lpad(F.hex(p[c]), 2, "0") for c in channels))), "")
    size = [(F.max(a) + 1).cast("int").alias(b) for a, b in (("y", "h"), ("x", "w"))]
    return pixels.groupBy("video_id", "frame").agg(*size, F.lit(len(channels)).alias("c"), F.unhex(text).alias("data"))


def _types(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    fields = [f.strip().rsplit(" ", 1) for f in ddl.split(", ")]
    return [n for n, _ in fields], [_ARROW[t] for _, t in fields]


def stacked(column: pa.Array, *shape: int) -> np.ndarray:
    """Byte strings of one length as an array n x shape; absent ones are zeros."""
    if column.null_count:
        column = column.fill_null(bytes(int(np.prod(shape))))
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), *shape)


def _bytes(rows: np.ndarray) -> pa.Array:
    """A byte string for each first index."""
    rows = np.ascontiguousarray(rows, dtype=np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])


def kernel(images: DataFrame, of: Callable[..., Iterable[tuple]], ddl: str, extra: tuple[str, ...] = (), data: str = "data", keys: tuple[str, ...] = ("video_id", "frame")) -> DataFrame:
    """keys and the columns of ``ddl``. ``of(images as an n x h x w x c array, *extra values as Arrow arrays)`` gives tuples of the places of images
    in the stack (None: each once) and of columns as long. A stack holds images of one size of a batch, of BATCH_BYTES or a single one."""
    names, types = _types(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.flatnonzero(np.asarray(batch.column(len(keys) + 3).is_valid()))
            if not len(there):
                continue
            sizes = np.column_stack([np.asarray(batch.column(len(keys) + k).take(pa.array(there))) for k in range(3)])
            for size in np.unique(sizes, axis=0):
                rows = there[(sizes == size).all(axis=1)]
                step = max(1, BATCH_BYTES // max(1, int(np.prod(size, dtype=np.int64))))
                for k in range(0, len(rows), step):
                    some = [c.take(pa.array(rows[k : k + step])) for c in batch.columns]
                    for places, *columns in of(stacked(some[len(keys) + 3], *map(int, size)), *some[len(keys) + 4 :]):
                        head = some[: len(keys)] if places is None else [c.take(pa.array(places)) for c in some[: len(keys)]]
                        if len(head[0]):
                            made = [c if isinstance(c, pa.Array) else pa.array(np.broadcast_to(c, len(head[0])), t) for c, t in zip(columns, types, strict=True)]
                            yield pa.RecordBatch.from_arrays([*head, *made], names=[*keys, *names])

    given = images.select(*(F.col(k).cast("bigint").alias(k) for k in keys), "h", "w", "c", data, *extra)
    return given.mapInArrow(run, ", ".join([*(f"{k} bigint" for k in keys), ddl]))


def _image(a: np.ndarray) -> tuple:
    """All images of a stack, and their sizes."""
    return None, *(np.int32(v) for v in a.shape[1:3]), np.int32(1 if a.ndim == 3 else a.shape[3]), _bytes(a)


def pixel_rows(*stacks: np.ndarray) -> tuple:
    """Places, x, y and the values of the channels of all stacks, a row for each pixel."""
    n, h, w = stacks[0].shape[:3]
    x, y = np.tile(np.arange(w, dtype=np.int32), n * h), np.tile(np.repeat(np.arange(h, dtype=np.int32), w), n)
    return np.repeat(np.arange(n), h * w), x, y, *(s[..., k].ravel().astype(np.int32) for s in stacks for k in range(s.shape[3]))


def unpacked(images: DataFrame, channels: tuple[str, ...] = ("b", "g", "r"), keys: tuple[str, ...] = ("video_id", "frame"), data: str = "data") -> DataFrame:
    """Pixel rows (keys, x, y, channels) of images."""
    return kernel(images, lambda a: [pixel_rows(a)], f"x int, y int, {', '.join(f'{c} int' for c in channels)}", data=data, keys=keys)


def gray_of(a: np.ndarray) -> np.ndarray:
    """Weighted sum of the channels, halves up; an image of one channel is gray already."""
    return a[..., 0] if a.shape[-1] == 1 else ((_weighed(a) + 500) // 1000).astype(np.uint8)


def _weighed(a: np.ndarray) -> np.ndarray:
    """Thousandths of gray."""
    return sum(int(w) * a[..., k].astype(np.int32) for k, w in enumerate(_WEIGHTS))


def gray(images: DataFrame) -> DataFrame:
    return kernel(images, lambda a: [_image(gray_of(a))], "h int, w int, c int, data binary")


def augmented(images: DataFrame, paint: DataFrame, box: tuple[int, int, int, int], to_gray: bool = True) -> DataFrame:
    """Images painted, cropped to the half-open box (x1, y1, x2, y2) and made gray. ``paint`` (video_id, data): a byte for each pixel of the
    whole frame, 0 for none, 1 for black, 2 for white; a video without paint is left as it is."""
    x1, y1, x2, y2 = box

    def of(a: np.ndarray, paint: pa.Array) -> list[tuple]:
        marks = stacked(paint, *a.shape[1:3])[:, y1:y2, x1:x2, None]
        a = np.where(marks > 0, np.where(marks == 2, 255, 0), a[:, y1:y2, x1:x2]).astype(np.uint8)
        return [_image(gray_of(a) if to_gray else a)]

    joined = images.join(paint.select("video_id", F.col("data").alias("_paint")), "video_id", "left")
    return kernel(joined, of, "h int, w int, c int, data binary", extra=("_paint",))


# --- tones ---

# fixed values: sRGB to XYZ (D65) rows, and the white point
_XYZ = np.array([(0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227)])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_LINEAR = np.arange(256) / 255.0
_LINEAR = np.where(_LINEAR > 0.04045, ((_LINEAR + 0.055) / 1.055) ** 2.4, _LINEAR / 12.92)


def lab_of(a: np.ndarray) -> np.ndarray:
    """8-bit CIE Lab of b, g, r: L times 255/100, a and b moved by 128."""
    b, g, r = (_LINEAR[a[..., k]] for k in range(3))
    xyz = [(m[0] * r + m[1] * g + m[2] * b) / w for m, w in zip(_XYZ, _WHITE, strict=True)]
    x, y, z = (np.where(v > 0.008856, np.cbrt(v), 7.787 * v + 16.0 / 116) for v in xyz)
    light = np.where(xyz[1] > 0.008856, 116 * y - 16, 903.3 * xyz[1])
    return np.clip(np.floor(np.stack([light * 255 / 100, 500 * (x - y) + 128, 200 * (y - z) + 128], axis=-1) + 0.5), 0, 255).astype(np.uint8)


def toned(images: DataFrame, contrast: float = 1.0, brightness: float = 0.0, shift: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Contrast and brightness in b, g, r, then the Lab image with L, a, b moved; every step is bounded to a byte."""
    table = np.minimum(np.rint(np.abs(np.arange(256) * contrast + brightness)), 255).astype(np.uint8)
    return kernel(images, lambda a: [_image(np.clip(lab_of(table[a]).astype(np.int32) + shift, 0, 255))], "h int, w int, c int, data binary")


def tones(images: DataFrame, bins: int = 8, lab: bool = True) -> DataFrame:
    """(video_id, frame, channel, tone): shares of ``bins`` equal bins of each channel, least to 0 and most to 1; equal counts give 0."""

    def of(a: np.ndarray) -> Iterator[tuple]:
        a = lab_of(a) if lab else a
        n, c = len(a), a.shape[3]
        place = np.moveaxis(a, 3, 1).reshape(n * c, -1).astype(np.int64) * bins // 256 + np.arange(n * c)[:, None] * bins
        count = np.bincount(place.ravel(), minlength=n * c * bins).reshape(n * c, bins)
        least, most = count.min(axis=1, keepdims=True), count.max(axis=1, keepdims=True)
        shares = (count - least) / np.maximum(most - least, 1)
        yield np.repeat(np.arange(n), c), np.tile(np.arange(c, dtype=np.int32), n), pa.ListArray.from_arrays(pa.array(np.arange(n * c + 1) * bins, pa.int32()), pa.array(shares.ravel()))

    return kernel(images, of, "channel int, tone array<double>")


def tone_distance(tone: DataFrame, reference: DataFrame, bins: int = 8) -> DataFrame:
    """(video_id, frame, distance): mean over channels of the Bhattacharyya distance to the mean tone of the video's reference frames."""
    ref = tone.join(reference, ["video_id", "frame"], "left_semi").groupBy("video_id", "channel").agg(F.array(*(F.avg(F.col("tone")[k]) for k in range(bins))).alias("ref"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    down = F.sqrt(total(F.col("tone")) * total(F.col("ref")))
    apart = F.sqrt(F.greatest(F.lit(0.0), 1 - total(F.zip_with("tone", "ref", lambda a, b: F.sqrt(a * b))) / F.when(down > 0, down).otherwise(1.0)))
    return tone.join(ref, ["video_id", "channel"]).groupBy("video_id", "frame").agg(F.avg(apart).alias("distance"))


# --- backgrounds and masks ---


def background(images: DataFrame, frames: int = 100, tile: int = TILE_BYTES) -> DataFrame:
    """(video_id, h, w, c and an image for each of STATISTICS) over evenly spaced frames of a video (all, if there are fewer), truncated to bytes.

    Each sampled frame is cut into tiles; a task sees the samples of one tile, ``frames * tile`` bytes at most, and the exact quantiles come from
    sorting them. Frames of another size than the video's first sampled one are left out.
    """
    sample = R.evenly(images.select("video_id", "frame").distinct(), frames)
    near = images.join(sample, ["video_id", "frame"], "left_semi")
    size = near.groupBy("video_id").agg(F.min_by(F.struct("h", "w", "c"), "frame").alias("_size"))
    near = near.join(size, "video_id").where(F.struct("h", "w", "c") == F.col("_size"))

    def cut(a: np.ndarray) -> Iterator[tuple]:
        flat, size = a.reshape(len(a), -1), [np.int32(v) for v in a.shape[1:]]
        for k in range(0, flat.shape[1], tile):
            yield None, np.int32(k // tile), *size, _bytes(flat[:, k : k + tile])

    def measured(table: pa.Table) -> pa.Table:
        stack = np.frombuffer(b"".join(table.column("part").to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
        quantiles = np.percentile(stack, [50, 5, 10, 25, 75, 90, 95], axis=0)
        parts = [stack.mean(axis=0), stack.min(axis=0), stack.max(axis=0), *quantiles]
        found = [np.floor(np.round(p, 6)).astype(np.uint8).tobytes() for p in parts]
        return pa.table([table.column(c)[:1] for c in ("video_id", "tile", "h", "w", "c")] + [pa.array([f]) for f in found], names=["video_id", "tile", "h", "w", "c", *STATISTICS])

    binary = ", ".join(f"{s} binary" for s in STATISTICS)
    tiles = kernel(near, cut, "tile int, h int, w int, c int, part binary").groupBy("video_id", "tile").applyInArrow(measured, f"video_id bigint, tile int, h int, w int, c int, {binary}")

    def joined(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("tile").to_numpy())
        whole = [pa.array([b"".join(table.column(s).take(order).to_pylist())]) for s in STATISTICS]
        return pa.table([table.column(c)[:1] for c in ("video_id", "h", "w", "c")] + whole, names=["video_id", "h", "w", "c", *STATISTICS])

    return tiles.groupBy("video_id").applyInArrow(joined, f"video_id bigint, h int, w int, c int, {binary}")


def smart_mask(images: DataFrame, ground: DataFrame, threshold: int = 25, margin: float = 0.3, least: int = 100, dark: bool = True) -> DataFrame:
    """(video_id, h, w, c, data): bytes 1 where the background's gray (ground: video_id, data in b, g, r) lies in the band of the animals' gray.

    Foreground pixels differ from the background by the threshold in some channel; the exact 20th (dark) or 80th (light) percentile of their
    gray, from counts of its thousandths, makes the band. Videos with fewer foreground pixels than ``least`` have no row.
    """

    def tones(a: np.ndarray, back: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(image, thousandths of gray) of the foreground pixels."""
        on = np.abs(a.astype(np.int16) - stacked(back, *a.shape[1:])).max(axis=3) >= threshold
        return np.nonzero(on)[0], _weighed(a)[on]

    def counted(image: np.ndarray, value: np.ndarray, video: pa.Array) -> list[tuple]:
        """(first image, value, n) of the values of each video of a stack."""
        _, first, of = np.unique(np.asarray(video), return_index=True, return_inverse=True)
        both, n = np.unique(of[image] * 1_000_000 + value, return_counts=True)
        return [(first[both // 1_000_000], (both % 1_000_000).astype(np.int32), n)]

    def coarse(a: np.ndarray, back: pa.Array, video: pa.Array) -> list[tuple]:
        image, tone = tones(a, back)
        return counted(image, tone // 1000, video)

    def fine(a: np.ndarray, back: pa.Array, video: pa.Array, low: pa.Array, high: pa.Array) -> list[tuple]:
        image, tone = tones(a, back)
        near = (tone // 1000 == np.asarray(low)[image]) | (tone // 1000 == np.asarray(high)[image])
        return counted(image[near], tone[near], video)

    w = Window.partitionBy("video_id")
    q = 0.2 if dark else 0.8
    g = ground.select("video_id", F.col("data").alias("_ground"), F.col("video_id").cast("bigint").alias("_video"))
    front = images.join(g, "video_id")
    # counts of whole grays tell in which of them the two ranks lie; only the thousandths of these are counted
    bins = kernel(front, coarse, "bin int, n bigint", extra=("_ground", "_video")).groupBy("video_id", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)}).withColumn("at", (F.col("total") - 1) * q)
    at = lambda rank, c: F.min_by(c, F.when(F.col("upto") > rank, F.col("bin")))
    found = bins.where(F.col("total") >= least).withColumn("before", F.col("upto") - F.col("n")).groupBy("video_id").agg(
        F.first("at").alias("at"), *(at(r("at"), c).alias(f"{n}_{c}") for n, r in (("low", F.floor), ("high", F.ceil)) for c in ("bin", "before"))
    )
    near = front.join(found.select("video_id", "low_bin", "high_bin"), "video_id")
    counts = kernel(near, fine, "tone int, n bigint", extra=("_ground", "_video", "low_bin", "high_bin")).groupBy("video_id", "tone").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("bin", F.floor(F.col("tone") / 1000)).join(found, "video_id")
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("video_id", "bin").orderBy("tone")))
    value = lambda n, rank: F.min(F.when((F.col("bin") == F.col(f"{n}_bin")) & (F.col("upto") + F.col(f"{n}_before") > rank), F.col("tone")))
    tone = counts.groupBy("video_id").agg(value("low", F.floor("at")).alias("low"), value("high", F.ceil("at")).alias("high"), F.max(F.col("at") - F.floor("at")).alias("f"))
    tone = tone.select("video_id", ((F.col("low") + (F.col("high") - F.col("low")) * F.col("f")) / 1000).alias("_tone"))

    def band(b: np.ndarray, tone: pa.Array) -> list[tuple]:
        gray, bar = np.round(_weighed(b) / 1000, 6), np.asarray(tone)[:, None, None]
        return [_image(gray <= np.round(bar * (1 + margin), 6) if dark else gray >= np.round(bar * (1 - margin), 6))]

    return kernel(ground.join(tone, "video_id"), band, "h int, w int, c int, data binary", extra=("_tone",), keys=("video_id",))


# --- blobs ---


def components(on: np.ndarray, corners: bool) -> tuple[np.ndarray, int]:
    """(labels from 0 in order of first pixels, -1 elsewhere; their number): runs of each row, joined where they touch runs of the row above."""
    h, w = on.shape
    edge = np.zeros((h, w + 2), dtype=np.int8)
    edge[:, 1:-1] = on
    step = np.diff(edge, axis=1).ravel()
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # w + 1 places a row
    row = starts // (w + 1)
    if not len(starts):
        return np.full((h, w), -1, dtype=np.int64), 0
    above = starts - (w + 1)
    reach = int(corners)
    first = np.searchsorted(ends, above - reach, "right")  # the first run of the row above that ends behind this one's start
    last = np.searchsorted(starts, ends - (w + 1) + reach, "left")  # and behind the last that begins before its end
    first = np.maximum(first, np.searchsorted(row, row - 1, "left"))
    last = np.minimum(last, np.searchsorted(row, row, "left"))
    n = np.maximum(last - first, 0)
    mine = np.repeat(np.arange(len(starts)), n)
    theirs = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    root = np.arange(len(starts))
    while True:  # the least run of each component
        low, high = np.minimum(root[mine], root[theirs]), np.maximum(root[mine], root[theirs])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    names, label = np.unique(root, return_inverse=True)
    out = np.zeros(h * (w + 1) + 1, dtype=np.int64)
    np.add.at(out, starts, label + 1)
    np.add.at(out, ends, -(label + 1))
    return np.cumsum(out)[:-1].reshape(h, w + 1)[:, :w] - 1, len(names)


def areas_in(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, blob, area) of the outermost blobs of n x h x w images, holes filled: of the polygon through the centres of a blob's border pixels,
    which adds one for each square of four filled pixels and a half for one of three. Squares of two blobs don't exist, as pixels meet over
    corners. The images lie below each other, each within a free rim, and below each filled one lies a free line."""
    n, h, w = on.shape
    free, _ = components(np.pad(~on, ((0, 0), (1, 1), (1, 1)), constant_values=True).reshape(n * (h + 2), w + 2), corners=False)
    filled = free.reshape(n, h + 2, w + 2)[:, 1:, 1:-1] != 0  # all but what the frames' rims reach
    label, blobs = components(filled.reshape(n * (h + 1), w), corners=True)
    four = np.stack([label[:-1, :-1], label[:-1, 1:], label[1:, :-1], label[1:, 1:]])
    count, of = (four >= 0).sum(axis=0), four.max(axis=0)
    area = np.bincount(of[count == 4], minlength=blobs) + 0.5 * np.bincount(of[count == 3], minlength=blobs)
    image = np.zeros(blobs, dtype=np.int64)
    row, column = np.nonzero(label >= 0)
    image[label[row, column]] = row // (h + 1)
    return image, np.arange(blobs) - np.searchsorted(image, image), area


def areas_of(on: np.ndarray) -> np.ndarray:
    """Areas of the outermost blobs of one image."""
    return areas_in(on[None])[2]


def blob_areas(images: DataFrame, ground: DataFrame | None = None, threshold: int = 25, least: float = 100.0, dark: bool = True, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(video_id, frame, blob, area) of the outermost blobs larger than ``least``, numbered in order of their first pixel, row by row.

    With a background (video_id, data: a gray image's bytes) a pixel belongs to a blob where it is darker (or lighter) than it by more than the
    threshold, else where it is at most (or above) the threshold itself.
    """

    def of(a: np.ndarray, back: pa.Array | None = None) -> list[tuple]:
        g = gray_of(a).astype(np.int16)
        if back is not None:
            g = g - stacked(back, *g.shape[1:])
            on = g < -threshold if dark else g > threshold
        else:
            on = g <= threshold if dark else g > threshold
        if roi is not None:
            on = on[:, roi[1] : roi[3], roi[0] : roi[2]]
        image, blob, area = areas_in(on)
        large = area > least
        return [(image[large], blob[large].astype(np.int32), area[large])]

    if ground is None:
        return kernel(images, of, "blob int, area double")
    joined = images.join(ground.select("video_id", F.col("data").alias("_ground")), "video_id")
    return kernel(joined, of, "blob int, area double", extra=("_ground",))


def blob_counts(areas: DataFrame, double: float) -> DataFrame:
    """(video_id, frame, animal_count, merged) of blob areas: a blob of the double area counts two and sets merged."""
    big = F.col("area") >= double
    return areas.groupBy("video_id", "frame").agg(F.sum(F.when(big, 2).otherwise(1)).alias("animal_count"), F.max(big.cast("int")).alias("merged"))


# --- cutouts ---


def cutouts(images: DataFrame, crops: DataFrame, size: int) -> DataFrame:
    """(video_id, frame, instance, h, w, c, data): square images about each crop (video_id, frame, instance, cx, cy, angle in degrees), turned so that the
    animal lies level. Each pixel weighs the four about its source place by nearness, halves up; places outside the frame count 0.

    A frame's crops ride along with it as an array, so a frame is read and moved once.
    """
    spec = crops.groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("instance", "cx", "cy", "angle"))))).alias("_crops"))
    du, dv = np.meshgrid(np.arange(size) - size / 2, np.arange(size) - size / 2)

    def of(a: np.ndarray, spec: pa.Array) -> Iterator[tuple]:
        n, h, w, c = a.shape
        padded = np.pad(a, ((0, 0), (1, 1), (1, 1), (0, 0)))
        image = np.repeat(np.arange(n), np.asarray(spec.value_lengths()))
        numbers = np.asarray(spec.flatten().flatten()).reshape(len(image), 4)
        step = max(1, BATCH_BYTES // (8 * size * size * c))
        for k in range(0, len(image), step):
            at, (instance, cx, cy, angle) = image[k : k + step, None, None], numbers[k : k + step].T[:, :, None, None]
            cos, sin = np.cos(np.radians(angle)), np.sin(np.radians(angle))
            x, y = cx + du * cos - dv * sin, cy + du * sin + dv * cos
            left, top = np.floor(x), np.floor(y)
            fx, fy = (x - left)[..., None], (y - top)[..., None]
            xs = [np.clip(left + k, -1, w).astype(np.int64) + 1 for k in (0, 1)]
            ys = [np.clip(top + k, -1, h).astype(np.int64) + 1 for k in (0, 1)]
            value = padded[at, ys[0], xs[0]] * (1 - fx) * (1 - fy) + padded[at, ys[0], xs[1]] * fx * (1 - fy) + padded[at, ys[1], xs[0]] * (1 - fx) * fy + padded[at, ys[1], xs[1]] * fx * fy
            yield at[:, 0, 0], instance[:, 0, 0].astype(np.int32), *_image(np.floor(np.round(value, 6) + 0.5))[1:]

    return kernel(images.join(spec, ["video_id", "frame"]), of, "instance int, h int, w int, c int, data binary", extra=("_crops",))
