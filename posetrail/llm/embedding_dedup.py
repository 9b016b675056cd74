"""Near-duplicate embeddings: PCA-ordered tiled comparison by cosine.

Equal vectors are merged first (a vector with its number of copies) and scaled by a power of two, which no finite vector under- or
overflows and no cosine notices. Vectors of one length meet only each other. Those of a length with more than BLOCK vectors are
rotated to its principal axes and dealt to cells of a k-d tree over leading axes (fitted on a bounded sample); rarer lengths keep their
axes and have one cell. Cells are cut into blocks. Boxes are compared down the tree, level by level, so far-apart parts are never
paired. The pairs of blocks are worked on by tiles: a task holds a group of neighbouring blocks, bounded in bytes, and streams the
blocks of another past it, so a block moves once for each group that it meets and not for each block. Two blocks accumulate products of
leading axes, bound the rest by the norms of the suffixes, and stop once no cosine can reach the threshold; pairs that remain are
decided in double precision on the scaled vectors. A comparison returns link counts and a spanning forest, not pairs.

Vectors that are null, zero or empty, or hold null or non-finite components, and rows without a vec_id, link with nothing. Rows that
repeat a vec_id and vector count as copies of each other; different vectors under one vec_id have their own counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared
from posetrail.llm.components import components
from posetrail.llm.shared import free, stash

THRESHOLD = 0.9
BLOCK = 4096
#: Vectors that the k-d tree of a length is fitted on, at most; every vector is dealt and compared.
TREE_ROWS = 20_000
AXES = 8
#: Binary splits that one step down the tree takes, and those of the level that it starts from.
STRIDE, TOP = 3, 5
#: Bytes of vectors in a group of blocks, at most, and tiles that a core has at least, as far as there are blocks.
HELD, TILES = 64 << 20, 3


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component lies in [0.5, 1)."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, scaled rows) of each length of vectors in the column."""
    flat, cuts = np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.offsets)
    cuts = cuts - cuts[0]
    sizes = np.diff(cuts)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, scaled(flat[cuts[at][:, None] + np.arange(dim)])


def _moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products of the unit vectors of one length, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for _, _, x in _by_length(batch.column(0)):
                u = unit(x)
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["k", "v"])

    some = vectors.where(F.size("embedding") == dim).select("embedding")
    rows = some.mapInArrow(shared.tidy(run), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # dim * dim rows
    out = np.zeros(dim * dim)
    for k, v in rows:
        out[k] = v
    return out.reshape(dim, dim)


def _tree(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits of a complete binary tree, in breadth-first order: the axis of the widest spread, at its median."""
    splits, level = [], [sample]
    for _ in range(depth):
        below = []
        for x in level:
            axis = int(np.argmax(x.var(axis=0))) if len(x) > 1 else 0
            cut = float(np.median(x[:, axis])) if len(x) else 0.0
            splits.append((axis, cut))
            below += [x[x[:, axis] <= cut], x[x[:, axis] > cut]]
        level = below
    return splits


def _cells(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    if not splits:
        return at
    axes, cuts = np.array([a for a, _ in splits]), np.array([c for _, c in splits])
    while at[0] < len(splits) if len(at) else False:
        at = 2 * at + 1 + (x[np.arange(len(x)), axes[at]] > cuts[at])
    return at


def _linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles (rotated unit vectors; original vectors) with cosine >= threshold."""
    dim, done, product, slack = a.shape[1], 0, np.zeros((len(a), len(b))), 1e-9
    for upto in sorted({min(dim, k) for k in (8, 16, 24, 32, 48, dim)}):
        product += a[:, done:upto] @ b[:, done:upto].T
        done = upto
        rest_a, rest_b = (np.sqrt((x[:, done:] ** 2).sum(axis=1)) for x in (a, b))
        possible = product + np.outer(rest_a, rest_b) >= threshold - slack
        n = int(np.count_nonzero(possible))
        if n == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if n * 50 < product.size or done == dim:
            break
    i, j = np.nonzero(possible)
    keep = []
    for k in range(0, len(i), 50_000):
        x, y = (np.asarray(raw[at[k : k + 50_000]], dtype=np.float64) for raw, at in ((raw_a, i), (raw_b, j)))
        cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        keep.append(cosine >= threshold)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node that it reaches through them."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _fit(classes: DataFrame, dim: int, total: int) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """(principal axes, splits of the k-d tree) of the vectors of one length."""
    values, vectors = np.linalg.eigh(_moments(classes, dim))
    basis = vectors[:, np.argsort(-values)]
    part = int(1_000_000 * min(1.0, TREE_ROWS / total))
    rows = classes.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < part)).select("embedding").collect()
    sample = np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, dim)
    return basis, _tree(unit(scaled(sample)) @ basis[:, :AXES], max(0, int(np.ceil(np.log2(total / BLOCK)))))


def _near_blocks(blocks: DataFrame, depth: dict[int, int], threshold: float) -> DataFrame:
    """(a, b), a <= b, of blocks whose boxes leave a link possible. Boxes of tree nodes are joined from a level of few nodes down to the
    leaves; a pair of nodes hands on only pairs of their children, each within reach."""
    deepest = max(depth.values(), default=0)
    axes = range(AXES)
    leaf = blocks.select("dim", "leaf", "block", "low", "high")

    def boxes(level: int) -> DataFrame:
        """Nodes of a level (0: the roots), of trees cut to their own depth."""
        node = F.col("leaf")
        for dim, d in depth.items():
            node = F.when(F.col("dim") == dim, F.floor(F.col("leaf") / 2 ** max(0, d - level))).otherwise(node)
        ends = [F.min(F.col("low")[k]).alias(f"l{k}") for k in axes] + [F.max(F.col("high")[k]).alias(f"h{k}") for k in axes]
        out = leaf.groupBy("dim", node.cast("long").alias("node")).agg(*ends)
        return out.select("dim", "node", F.array(*(f"l{k}" for k in axes)).alias("low"), F.array(*(f"h{k}" for k in axes)).alias("high"))

    def within(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
        gaps = [F.greatest(F.lit(0.0), F.col(low_a)[k] - F.col(high_b)[k], F.col(low_b)[k] - F.col(high_a)[k]) for k in axes]
        return reduce(lambda x, y: x + y, [g * g for g in gaps]) <= 2 - 2 * threshold + 1e-9

    side = lambda t, s: t.select("dim", *(F.col(c).alias(f"{c}_{s}") for c in t.columns if c != "dim"))
    level = min(TOP, deepest)
    now = boxes(level)  # 2^TOP nodes of a length at most
    pairs = side(now, "a").join(side(now, "b"), "dim").where(F.col("node_a") <= F.col("node_b"))
    pairs = pairs.where(within("low_a", "high_a", "low_b", "high_b")).select("dim", "node_a", "node_b")
    while level < deepest:
        last, level = level, min(level + STRIDE, deepest)
        up = F.col("node")
        for dim, d in depth.items():
            up = F.when(F.col("dim") == dim, F.floor(F.col("node") / 2 ** (min(d, level) - min(d, last)))).otherwise(up)
        now = boxes(level).withColumn("up", up.cast("long"))
        pairs = stash(pairs, "tree-pairs")
        pairs = _down(pairs, now, side)
        pairs = pairs.where((F.col("node_a") <= F.col("node_b")) & within("low_a", "high_a", "low_b", "high_b")).select("dim", "node_a", "node_b").distinct()
    found = leaf.withColumnRenamed("leaf", "node")
    out = pairs.join(side(found, "a"), ["dim", "node_a"]).join(side(found, "b"), ["dim", "node_b"])
    out = out.where(within("low_a", "high_a", "low_b", "high_b"))
    return out.select(F.least("block_a", "block_b").alias("a"), F.greatest("block_a", "block_b").alias("b")).distinct()


def _shape(dim: int, leaves: int, cores: int) -> tuple[int, int]:
    """(leaves of a group, blocks of each of them in a group), powers of two, for vectors of a length in so many cells."""
    most = max(1, HELD // (BLOCK * dim * 8))
    groups = int(np.ceil((np.sqrt(8 * TILES * cores + 1) - 1) / 2))  # which make so many pairs, their own included
    wide = 1 << max(0, min(most, leaves // groups).bit_length() - 1)
    return wide, max(1, most // wide)


def _members(near: DataFrame, blocks: DataFrame, shapes: dict[int, tuple[int, int]], others: int) -> DataFrame:
    """(group_a, group_b, block, partners): the blocks of each tile. Those without partners are held, then each of the others meets its
    partners among them. ``others`` is the number of blocks in a group of lengths that have no shape."""
    wide, deep = F.lit(1), F.lit(others)
    for dim, (w, d) in shapes.items():
        wide, deep = F.when(F.col("dim") == dim, w).otherwise(wide), F.when(F.col("dim") == dim, d).otherwise(deep)
    group = F.struct("dim", F.floor(F.col("leaf") / wide).alias("leaves"), F.floor(F.col("part") / deep).alias("parts"))
    of = lambda s: blocks.select(F.col("block").alias(s), group.alias(f"group_{s}"))
    pairs = near.join(of("a"), "a").join(of("b"), "b")
    flip = F.col("group_a") > F.col("group_b")
    either = lambda c, d: F.when(flip, F.col(d)).otherwise(F.col(c))
    pairs = pairs.select(*(either(f"{c}_{s}" if c else s, f"{c}_{r}" if c else r).alias(f"{c}_{s}" if c else s) for c in ("group", "") for s, r in ("ab", "ba")))
    held = pairs.select("group_a", "group_b", F.col("a").alias("block"), F.lit(None).cast("array<bigint>").alias("partners")).distinct()
    met = pairs.groupBy("group_a", "group_b", F.col("b").alias("block")).agg(F.collect_list("a").alias("partners"))
    return held.unionByName(met)


def _down(pairs: DataFrame, now: DataFrame, side) -> DataFrame:
    """Pairs of the children of each pair of nodes, with their boxes; also those of a node with itself, in one order."""
    p = pairs.select("dim", F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"))
    both = p.join(side(now, "a"), ["dim", "up_a"]).join(side(now, "b"), ["dim", "up_b"])
    # children of a < b may come in any order
    flip = F.col("node_a") > F.col("node_b")
    names = ("node", "low", "high")
    ordered = [F.when(flip, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a") for c in names]
    ordered += [F.when(flip, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b") for c in names]
    return both.select("dim", *ordered)


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of the table."""
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & finite, F.lit(False)))
    # -0.0 equals 0.0 in the key; equal vectors are one class, numbered as they are written
    key = F.transform("embedding", lambda v: v + F.lit(0.0).cast(kind))
    classes = rows.where("fine").groupBy(key.alias("embedding")).agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    common = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).collect()
    models = {r["dim"]: _fit(classes, r["dim"], r["n"]) for r in common}
    depth = {dim: int(np.log2(len(splits) + 1)) for dim, (_, splits) in models.items()}

    def turned(dim: int, x: np.ndarray) -> np.ndarray:
        return unit(x) @ models[dim][0] if dim in models else unit(x)

    def leading(dim: int, x: np.ndarray) -> np.ndarray:
        lead = turned(dim, x)[:, :AXES]
        return np.pad(lead, ((0, 0), (0, AXES - lead.shape[1])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, dims = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int32)
            for dim, at, x in _by_length(batch.column(0)):
                dims[at] = dim
                if dim in models:
                    leaf[at] = _cells(leading(dim, x), models[dim][1]) - len(models[dim][1])
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(leaf), *batch.columns], names=["dim", "leaf", "embedding", "node", "copies"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a cell, numbered in it and named after their first vector; the rows come sorted by cell and vector. Vectors are
        kept in single precision where that holds all of them exactly."""
        held, n, last, part = [], 0, None, 0

        def block() -> pa.RecordBatch:
            node, copies, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            lead = leading(last[0], x)
            single = x.astype(np.float32)
            kept = single if np.array_equal(single, x) else x
            values = [last[0], last[1], part, int(node[0]), node.tobytes(), copies.tobytes(), kept.tobytes(), lead.min(axis=0).tolist(), lead.max(axis=0).tolist()]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["dim", "leaf", "part", "block", "nodes", "copies", "vectors", "low", "high"])

        for batch in batches:
            dims, leaf = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            node, copies = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            edges = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(dims) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(leaf)], strict=True):
                if a == b:
                    continue
                if last != (int(dims[a]), int(leaf[a])):
                    if n:
                        yield block()
                    last, n, part = (int(dims[a]), int(leaf[a])), 0, 0
                ((_, _, x),) = _by_length(batch.column(2).slice(a, b - a))
                while a < b:
                    c = min(b, a + BLOCK - n)
                    held.append((node[a:c], copies[a:c], x[len(x) - (b - a) : len(x) - (b - c)]))
                    n, a = n + c - a, c
                    if n == BLOCK:
                        yield block()
                        n, part = 0, part + 1
        if n:
            yield block()

    dealt = classes.select("embedding", "node", "copies").mapInArrow(shared.tidy(deal), f"dim int, leaf long, embedding array<{kind}>, node long, copies long")
    ddl = "dim int, leaf long, part long, block long, nodes binary, copies binary, vectors binary, low array<double>, high array<double>"
    blocks = stash(dealt.repartition("dim", "leaf").sortWithinPartitions("dim", "leaf", "node").mapInArrow(shared.tidy(cut), ddl), "blocks")
    near = stash(_near_blocks(blocks, depth, threshold), "near")
    cores = table.sparkSession.sparkContext.defaultParallelism
    members = _members(near, blocks, {dim: _shape(dim, 1 << d, cores) for dim, d in depth.items()}, 1)
    tiles = members.join(blocks.select("block", "dim", "nodes", "copies", "vectors"), "block").repartition("group_a", "group_b")
    tiles = tiles.sortWithinPartitions("group_a", "group_b", F.col("partners").isNotNull(), "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(row: dict) -> tuple[np.ndarray, ...]:
            node, copies = (np.frombuffer(row[c], dtype=np.int64) for c in ("nodes", "copies"))
            kind = np.float32 if len(row["vectors"]) == 4 * len(node) * row["dim"] else np.float64
            raw = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, row["dim"])
            return node, copies, raw, turned(row["dim"], raw.astype(np.float64))

        tile, held = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r].as_py() for k, name in enumerate(batch.schema.names)}
                if row["tile"] != tile:
                    tile, held = row["tile"], {}
                if row["partners"] is None:
                    held[row["block"]] = unpack(row)
                    continue
                mine = held[row["block"]] if row["block"] in held else unpack(row)
                for other in row["partners"]:
                    yield from links_of(held[other], mine)

    def links_of(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        (node_a, copies_a, raw_a, a), (node_b, copies_b, raw_b, b) = one, other
        same = node_a[0] == node_b[0]
        links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        nodes, roots = [], []
        for k in range(0, len(a), 1024):
            for m in range(k if same else 0, len(b), 1024):
                i, j = _linked(a[k : k + 1024], b[m : m + 1024], raw_a[k : k + 1024], raw_b[m : m + 1024], threshold)
                i, j = i + k, j + m
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                links_a += np.bincount(i, weights=copies_b[j], minlength=len(a)).astype(np.int64)
                links_b += np.bincount(j, weights=copies_a[i], minlength=len(b)).astype(np.int64)
                node, root = _forest(node_a[i], node_b[j])
                nodes.append(node)
                roots.append(root)
        if nodes:
            node, root = _forest(np.concatenate(nodes), np.concatenate(roots))
            some_a, some_b = np.flatnonzero(links_a), np.flatnonzero(links_b)
            n = len(some_a) + len(some_b)
            columns = [
                np.concatenate([node_a[some_a], node_b[some_b], node]), np.concatenate([links_a[some_a], links_b[some_b], np.zeros(len(node), dtype=np.int64)]),
            ]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * n + root.tolist(), pa.int64())], names=["node", "links", "root"])

    found = tiles.select(F.struct("group_a", "group_b").alias("tile"), "block", "partners", "dim", "nodes", "copies", "vectors")
    found = stash(found.mapInArrow(shared.tidy(compare), "node long, links long, root long"), "links")
    free(near, blocks)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.where(F.col("root").isNotNull()).select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stash(known.select("embedding", "vec", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    free(found, classes)
    least = known.groupBy("component").agg(F.min("vec").alias("component_id"))
    known = known.join(least, "component").select("embedding", "n_links", "component_id")
    fine = rows.where("fine").select("vec_id", key.alias("embedding")).join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
