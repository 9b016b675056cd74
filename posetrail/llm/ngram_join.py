"""Jaccard join of word-shingle sets by universe-partition pigeonhole.

Two sets with 100 * intersection >= 80 * union differ in at most (|a| + |b|) / 9 shingles. Sizes fall into bands [2^j, 2^(j+1)); a
set also joins the band below if a partner may lie there. In a band, shingles are hashed into m segments.

* Small bands (sizes 4 to 15): every segment is allotted two differences, so m is half the bound: a set is indexed under each
  whole segment and under each segment less one shingle (its one-deletion neighbourhood).
* Larger bands: m exceeds the bound, so two linked sets agree in at least m - bound whole segments, and indexing any bound + 1
  segments of each, chosen by one global order, keeps a common one (prefix filtering over segments). The order is by cost: segments
  with several shingles first, then single ones, then those made of very frequent shingles only, empty ones last.

A task's sets with one signature enter the index as one block once they are many, and index lists of equal members are kept once.
Only texts of listed sets move, once, to a table bucketed by set; a Bloom filter of bounded size holds the others back. Sets are
compared by their words, exactly. Only connection is wanted, so each index list, or each part of a long one, is first compared
against a few pivots. Lists that still hold several components are then compared in full, so no link is lost: short ones by a join
of their pairs, long ones in blocks, whose tasks count common shingles by matrix products and return a spanning forest.

Null or empty texts have no shingles and link with nothing. Texts of fewer than five words have one shingle. Rows with equal
sets, repeated rows included, form one class. Sets are told apart by 128-bit hashes and named by 64 bits of them; the few sets whose
names clash get others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetrail.llm import shared
from posetrail.llm.components import components, spanning_edges
from posetrail.llm.shared import bucketed, free, stash

WIDTH = 5
#: Linked when 100 * intersection >= SHARE * union.
SHARE = 80
#: Bands whose segments are indexed with their one-deletion neighbourhoods.
DELETION_BANDS = (2, 3)
#: Entries of a task's summary of frequent shingles, and of the list that orders segments; they steer cost only.
SUMMARY = 20_000
FREQUENT = 50_000
#: Sets of one signature that a task indexes as a block, and pairs of signatures and sets that it groups at once.
BLOCK_RUN, GROUPED = 16, 400_000
#: Pivots of a list's first round, and members of a part that has its own.
PIVOTS, PART = 3, 1024
#: Bits of the Bloom filter of wanted rows, at most (2^27 bits are 16 MB): beyond that more texts move, none is lost.
BLOOM_BITS = 27
#: Members of a list whose pairs are joined; longer lists are compared in blocks of about so many sets and shingles.
SHORT_LIST = 32
BLOCK_SETS, BLOCK_SHINGLES = 1024, 200_000

#: Buckets of a set's sketch.
BUCKETS = 256

_WORD_TABLE = bytes(shared._LOWER.tolist())


def most_apart(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - SHARE) * (a + b) // (100 + SHARE)


def largest_partner(n: int | np.ndarray) -> int | np.ndarray:
    return n * 100 // SHARE


def segments(band: int) -> int:
    top = 2 ** (band + 1) - 1
    bound = int(most_apart(top, largest_partner(top)))
    return (bound + 2) // 2 if band in DELETION_BANDS else -(-(bound + 1) * 6 // 5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, hashes) of the distinct shingles, sorted by both, and the set sizes."""
    n_docs = len(offsets) - 1
    low = shared.lowered(data)
    starts, ends, docs = shared.spans(low, offsets, shared.BLANKS)
    words = shared.span_hashes(low, starts, ends)
    hashes, of = shared.chained(words, docs, tuple(range(WIDTH)), WIDTH)
    count = np.bincount(docs, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    parts, owners = [hashes], [of]
    for n in range(1, WIDTH):
        short = np.flatnonzero(count == n)
        if len(short):
            at = first[short][:, None] + np.arange(n)
            whole, _ = shared.chained(words[at].ravel(), np.repeat(short, n), tuple(range(n)), n)
            parts.append(whole)
            owners.append(short)
    hashes, of = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    if len(hashes):
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        hashes, of = hashes[new], of[new]
    return of, hashes, np.bincount(of, minlength=n_docs)


def class_ids(of: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    ends, out = np.cumsum(sizes), []
    for salt in (0x51ED270B, 0x2127599BF4325C37):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(shared.mix(hashes ^ np.uint64(salt)), out=sums[1:])
        out.append(shared.mix((sums[ends] - sums[ends - sizes]) ^ shared.mix(sizes.astype(np.uint64) + np.uint64(salt))).view(np.int64))
    return out[0], out[1]


Renamed = dict[tuple[int, int], int]


def set_names(of: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, renamed: Renamed) -> np.ndarray:
    low, high = class_ids(of, hashes, sizes)
    out = low.copy()
    for (one, other), name in renamed.items():
        out[(low == one) & (high == other)] = name
    return out


def clashes(table: DataFrame) -> Renamed:
    """New names of sets that share their first hash with another set: n * n / 2^65 of n sets are expected."""
    sets = table.where(F.col("n_shingles").isNotNull()).groupBy("low").agg(F.min("high").alias("least"), F.max("high").alias("most")).where("least < most")
    out: Renamed = {}
    for low, high in table.join(sets.select("low"), "low", "left_semi").select("low", "high").distinct().collect():
        both = np.array([low, high], dtype=np.int64).view(np.uint64)
        out[low, high] = int(shared.mix(both[:1] + shared.mix(both[1:])).view(np.int64)[0])
    return out


def signatures(of: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, signatures) of the index entries of each set."""
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    band = np.where(sizes > 0, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64), -1)
    out_docs, out_signs = [], []
    for j in range(2, int(band.max(initial=-1)) + 2):
        m, top = segments(j), 2 ** (j + 1) - 1
        home = band == j
        guest = (band == j + 1) & (sizes <= largest_partner(top))
        chosen = np.flatnonzero(home | guest)
        if not len(chosen):
            continue
        n = sizes[chosen]
        bound = np.where(home[chosen], most_apart(n, largest_partner(n)), most_apart(n, np.minimum(n - 1, top)))
        row = np.repeat(np.arange(len(chosen)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[chosen], n)
        h = hashes[at]
        salted = shared.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        cell = row * m + (salted >> np.uint64(33)).astype(np.int64) % m
        total = len(chosen) * m
        value = shared.mix(salted ^ np.uint64(0xA0761D6478BD642F))
        low = np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
        high = np.bincount(cell, weights=(value >> np.uint64(32)).astype(np.float64), minlength=total)
        sums = (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)
        name = np.uint64(j << 32) | (np.arange(total) % m).astype(np.uint64)
        if j in DELETION_BANDS:
            out_docs += [chosen[np.arange(total) // m], chosen[row]]
            out_signs += [shared.mix(sums ^ shared.mix(name)), shared.mix((sums[cell] - value) ^ shared.mix(name[cell]))]
            continue
        held = np.bincount(cell, minlength=total)
        rare = np.bincount(cell, weights=~_among(h, frequent), minlength=total)
        cost = np.where(held == 0, 3, np.where(rare == 0, 2, np.where(held == 1, 1, 0))).astype(np.uint64)
        sign = shared.mix(sums ^ shared.mix(name))
        rows = np.arange(total) // m
        order = np.lexsort((cost << np.uint64(62) | sign >> np.uint64(2), rows))
        place = np.arange(total) - rows * m  # rows keep their places in the order
        keep = order[place <= np.repeat(bound, m)]
        out_docs.append(chosen[rows[keep]])
        out_signs.append(sign[keep])
    if not out_docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(out_docs), np.concatenate(out_signs)


def _among(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(values), dtype=bool)
    return sorted_list[np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)] == values


def _row_key() -> Column:
    """A hash of doc_id and text that names a row also where the id is null or repeated; rows equal in both share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text"))


def set_table(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row_key, n_shingles, low, high) of all documents, and rows (shingle, seen) of each task's frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, n_docs = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for at, end, data, offsets in shared.slices(batch):
                of, hashes, sizes = shingle_sets(data, offsets)
                low, high = class_ids(of, hashes, sizes)
                n, n_docs = end - at, n_docs + end - at
                columns = [ids.slice(at, n), keys.slice(at, n), pa.array(sizes), pa.array(low), pa.array(high), *(pa.nulls(n, pa.int64()) for _ in range(2))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                # a bounded summary: repeated shingles of this slice join it, the least counts go
                found, times = np.unique(hashes, return_counts=True)
                found, times = found[times > 1], times[times > 1]
                both, where = np.unique(np.concatenate([seen, found]), return_inverse=True)
                total = np.bincount(where, weights=np.concatenate([counts, times]), minlength=len(both)).astype(np.int64)
                if len(both) > SUMMARY:
                    top = np.argpartition(total, len(total) - SUMMARY)[len(total) - SUMMARY :]
                    both, total = both[top], total[top]
                seen, counts = both, total
        keep = counts >= max(3, n_docs // 1000)
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(5)), pa.array(seen[keep].view(np.int64)), pa.array(counts[keep])], names=names)

    names = ["doc_id", "row_key", "n_shingles", "low", "high", "shingle", "seen"]
    return docs.select(F.col("doc_id").cast("long"), _row_key().alias("row_key"), "text").mapInArrow(shared.tidy(run), ", ".join(f"{n} long" for n in names))


#: Kinds of index rows: (signature, set), (signature, block) and (block, set).
SINGLE, BLOCK, MEMBER = 0, 1, 2


def grouped(signs: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, kind) index rows of a task's (signature, set) pairs: BLOCK_RUN or more sets of one signature are a block.

    Blocks are named by their members, so equal ones are listed once. Should two names clash, a list gets members that the exact
    comparison removes.
    """
    order = np.lexsort((sets, signs))
    s, x = signs[order], sets[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
    s, x = s[new], x[new]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(first, len(s)))
    long = length >= BLOCK_RUN
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(shared.mix(x.view(np.uint64)), out=sums[1:])
    name = shared.mix((sums[first + length] - sums[first]) ^ shared.mix(length.astype(np.uint64))).view(np.int64)
    single = ~np.repeat(long, length)
    _, pick = np.unique(name[long], return_index=True)
    chosen = np.flatnonzero(long)[pick]
    n = length[chosen]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[chosen], n)
    by_set = np.argsort(x[single], kind="stable")  # runs of one set pack well
    parts = [(s[single][by_set], x[single][by_set]), (s[first[long]], name[long]), (np.repeat(name[chosen], n), x[at])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.repeat([SINGLE, BLOCK, MEMBER], [len(p[0]) for p in parts]).astype(np.int32)


def _index(docs: DataFrame, frequent, renamed: Renamed) -> DataFrame:
    """Index rows (first, second, kind); a task indexes equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, size = set(), [], 0

        def out() -> pa.RecordBatch:
            rows = grouped(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["first", "second", "kind"])

        for batch in batches:
            for _, _, data, offsets in shared.slices(batch):
                of, hashes, sizes = shingle_sets(data, offsets)
                ids = set_names(of, hashes, sizes, renamed)
                fresh = np.zeros(len(ids), dtype=bool)
                for k, i in enumerate(ids.tolist()):
                    if i not in done:
                        done.add(i)
                        fresh[k] = True
                kept = fresh[of]
                docs_of, signs = signatures(of[kept], hashes[kept], np.where(fresh, sizes, 0), frequent.value)
                held.append((signs.view(np.int64), ids[docs_of]))
                size += len(signs)
                if size > GROUPED:
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(shared.tidy(run), "first long, second long, kind int")


def _bloom(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(bits as bytes, their number) of a Bloom filter of the n row keys; Spark builds it in pieces of 4 KB."""
    size = 1 << min(BLOOM_BITS, max(15, (10 * n).bit_length()))
    at = keys.select(F.explode(F.array(*(F.pmod(F.shiftrightunsigned("row_key", k), F.lit(size)) + 1 for k in (0, 16, 32)))).alias("at"))
    pieces = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(size // 8, dtype=np.uint8)
    for b, bits in pieces:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out, size


def _texts(docs: DataFrame, wanted: DataFrame, n: int, renamed: Renamed) -> DataFrame:
    """(set_id, n, text, sketch) of the n wanted (set_id, row_key), one text for each set, bucketed by set_id.

    A Bloom filter of row_key chooses the texts before they move; the few that it lets through in vain are sets that nothing asks for.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(_bloom(wanted, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shipped.value
        for batch in batches:
            key, may = np.asarray(batch.column(0)).view(np.uint64), np.ones(batch.num_rows, dtype=bool)
            for k in (0, 16, 32):
                at = (key >> np.uint64(k)) & np.uint64(size - 1)
                may &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            batch = batch.filter(pa.array(may))
            for at, end, data, offsets in shared.slices(batch):
                sets = shingle_sets(data, offsets)
                columns = [pa.array(set_names(*sets, renamed)), pa.array(sets[2]), batch.column(1).slice(at, end - at)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in sketches(*sets)], pa.binary())], names=["set_id", "n", "text", "sketch"])

    # one Python node for both steps: a second one would keep workers of its own on each executor
    found = docs.select(_row_key().alias("row_key"), "text").mapInArrow(shared.tidy(run), "set_id long, n long, text string, sketch binary")
    return bucketed(found, "texts", "set_id")


def sketches(of: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shingles of each set by bucket of their hash, up to 255: two sets differ in at least the summed differences of their buckets."""
    bucket = of * BUCKETS + (shared.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BUCKETS)).astype(np.int64)
    return np.minimum(np.bincount(bucket, minlength=len(sizes) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible; none that link are lost, and no text is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
                n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
                near = np.abs(a - b).sum(axis=1) <= most_apart(n, 0)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near))

    of = lambda x: texts.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(shared.tidy(run), "a long, b long")


def _shingles(text: str | None) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()
    return set(zip(*(words[k:] for k in range(WIDTH)), strict=False)) if len(words) >= WIDTH else {tuple(words)} - {()}


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for batch in batches:
            keep = []
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if x != last:
                    last, one = x, _shingles(t.as_py())
                keep.append(one)
            linked = []
            for one_, t in zip(keep, batch.column(3), strict=True):
                other = _shingles(t.as_py())
                both = len(one_ & other)
                linked.append(100 * both >= SHARE * (len(one_) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left, right = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "text_a", "b", "text_b")
    return both.sortWithinPartitions("a").mapInArrow(shared.tidy(run), "a long, b long")


def _lists(docs: DataFrame, frequent, renamed: Renamed) -> DataFrame:
    """(sign, set_id) of the index lists of two sets or more, those of equal members once."""
    in_list = Window.partitionBy("first", "member")
    index = _index(docs, frequent, renamed).withColumn("member", F.col("kind") == MEMBER)
    index = index.withColumn("several", (F.max("kind").over(in_list) > SINGLE) | (F.min("second").over(in_list) < F.max("second").over(in_list)))
    prints = [F.xxhash64("second", "kind", F.lit(k)) for k in (1, 2)]
    low, high = (lambda h: h.bitwiseAND(0xFFFFFFFF)), (lambda h: F.shiftrightunsigned(h, 32))  # sums of 32 bits do not overflow
    sums = {"x": low(prints[0]), "y": high(prints[0]), "z": low(prints[1])}
    index = index.where("several").select("first", "second", "kind", *(F.sum(h).over(in_list).alias(k) for k, h in sums.items()))
    index = stash(index, "index")
    once = index.where(F.col("kind") != MEMBER).groupBy("x", "y", "z").agg(F.min("first").alias("first"))
    kept = index.where(F.col("kind") != MEMBER).select("first", "second", "kind").join(once.select("first"), "first", "left_semi")
    member = index.where(F.col("kind") == MEMBER).select(F.col("first").alias("second"), F.col("second").alias("set_id"))
    singles = kept.where(F.col("kind") == SINGLE).select(F.col("first").alias("sign"), F.col("second").alias("set_id"))
    blocks = kept.where(F.col("kind") == BLOCK).join(member, "second").select(F.col("first").alias("sign"), "set_id")
    out = stash(singles.union(blocks).distinct(), "lists")
    free(index)
    return out


def _stars(lists: DataFrame) -> DataFrame:
    """Candidate pairs of each list's members, of (sign, set_id, n), with a few pivots; parts of a long list have their own, so no
    pivot meets more than a few parts' members, and meet by those pivots."""
    size = F.count(F.lit(1))
    parts = lists.groupBy("sign").agg(size.alias("members")).where(F.col("members") > PART)
    parts = parts.select("sign", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("members") / PART))).cast("long").alias("parts"))
    dealt = lists.join(parts, "sign", "left").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(9)), F.coalesce("parts", F.lit(1))))
    dealt = dealt.select("sign", "part", "set_id", "n")
    least = [F.min(F.struct(F.xxhash64("set_id", F.lit(k)).alias("h"), "set_id", "n")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = dealt.groupBy("sign", "part").agg(*least)
    stars = dealt.join(pivots, ["sign", "part"]).select("set_id", "n", F.explode(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("p"))
    tops = pivots.groupBy("sign").agg(F.min("p0").alias("p"), size.alias("parts")).where("parts > 1").select("sign", "p")
    bridges = pivots.join(tops, "sign").select("p0.set_id", "p0.n", "p")
    return _candidates(stars.union(bridges).select("set_id", "n", F.col("p.set_id").alias("other"), F.col("p.n").alias("n_other")))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): (doc_id, row_key, n_shingles, set_id) of every document, and links (a, b) of set ids that connect all linked sets."""
    spark = docs.sparkSession
    table = stash(set_table(docs), "sets")
    renamed = clashes(table)
    name = F.col("low")
    for (low, high), new in renamed.items():
        name = F.when((F.col("low") == low) & (F.col("high") == high), F.lit(new)).otherwise(name)
    classes = table.where(F.col("n_shingles").isNotNull()).select("doc_id", "row_key", "n_shingles", name.alias("set_id"))
    seen = table.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("seen").alias("seen"))
    top, _ = shared.most_frequent(seen, "shingle", "seen", FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(top.astype(np.int64).view(np.uint64)))

    listed = _lists(docs, frequent, renamed)
    sized = classes.groupBy("set_id").agg(F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n"))
    sized = stash(sized.join(listed.select("set_id").distinct(), "set_id", "left_semi"), "members")
    texts = _texts(docs, sized, sized.count(), renamed)
    lists = stash(listed.join(sized.select("set_id", "n"), "set_id"), "lists")
    free(listed)

    # a first round of stars around a few pivots of each list joins most of each group
    tried = stash(_stars(lists), "pairs")
    near = stash(_possible(tried, texts), "near")
    edges = stash(_verified(near, texts), "links")
    free(near)
    # then lists that still hold several components are compared in full
    label = components(edges).withColumnRenamed("node", "set_id")
    labelled = lists.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    spread = labelled.groupBy("sign").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("members"),
        *(F.min(F.xxhash64("set_id", F.lit(k))).alias(f"least_{k}") for k in (2, 3)),
    )
    still = stash(spread.where("first < last").select("sign", "members", F.xxhash64("least_2", "least_3").alias("crowd")), "open")
    rest = stash(labelled.join(still, "sign"), "rest")
    short = rest.where(F.col("members") <= SHORT_LIST).select("sign", "set_id", "n", "component")
    other = short.select("sign", F.col("set_id").alias("other"), F.col("n").alias("n_other"), F.col("component").alias("component_other"))
    pairs = _candidates(short.join(other, "sign").where("component < component_other")).join(tried, ["a", "b"], "left_anti")
    near = stash(_possible(pairs, texts), "near")
    # long lists of nearly the same members (by two min-hashes) are one crowd
    crowds = stash(rest.where(F.col("members") > SHORT_LIST).select("crowd", "set_id", "n", "component").distinct(), "crowds")
    within = stash(_within_crowds(crowds, texts), "near")
    out = stash(edges.union(_verified(near.union(within).distinct(), texts)), "links")
    free(texts, lists, tried, edges, still, rest, near, crowds, within)
    return classes, out


def _common(of_a: np.ndarray, hashes_a: np.ndarray, n_a: int, of_b: np.ndarray, hashes_b: np.ndarray, n_b: int) -> np.ndarray:
    """Intersection sizes of n_a sets with n_b sets: common shingles by matrix products, the others pair by pair."""
    values, at = np.unique(np.concatenate([hashes_a, hashes_b]), return_inverse=True)
    at_a, at_b = at[: len(hashes_a)], at[len(hashes_a) :]
    in_a, in_b = np.bincount(at_a, minlength=len(values)), np.bincount(at_b, minlength=len(values))
    work = in_a * in_b
    dense = work * 64 > n_a * n_b
    out = np.zeros((n_a, n_b), dtype=np.float32)  # whole numbers below 2^24
    place = np.cumsum(dense) - 1
    use_a, use_b = dense[at_a], dense[at_b]
    row_a, col_a, row_b, col_b = of_a[use_a], place[at_a[use_a]], of_b[use_b], place[at_b[use_b]]
    for low in range(0, int(dense.sum()), 2048):
        some_a, some_b = (col_a >= low) & (col_a < low + 2048), (col_b >= low) & (col_b < low + 2048)
        left, right = np.zeros((n_a, 2048), dtype=np.float32), np.zeros((n_b, 2048), dtype=np.float32)
        left[row_a[some_a], col_a[some_a] - low] = 1
        right[row_b[some_b], col_b[some_b] - low] = 1
        out += left @ right.T
    sparse = ~dense & (work > 0)
    order = np.argsort(at_a, kind="stable")
    first = np.cumsum(in_a) - in_a
    pick = np.flatnonzero(sparse[at_b])
    times = in_a[at_b[pick]]
    ends = np.cumsum(times)
    flat = out.reshape(-1)
    low = 0
    while low < len(pick):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 4_000_000, "right")))
        t = times[low:high]
        step = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        rows = of_a[order[np.repeat(first[at_b[pick[low:high]]], t) + step]]
        cells, counts = np.unique(rows * n_b + np.repeat(of_b[pick[low:high]], t), return_counts=True)
        flat[cells] += counts
        low = high
    return out


def _within_crowds(crowds: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all linked sets of each crowd (crowd, set_id, n, component), but for those of one component.

    A crowd is dealt by a hash into parts of bounded size, and each two parts meet in one row; shingles count by their hashes here.
    """
    sizes = crowds.groupBy("crowd").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    dealt = crowds.join(sizes, "crowd").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(7)), "parts"))
    dealt = dealt.join(texts.select("set_id", "text"), "set_id").select("crowd", "part", "parts", "set_id", "component", "text")

    kept = ("sets", "labels", "lengths", "texts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            texts = [x.encode("utf-8", "surrogatepass") for x in held[2]]
            columns = [np.array(x, dtype=np.int64).tobytes() for x in (held[0], held[1], [len(x) for x in texts])]
            columns.append(pa.compress(b"".join(texts), "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, *columns)], names=["crowd", "part", "parts", *kept])

        key, held = None, ([], [], [])
        for batch in batches:
            for crowd, part, parts, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and key != (crowd, part, parts):
                    yield block()
                    held = ([], [], [])
                key = (crowd, part, parts)
                for to, x in zip(held, row, strict=True):
                    to.append(x)
        if key is not None:
            yield block()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(sets: bytes, labels: bytes, lengths: bytes, packed: bytes):
            sets, labels, lengths = (np.frombuffer(x, dtype=np.int64) for x in (sets, labels, lengths))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            data = pa.decompress(packed, int(offsets[-1]), "zstd", asbytes=True)
            return sets, labels, *shingle_sets(np.frombuffer(data, dtype=np.uint8), offsets)

        for batch in batches:
            for same, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sets_a, labels_a, of_a, hashes_a, n_a = unpack(*row[:4])
                sets_b, labels_b, of_b, hashes_b, n_b = (sets_a, labels_a, of_a, hashes_a, n_a) if same else unpack(*row[4:])
                both = _common(of_a, hashes_a, len(sets_a), of_b, hashes_b, len(sets_b))
                linked = 100 * both >= SHARE * (n_a[:, None] + n_b[None, :] - both)
                linked &= labels_a[:, None] != labels_b[None, :]
                i, j = np.nonzero(linked)
                keep = spanning_edges(np.concatenate([labels_a, labels_b]), i, j + len(sets_a))
                a, b = sets_a[i[keep]], sets_b[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    blocks = dealt.repartition("crowd", "part").sortWithinPartitions("crowd", "part")
    blocks = stash(blocks.mapInArrow(shared.tidy(pack), "crowd long, part long, parts long, sets binary, labels binary, lengths binary, texts binary"), "blocks")
    left = blocks.select("crowd", F.col("part").alias("one"), F.explode(F.expr("sequence(part, parts - 1)")).alias("other"), *(F.col(c).alias(f"{c}_a") for c in kept))
    right = blocks.select("crowd", F.col("part").alias("other"), *(F.col(c).alias(f"{c}_b") for c in kept))
    tiles = left.join(right, ["crowd", "other"]).repartition("crowd", "one", "other")
    tiles = tiles.select((F.col("one") == F.col("other")).alias("same"), *(f"{c}_{side}" for side in "ab" for c in kept))
    return tiles.mapInArrow(shared.tidy(compare), "a long, b long")


def _candidates(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (set_id, n, other, n_other) whose sizes fit."""
    fits = (F.col("set_id") != F.col("other")) & (F.greatest("n", "n_other") * SHARE <= F.least("n", "n_other") * 100)
    return pairs.where(fits).select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, component) of every document."""
    classes, edges = links(docs)
    label = components(edges)
    free(edges)
    labelled = classes.join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
    return labelled.select("doc_id", "row_key", "n_shingles", F.coalesce("component", "set_id").alias("component"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, component_id being the smallest doc_id reachable by links; null where all are null."""
    labelled = _labelled(docs)
    # a set's rows come down to their smallest id before the group's do, so a hot set or group is summed up by the partial step
    least = labelled.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = labelled.join(least, "component", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id, nulls last, ties by a hash of the text.

    Rows are told apart by doc_id and text, so rows that repeat an id with other texts are documents of their own, and so are rows
    without an id; of rows that repeat both, one stays. The keys of the rows that go (the fewer) are joined away.
    """
    some = F.col("n_shingles") > 0
    group = F.struct(some.alias("some"), F.when(some, F.col("component")).otherwise(F.col("row_key")).alias("group"))
    rows = stash(_labelled(docs).groupBy("row_key", "doc_id", group.alias("group")).agg(F.count(F.lit(1)).alias("rows")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    keep = rows.groupBy("group").agg(first.alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1").select("group", F.col("first.row_key").alias("kept"))
    key = shared.free_name(docs, "row_key")
    gone = stash(rows.join(keep, "group").where("row_key != kept").select(F.col("row_key").alias(key)), "gone")
    kept = docs.withColumn(key, _row_key()).join(gone, key, "left_anti")
    twice = stash(rows.where("rows > 1").select(F.col("row_key").alias(key)).distinct(), "twice")
    free(rows)
    if not twice.isEmpty():
        kept = kept.join(twice, key, "left_anti").union(kept.join(twice, key, "left_semi").dropDuplicates([key]))
    return kept.drop(key)
