"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, and unigram counts of the whole corpus.

Words are counted over all training texts. Words seen LEAST times or more have vectors, the VECTORS most frequent at most; the others share
RARE kinds, by their last letter and whether they are ASCII, and within its kind a word has its smoothed share of counts. A context is
the sum of the vectors of the two symbols before, each scaled by its place. Symbols, ordered by frequency, fall into groups of about
equal mass: the model gives the group from the context and the symbol from group and context, each as a softmax of products, so
batched matrix products normalise a token at the cost of two small products and every symbol has its probability.

Training reads all training texts as symbol numbers, dealt by a hash of the row into shards of about SHARD_TOKENS tokens, so the model does
not depend on how the table was cut. Every shard starts from the common parameters and contrasts each of its tokens with noise from the
unigram shares, in one pass; so no position is left out. The results are averaged by tokens, block by block.

Null texts count as empty: one token, the end. Rows that repeat a doc_id are scored each. Words are named by 60-bit hashes, with the
kind in the last 4 bits. Without training rows, all words are unknown and the kinds uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared
from posetrail.llm.shared import free, stash

#: Words with vectors at most and the counts that they need, and words whose counts travel with the tasks (16 bytes each); all others are joined.
VECTORS, LEAST, CARRIED = 20_000, 5, 200_000
WIDTH, NOISE, WORD_NOISE, LEARN_RATE, BATCH = 16, 64, 1, 0.2, 4096
#: Tokens of a shard.
SHARD_TOKENS = 2_000_000
#: Numbers of a block of parameters, and tokens scored at once.
BLOCK, AT_ONCE = 65_536, 20_000
#: Rows, and numbers, of a matrix of logits: it stays in a processor's cache.
ROWS, CELLS = 1000, 250_000
#: Symbols 0 to RARE - 1 are the kinds of rare words; those of words follow the end and the start.
RARE = 16
END, START = RARE, RARE + 1
FIRST = RARE + 2
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D0)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = shared.lowered(data)
    starts, ends, docs = shared.spans(low, offsets, shared.BLANKS)
    last = np.maximum(ends - 1 - ((low[ends - 1] < 128) & shared.NON_ALNUM[low[ends - 1]]), starts)
    high = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(low >= 128, out=high[1:])
    kind = (low[last] % 8).astype(np.uint64) << np.uint64(1) | (high[ends] > high[starts]).astype(np.uint64)
    return shared.span_hashes(low, starts, ends) & ~np.uint64(RARE - 1) | kind, docs


def counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], names=["word", "c"])

        for batch in batches:
            for at, end, data, offsets in shared.slices(batch):
                words, _ = _words(data, offsets)
                held += [words, np.full(end - at, END_WORD, dtype=np.uint64)]
                size += len(words)
                if size > 3_000_000:
                    yield summed()
                    size = 0
        if held:
            yield summed()

    return docs.select("text").mapInArrow(shared.tidy(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _rare(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(RARE - 1)).astype(np.int64)


def _index(names: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted names, whether it is there)."""
    if not len(names):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    at = np.minimum(np.searchsorted(names, words), len(names) - 1)
    return at, names[at] == words


def _sequences(words: np.ndarray, docs: np.ndarray, n_docs: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, one before, two before, document) of every token, with the end after each text."""
    length = np.bincount(docs, minlength=n_docs) + 1
    ends = np.cumsum(length) - 1
    token = np.empty(len(words) + n_docs, dtype=np.int64)
    place = np.arange(len(words)) + docs
    token[place] = classes
    token[ends] = END
    one, two = np.full(len(token), START), np.full(len(token), START)
    one[1:], two[2:] = token[:-1], token[:-2]
    first = ends - length + 1
    one[first] = START
    two[first] = START
    second = first[length > 1] + 1
    two[second] = START
    return token, one, two, np.repeat(np.arange(n_docs), length)


@dataclass(frozen=True)
class Layout:
    """Places of the symbols that can follow (all but the start), by falling share, and the groups that cut them."""

    share: np.ndarray  # of each symbol
    place: np.ndarray  # of each symbol; the start has none
    cuts: np.ndarray  # first place of each group, and the end
    group: np.ndarray  # of each place

    @staticmethod
    def of(share: np.ndarray) -> Layout:
        can = np.array([s for s in range(len(share)) if s != START])
        order = can[np.argsort(-share[can], kind="stable")]
        part = share[order] / share[order].sum()
        wanted = int(np.ceil(np.sqrt(len(order))))
        _, group = np.unique(np.minimum(((np.cumsum(part) - part / 2) * wanted).astype(np.int64), wanted - 1), return_inverse=True)
        place = np.full(len(share), -1)
        place[order] = np.arange(len(order))
        full = share.astype(float).copy()
        full[START] = 0.0
        return Layout(full / full.sum(), place, np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(order)), group)

    def masses(self) -> tuple[np.ndarray, np.ndarray]:
        """(share of each place, share of each group)."""
        part = np.zeros(len(self.group))
        part[self.place[self.place >= 0]] = self.share[self.place >= 0]
        return part, np.add.reduceat(part, self.cuts[:-1])


Parameters = dict[str, np.ndarray]


def start(layout: Layout) -> Parameters:
    """The unigram model: contexts have vectors, and nothing leans on them yet."""
    part, mass = layout.masses()
    random = np.random.default_rng(17)
    out = {
        "q": random.normal(0, 0.3, (len(layout.share), WIDTH)), "c1": np.full(WIDTH, 0.6), "c2": np.full(WIDTH, 0.4),
        "r": np.zeros((len(part), WIDTH)), "b": np.log(part / mass[layout.group]), "t": np.zeros((len(mass), WIDTH)), "a": np.log(mass),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k], at = values[at : at + n].reshape(like[k].shape).astype(np.float32), at + n
    return out


def nce(token: np.ndarray, one: np.ndarray, two: np.ndarray, layout: Layout, p: Parameters, seed: int = 29) -> Parameters:
    """One pass of Adagrad: each token's group against NOISE shared draws per batch, and the token against WORD_NOISE draws from its group."""
    random = np.random.default_rng(seed)
    p = {k: v.copy() for k, v in p.items()}
    past = {k: np.ones_like(v) for k, v in p.items()}
    part, mass = layout.masses()
    ends, group_ends = np.cumsum(part), np.cumsum(mass)
    log_group = np.log(NOISE * mass).astype(np.float32)
    log_word = np.log(WORD_NOISE * part / mass[layout.group]).astype(np.float32)
    alone = np.diff(layout.cuts) == 1

    def step(at: np.ndarray, **grads: np.ndarray) -> None:
        """Parameters of the same rows move together, so that these are sorted once."""
        order = np.argsort(at.astype(np.uint16), kind="stable")  # symbols, places and groups are fewer than 65,536: sorted by digits
        rows = at[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        rows = rows[first]
        for name, grad in grads.items():
            total = np.add.reduceat(grad[order], first, axis=0)
            seen = past[name][rows] + total * total
            past[name][rows] = seen
            p[name][rows] -= LEARN_RATE * total / np.sqrt(seen)

    def wrong(logit: np.ndarray, truth: bool) -> np.ndarray:
        """The derivative of the loss of telling a token (or noise) apart; takes the place of the logits."""
        np.clip(logit, -30, 30, out=logit)
        np.exp(np.negative(logit, out=logit), out=logit)
        logit += 1
        np.divide(1, logit, out=logit)
        if truth:
            logit -= 1
        return logit

    order = random.permutation(len(token))
    for k in range(0, len(order), BATCH):
        at = order[k : k + BATCH]
        w, x, y = layout.place[token[at]], one[at], two[at]
        g = layout.group[w]
        q_one, q_two = p["q"][x], p["q"][y]
        context = p["c1"] * q_one + p["c2"] * q_two
        other = np.minimum(np.searchsorted(group_ends, random.random(NOISE)), len(mass) - 1)
        t_true, t_other = p["t"][g], p["t"][other]
        true = wrong(np.einsum("ij,ij->i", context, t_true) + p["a"][g] - log_group[g], True)
        false = context @ t_other.T
        false += p["a"][other]
        false -= log_group[other]
        false = wrong(false, False)
        lean = true[:, None] * t_true + false @ t_other
        low = layout.cuts[g]
        drawn = ends[low][:, None] - part[low][:, None] + random.random((len(at), WORD_NOISE)) * mass[g][:, None]
        noise = np.clip(np.searchsorted(ends, drawn), low[:, None], layout.cuts[g + 1][:, None] - 1)
        counts = (~alone[g]).astype(np.float32)
        r_true, r_noise = p["r"][w], p["r"][noise]
        word = wrong(np.einsum("ij,ij->i", context, r_true) + p["b"][w] - log_word[w], True) * counts
        not_word = wrong(np.einsum("ij,ikj->ik", context, r_noise) + p["b"][noise] - log_word[noise], False) * counts[:, None]
        lean += word[:, None] * r_true + np.einsum("ik,ikj->ij", not_word, r_noise)
        step(np.concatenate([g, other]), t=np.concatenate([true[:, None] * context, false.T @ context]), a=np.concatenate([true, false.sum(axis=0)]))
        step(
            np.concatenate([w, noise.ravel()]), r=np.concatenate([word[:, None] * context, (not_word[:, :, None] * context[:, None]).reshape(-1, WIDTH)]),
            b=np.concatenate([word, not_word.ravel()]),
        )
        lean_one, lean_two = (lean * q_one).sum(axis=0), (lean * q_two).sum(axis=0)
        step(np.concatenate([x, y]), q=np.concatenate([lean * p["c1"], lean * p["c2"]]))
        for name, grad in (("c1", lean_one), ("c2", lean_two)):
            past[name] += grad * grad
            p[name] -= LEARN_RATE * grad / np.sqrt(past[name])
    return p


def log_probabilities(token: np.ndarray, one: np.ndarray, two: np.ndarray, layout: Layout, p: Parameters) -> np.ndarray:
    """Natural logarithms of the tokens' probabilities after the two symbols before, normalised over all symbols."""
    out = np.empty(len(token))

    def settled(context: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
        logits = context @ vectors
        logits += bias
        mine, top = logits[np.arange(len(at)), at], logits.max(axis=1)
        logits -= top[:, None]
        return mine - top - np.log(np.exp(logits, out=logits).sum(axis=1))

    for k in range(0, len(token), AT_ONCE):
        w = layout.place[token[k : k + AT_ONCE]]
        g = layout.group[w]
        context = p["c1"] * p["q"][one[k : k + AT_ONCE]] + p["c2"] * p["q"][two[k : k + AT_ONCE]]
        now = np.empty(len(w))
        for m in range(0, len(w), ROWS):
            now[m : m + ROWS] = settled(context[m : m + ROWS], p["t"].T, p["a"], g[m : m + ROWS])
        order = np.argsort(g.astype(np.uint16), kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            low, high = layout.cuts[g[rows[0]]] if len(rows) else 0, layout.cuts[g[rows[0]] + 1] if len(rows) else 0
            if high - low > 1:
                vectors, bias = p["r"][low:high].T, p["b"][low:high]
                step = max(1, min(ROWS, CELLS // int(high - low)))
                for m in range(0, len(rows), step):
                    some = rows[m : m + step]
                    now[some] += settled(context[some], vectors, bias, w[some] - low)
        out[k : k + AT_ONCE] = now
    return out


def fitted_shard(ids: np.ndarray, lengths: np.ndarray, layout: Layout, p: Parameters) -> tuple[int, np.ndarray]:
    """(number of tokens, parameters one after the other) from all tokens of a shard's texts of so many symbols each."""
    token, one, two, _ = _sequences(ids, np.repeat(np.arange(len(lengths)), lengths), len(lengths), ids)
    return len(token), flat(nce(token, one, two, layout, p))


def train(docs: DataFrame, names: np.ndarray, symbols: np.ndarray, layout: Layout, tokens: int) -> Parameters:
    """The averaged model of all texts, of about so many tokens; names are sorted words, symbols theirs."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((names, symbols, layout))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, symbols, _ = shipped.value
        for batch in batches:
            for at, end, data, offsets in shared.slices(batch):
                words, of = _words(data, offsets)
                place, found = _index(names, words)
                ids = np.where(found, symbols[place] if len(symbols) else 0, _rare(words)).astype(np.int32)
                cuts = np.searchsorted(of, np.arange(end - at + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))], names=["row", "ids"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Averages of blocks; the rows come sorted by block."""
        block, total, weight = None, np.zeros(0), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()])], names=["block", "values"])

        for batch in batches:
            for b, n, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(values, dtype=np.float32).astype(float)
                if b != block:
                    if block is not None:
                        yield out()
                    block, total, weight = b, np.zeros(len(x)), 0
                total += n * x
                weight += n
        if block is not None:
            yield out()

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row"), "text")
    dealt = stash(rows.mapInArrow(shared.tidy(read), "row long, ids array<int>"), "symbols")
    shards = max(1, -(-tokens // SHARD_TOKENS))
    shard = sharded(dealt, shards)
    model = start(layout)
    known = spark.sparkContext.broadcast(model)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, held, last = shipped.value[2], [], None

        def out() -> Iterator[pa.RecordBatch]:
            ids, lengths = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (0, 1))
            held.clear()
            tokens, values = fitted_shard(ids, lengths, layout, known.value)
            for k in range(0, len(values), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([tokens]), pa.array([values[k : k + BLOCK].tobytes()])], names=["block", "tokens", "values"])

        for batch in batches:
            of = np.asarray(batch.column(0))
            edges = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *edges], [*edges, len(of)], strict=True):
                if a == b:
                    continue
                if held and of[a] != last:
                    yield from out()
                last, lists, copies = of[a], batch.column(1).slice(a, b - a), np.asarray(batch.column(2))[a:b]
                if (copies > 1).any():
                    lists = lists.take(pa.array(np.repeat(np.arange(b - a), copies)))
                held.append((np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))))
        if held:
            yield from out()

    # shards are keys, so however many partitions there are, there are as many models as shards
    fitted = shard.repartition(shards, "shard").sortWithinPartitions("shard", "row").select("shard", "ids", "copies").mapInArrow(shared.tidy(fit), "block int, tokens long, values binary")
    blocks = fitted.repartition("block").sortWithinPartitions("block").mapInArrow(shared.tidy(summed), "block int, values binary").collect()  # the model's size
    if blocks:
        model = shaped(np.concatenate([np.frombuffer(r["values"], dtype=np.float32) for r in sorted(blocks)]), model)
    known.unpersist()
    free(dealt)
    return model


def sharded(dealt: DataFrame, shards: int) -> DataFrame:
    """(shard, row, ids, copies) of rows (row, ids): equal rows fall into one shard, unless their repeats hold more than an eighth of a shard's
    tokens. Such a row is kept once for each eighth, which stands for its share of the copies, so no repetition fills a shard."""
    one = dealt.select(F.pmod("row", F.lit(shards)).alias("shard"), "row", "ids", F.lit(1).cast("long").alias("copies"))
    if shards == 1:
        return one
    share = max(1, SHARD_TOKENS // 8)
    often = dealt.groupBy("row").agg(F.sum(F.size("ids")).alias("tokens"), F.count(F.lit(1)).alias("n")).where((F.col("tokens") > share) & (F.col("n") > 1))
    often = stash(often, "often")  # eight rows a shard at most, mostly none: its true size decides how it joins
    m = F.least(F.ceil(F.col("tokens") / share), F.col("n"))
    once = dealt.join(often, "row").groupBy("row", "n", m.alias("m")).agg(F.first("ids").alias("ids"))
    parts = once.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    copies = F.expr("n div m") + (F.col("j") < F.col("n") % F.col("m")).cast("long")
    return one.join(often, "row", "left_anti").unionByName(parts.select(F.pmod(F.xxhash64("row", "j"), F.lit(shards)).alias("shard"), "row", "ids", copies.alias("copies")))


def scores(docs: DataFrame, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    training = docs.where(F.coalesce(shared.crc_mod() != fold, F.lit(True)))
    table = stash(counts(training), "counts")
    total, distinct = (int(x or 0) for x in table.agg(F.sum("c"), F.count(F.lit(1))).first())
    word, c = shared.most_frequent(table, "word", "c", CARRIED)
    word, c = word.astype(np.int64).view(np.uint64), c.astype(np.int64)
    symbols = _rare(word)
    own = np.flatnonzero((word != END_WORD) & (c >= LEAST))[:VECTORS]
    symbols[own] = np.arange(len(own)) + FIRST
    symbols[word == END_WORD] = END
    # all words by their kind, less those that have symbols of their own
    count, distinct_in = np.zeros(FIRST + len(own)), np.zeros(RARE)
    for k, n, w in table.groupBy(F.col("word").bitwiseAND(RARE - 1).alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        count[k], distinct_in[k] = n, w
    mine = symbols >= RARE
    np.subtract.at(count, _rare(word[mine]), c[mine])
    np.subtract.at(distinct_in, _rare(word[mine]), 1)
    count[symbols[mine]] = c[mine]
    layout = Layout.of(count + 0.5)
    rare_bits = np.log10(count[:RARE] + 0.5 * (distinct_in + 1))
    order = np.argsort(word)
    word, c, symbols = word[order], c[order], symbols[order]
    named = symbols >= RARE
    model = train(training, word[named], symbols[named], layout, total)
    shipped = spark.sparkContext.broadcast((word, c, symbols, layout, model, rare_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, c, symbols, layout, p, rare_bits = shipped.value
        log_c = np.log10(c + 0.5)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, end, data, offsets in shared.slices(batch):
                n = end - at
                words, of = _words(data, offsets)
                place, found = _index(word, words)
                of_word = np.where(found, symbols[place] if len(symbols) else 0, _rare(words))
                token, one, two, docs_of = _sequences(words, of, n, of_word)
                by_class = np.bincount(docs_of, weights=log_probabilities(token, one, two, layout, p), minlength=n) / np.log(10)
                known = np.where(found, log_c[place] if len(word) else 0.0, 0.0)
                is_end, there = _index(word, np.full(1, END_WORD, dtype=np.uint64))
                end_log = float(log_c[is_end[0]]) if there[0] else float(np.log10(0.5))
                base = np.bincount(of, weights=known, minlength=n) + end_log
                rare = of_word < RARE
                in_rare = np.bincount(of[rare], weights=(known - rare_bits[np.where(rare, of_word, 0)])[rare], minlength=n)
                out = ~found
                cuts = np.searchsorted(of[out], np.arange(n + 1))
                rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words[out].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), pa.array(np.bincount(docs_of, minlength=n)),
                        pa.array(np.bincount(of[found], minlength=n) + int(there[0])),
                        pa.array(base), pa.array(by_class + in_rare), rest,
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest"],
                )
                row += n

    ddl = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, rest array<long>"
    rows = stash(docs.select("doc_id", "text").mapInArrow(shared.tidy(run), ddl), "scores")
    # words beyond the carried ones meet their counts by a join; each row's part is summed before the shuffle by row
    posted = rows.select("row", F.explode("rest").alias("word")).join(table, "word", "left")
    posted = posted.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("more_known"))
    base_bits = float(np.log10(total + 0.5 * (distinct + 1)))
    joined = rows.drop("rest").join(posted, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id", F.coalesce(shared.crc_mod() == fold, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * base_bits).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
