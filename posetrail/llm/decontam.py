"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Of the hashes of its K-word grams, the
least of each run of W is kept; two texts that share a span of K + W - 1 words keep a common hash. Texts that share a hash with an
item are extended: each window whose kept hash is shared is joined with the items' windows by its words themselves, so no hash
decides, and overlapping hits are merged to spans. Items with one window in common meet it as one row.

An item shorter than the window, but not empty, is one window of its own length; each such length is winnowed for itself. Null and
empty texts and items have no words. Rows that repeat a doc_id with one text get equal results each; with different texts each row
has its own. Items without item_id are ignored; repeated items count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetrail.llm.shared import free, free_name, stash

#: Words of a window, and of a hashed gram.
WINDOW = 13
GRAM = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """The words of a text; null has none."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # lower() touches only A-Z where all is ASCII, and is much faster than translate()
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: str, n: int) -> Column:
    """Hashes of the n-word grams in order; none where there are fewer words."""
    h = F.col(hashes)
    return F.when(
        F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(h[i + k] for k in range(n))))
    ).otherwise(F.array().cast("array<bigint>"))


def least_of_runs(grams: str, run: int) -> Column:
    """The least hash of each ``run`` consecutive ones, in order; none where there are fewer."""
    g = F.col(grams)
    if run == 1:
        return g
    least = F.transform(F.sequence(F.lit(1), F.size(g) - (run - 1)), lambda i: F.array_min(F.slice(g, i, F.lit(run))))
    return F.when(F.size(g) >= run, least).otherwise(F.array().cast("array<bigint>"))


def _windows(df: DataFrame, length: int, keys: list[str], shared: str | None = None) -> DataFrame:
    """(keys, length, at, window) of the windows of so many words w, from 0, as text; with ``shared``, an array column, of those whose
    kept hash is in it."""
    k = min(GRAM, length)
    some = df.where(F.size("w") >= length).select(*keys, "w", *([shared] if shared else []), word_hashes("w").alias("h"))
    some = some.withColumn("g", grams("h", k)).withColumn("least", least_of_runs("g", length - k + 1))
    at = F.transform("least", lambda x, i: F.struct(i.alias("at"), x.alias("print")))
    if shared:
        at = F.filter(at, lambda x: F.array_contains(shared, x["print"]))
    rows = some.select(*keys, "w", F.explode(at).alias("x")).select(*keys, F.col("x.at").alias("at"), F.slice("w", F.col("x.at") + 1, F.lit(length)).alias("words"))
    return rows.select(*keys, F.lit(length).alias("length"), F.col("at").cast("long").alias("at"), F.array_join("words", " ").alias("window"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit (words inside any occurrence of an item's window), item_ids (sorted
    strings) and spans (start, end of merged hits, in words)."""
    items = stash(
        benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words().alias("w"))
        .where(F.size("w") > 0).select("item_id", F.size("w").alias("n"), "w").distinct(), "items",
    )
    short = [r[0] for r in items.where(F.col("n") < window).select("n").distinct().collect()]  # under ``window`` numbers
    lengths = sorted({window, *short})
    of = {n: items.where(F.col("n") >= window if n == window else F.col("n") == n) for n in lengths}

    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words().alias("w"))
    prints = keyed.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), word_hashes("w").alias("h"))
    keys = ["doc_id", "text_key"]
    for n in lengths:
        k = min(GRAM, n)
        prints = prints.withColumn("g", grams("h", k)).withColumn(f"p{n}", F.array_distinct(least_of_runs("g", n - k + 1))).drop("g")
    table = stash(prints.drop("h"), "prints")

    def item_prints(n: int) -> DataFrame:
        k = min(GRAM, n)
        kept = of[n].select(word_hashes("w").alias("h")).select(grams("h", k).alias("g")).select(least_of_runs("g", n - k + 1).alias("least"))
        return kept.select(F.lit(n).alias("length"), F.explode("least").alias("print"))

    known = stash(_all([item_prints(n) for n in lengths]).distinct(), "item-prints")
    doc_prints = _all([table.select(*keys, F.lit(n).alias("length"), F.explode(f"p{n}").alias("print")) for n in lengths])
    hit = doc_prints.join(known, ["length", "print"], "left_semi")
    hit = hit.groupBy(*keys).agg(*(F.collect_set(F.when(F.col("length") == n, F.col("print"))).alias(f"s{n}") for n in lengths))
    hit = stash(hit.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), *(f"s{n}" for n in lengths)), "hit-documents")

    suspects = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    suspects = suspects.join(hit, same).drop("hit_id", "hit_key").dropDuplicates(keys).withColumn("w", words()).drop("text")
    item_windows = _all([_windows(of[n], n, ["item_id"]) for n in lengths]).groupBy("length", "window")
    item_windows = stash(item_windows.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")), "item-windows")
    hits = _all([_windows(suspects, n, keys, f"s{n}") for n in lengths]).join(item_windows, ["length", "window"])
    hits = stash(hits.select(*keys, "at", (F.col("at") + F.col("length")).alias("end"), "item_ids"), "hits")
    free(items, known, hit, item_windows)

    places = hits.groupBy(*keys, "at").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reach = places.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(-1)))
    runs = reach.withColumn("run", F.sum((F.col("at") > F.col("reach")).cast("int")).over(Window.partitionBy(*keys).orderBy("at")))
    spans = runs.groupBy(*keys, "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    found = hits.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")).alias("i")
    same = F.col("i.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("i.text_key") == F.col("s.text_key"))
    found = found.join(spans.alias("s"), same).select(F.col("i.doc_id"), F.col("i.text_key"), "item_ids", "n_hit", "spans")
    found = stash(found, "found")
    free(hits)

    rows = table.select(*keys, "n_words").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("d.text_key").eqNullSafe(F.col("f.text_key"))
    return rows.join(found.alias("f"), same, "left").select(
        "d.doc_id", "d.text_key", "d.n_words", F.coalesce("f.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("f.item_ids", F.array().cast("array<string>")).alias("item_ids"), "f.spans",
    )


def contaminated() -> Column:
    """A twentieth of the words is hit, and one at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; the keys of these (the fewer) are joined away."""
    bad = contamination(docs, benchmark).where(contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = stash(bad, "contaminated")
    name = free_name(docs, "text_key")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.bad_id")) & (F.col(f"d.{name}") == F.col("b.bad_key"))
    return docs.withColumn(name, F.xxhash64("text")).alias("d").join(bad.alias("b"), same, "left_anti").drop(name)
