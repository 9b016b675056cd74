"""Running values of ordered groups, in blocks: no task needs a whole group.

A block is a part of a group that its order keeps together (``frame div 4096``, say). Windows run within (group, block); the totals of
blocks, a row each, carry over to later blocks by a window of their own and come back by one join on the keys by which the rows
already lie, so the rows move once and a group of any length is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """An associative fold: of rows, of folded values, and of two values that may be null (none so far)."""

    rows: Callable[[Column], Column]
    totals: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def _or(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


SUM = Fold(F.sum, F.sum, _or(lambda a, b: a + b))
COUNT = Fold(F.count, F.sum, _or(lambda a, b: a + b))
MIN = Fold(F.min, F.min, F.least)
MAX = Fold(F.max, F.max, F.greatest)
XOR = Fold(F.bit_xor, F.bit_xor, _or(lambda a, b: a.bitwiseXOR(b)))
#: The last value that is not null.
LAST = Fold(lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def running(
    df: DataFrame, keys: list[str], order: list[str | Column], block: Column, folds: dict[str, tuple[Fold, Column]] | None = None,
    ahead: dict[str, tuple[Fold, Column]] | None = None, exclusive: bool = False,
) -> DataFrame:
    """df with a column for each fold: of the rows of its group up to each row in ``order`` (``ahead``: from the last row down to it), without
    the row itself if exclusive. LAST and ``ahead`` need an order by column names.

    ``block`` must not fall along the order. Rows of equal order come as the sort leaves them. Keys and blocks are not null; a null one's
    rows count in their own block only. Columns of df with the names of the folds are replaced.
    """
    every = {n: (f, c, False) for n, (f, c) in (folds or {}).items()} | {n: (f, c, True) for n, (f, c) in (ahead or {}).items()}
    names, b = [n for n in df.columns if n not in every], "__block"
    blocked = df.select(*names, *(c.alias(f"__of_{n}") for n, (_, c, _) in every.items()), block.alias(b))
    last = -1 if exclusive else Window.currentRow

    def part(name: str, fold: Fold, back: bool) -> Column:
        way = [F.desc(o) for o in order] if back else order
        return fold.rows(F.col(f"__of_{name}")).over(Window.partitionBy(*keys, b).orderBy(*way).rowsBetween(Window.unboundedPreceding, last))

    def total(name: str, fold: Fold, back: bool) -> Column:
        of = F.col(f"__of_{name}")
        if fold is LAST:
            return (F.min_by if back else F.max_by)(of, F.when(of.isNotNull(), F.struct(*order)))
        return fold.rows(of)

    within = blocked.withColumns({f"__part_{n}": part(n, f, back) for n, (f, _, back) in every.items()})
    sums = blocked.groupBy(*keys, b).agg(*(total(n, f, back).alias(f"__total_{n}") for n, (f, _, back) in every.items()))
    before = lambda back: Window.partitionBy(*keys).orderBy(F.desc(b) if back else F.asc(b)).rowsBetween(Window.unboundedPreceding, -1)
    carried = (f.totals(F.col(f"__total_{n}")).over(before(back)).alias(f"__total_{n}") for n, (f, _, back) in every.items())
    carry = sums.select(*keys, b, *carried, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__blocks")).where("__blocks > 1").drop("__blocks")
    joined = within.alias("l").join(carry.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, b)], "left")
    return joined.select(*(F.col(f"l.{n}") for n in names), *(f.both(F.col(f"r.__total_{n}"), F.col(f"l.__part_{n}")).alias(n) for n, (f, _, _) in every.items()))
