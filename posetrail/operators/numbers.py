"""Scalars as columns, and exact quantiles of whole tables and of all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_half_up(v: Column) -> Column:
    """floor(v + 0.5) as bigint; null stays null."""
    return F.floor(v + F.lit(0.5)).cast("bigint")


def clipped(v: Column, low: float, high: float) -> Column:
    """v bound to [low, high]; null stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def seconds(row: Column, fps: float = 10.0, places: int = 6) -> Column:
    return F.round(row / F.lit(float(fps)), places)


def polar(x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(distance, angle in radians, in degrees, and the radians of those degrees) of a vector."""
    angle = F.atan2(y, x)
    return F.hypot(x, y), angle, F.degrees(angle), F.radians(F.degrees(angle))


def small(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table has so few rows that a task can hold it; the check reads no more than that many."""
    return table.limit(rows + 1).count() <= rows


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, linear between neighbours, of the non-null values; None where there are none.

    Counts of 1,024 bins narrow the range in a few passes until few values are left, so no task gathers the column.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, least, most = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    known: dict[int, float] = {0: least, n - 1: most}

    def at(rank: int) -> float:
        if rank in known:
            return known[rank]
        low, high, before = least, most, 0
        while low < high:
            width = (high - low) / 1024
            place = F.least(F.floor((F.col("v") - low) / width), F.lit(1023)).alias("bin")
            bins = values.where(F.col("v").between(low, high)).groupBy(place).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
            for b in bins:  # 1,024 at most
                if before + b["n"] > rank:
                    break
                before += b["n"]
            if (b["low"], b["high"]) == (low, high) or b["n"] <= 4096:
                rest = values.where(F.col("v").between(b["low"], b["high"])).groupBy("v").agg(F.count("v").alias("n")).orderBy("v").collect()
                for r in rest:
                    before += r["n"]
                    if before > rank:
                        return r["v"]
            low, high = b["low"], b["high"]
        return low

    out = []
    for share in shares:
        place = (n - 1) * share
        k = int(place)
        a = known[k] = at(k)
        b = a
        if place > k:
            b = known[k + 1] = at(k + 1)
        out.append(a + (b - a) * (place - k))
    return out


def grouped_quantile(df: DataFrame, keys: list[str], value: Column, share: float, accuracy: int = 10_000) -> DataFrame:
    """(keys, quantile): the exact quantile, linear between neighbours, of the non-null values of every group; groups without any have no row.

    A sketch of each group (bounded, merged from all tasks) brackets the wanted rank within four parts in ``accuracy``. One more pass counts
    what lies below the bracket and, by value, what lies in it, and the rank is found among those counts. So a group of any number of
    rows is read by all tasks and only that small part of its distinct values meets. A rank outside of its bracket raises.
    """
    near = 2 / accuracy
    v = df.select(*keys, value.cast("double").alias("v")).where("v is not null")
    ends = v.groupBy(*keys).agg(F.percentile_approx("v", [max(share - near, 0.0), min(share + near, 1.0)], accuracy).alias("ends"))
    j = v.join(ends, keys)
    low, high = F.col("ends")[0], F.col("ends")[1]
    sums = j.groupBy(*keys).agg(F.count("v").alias("total"), F.count(F.when(F.col("v") < low, 1)).alias("below"), F.max(F.when(F.col("v") < low, F.col("v"))).alias("under"), F.min(F.when(F.col("v") > high, F.col("v"))).alias("above"), F.count(F.when(F.col("v") <= high, 1)).alias("upper"))
    sums = sums.withColumn("at", (F.col("total") - 1) * F.lit(share)).withColumns({"first": F.floor("at"), "second": F.ceil("at")})
    inside = j.where(F.col("v").between(low, high)).groupBy(*keys, "v").agg(F.count("v").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))).join(sums, keys)
    reach = F.col("below") + F.col("upto")
    found = inside.groupBy(*keys, "at", "first", "second", "below", "under", "above", "upper").agg(*(F.min(F.when(reach > F.col(r), F.col("v"))).alias(f"of_{r}") for r in ("first", "second")))
    # the value next to the bracket on either side is known too: few rows round ranks by one
    a, b = (F.when(F.col(r) == F.col("below") - 1, F.col("under")).when(F.col(r) == F.col("upper"), F.col("above")).when(F.col(r) >= F.col("below"), F.col(f"of_{r}")) for r in ("first", "second"))
    exact = F.when(F.col("first") == F.col("second"), a).otherwise((F.col("second") - F.col("at")) * a + (F.col("at") - F.col("first")) * b)
    return found.select(*keys, F.coalesce(exact, F.raise_error(F.lit("a rank lies outside of its bracket")).cast("double")).alias("quantile"))


def area_histogram(areas: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, n, x_min) of the areas from 0 to 1.2 times their 99th percentile plus 500; x_min is 0.95 of the least area, where a plot begins."""
    (p99,) = quantiles(areas, column, (0.99,))
    high, low = 1.2 * (p99 or 0.0) + 500, areas.agg(F.min(column)).first()[0]
    place = F.least(F.floor(F.col(column) / (high / bins)), F.lit(bins - 1)).cast("bigint")
    found = areas.where(F.col(column).between(0, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("x_min", F.lit(None if low is None else round(0.95 * float(low), 6)).cast("double"))
