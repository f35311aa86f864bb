"""Coordinate windows, runs, ranks, carried values and cumulative sums over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(df: DataFrame, at: str, size: int, shift: int, out: str = "block_id") -> DataFrame:
    """A row for each window [k * shift, k * shift + size), k >= 0, that holds the coordinate."""
    first = F.greatest(F.lit(0), F.floor((F.col(at) - size) / shift) + 1)
    return df.withColumn(out, F.explode(F.sequence(first, F.floor(F.col(at) / shift))))


def counted(df: DataFrame, keys: list[str], order: list[str], size: int, shift: int, out: str = "block_id", width: float | None = None) -> DataFrame:
    """Windows of `size` consecutive rows, every `shift` rows; the last ones may be partial.

    With a `width` rows are numbered within ranges of the first order column, and the counts of the ranges before are added:
    so a key of very many rows is as many tasks as it has ranges."""
    if not width:
        place = df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
        return sliding(place, "__place", size, shift, out).drop("__place")
    ranged = df.withColumn("__range", F.floor(F.col(order[0]) / width))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    count = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    count = count.select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)) - 1)
    place = own.join(count, [*keys, "__range"]).withColumn("__place", F.col("__own") + F.col("__before"))
    return sliding(place, "__place", size, shift, out).drop("__place", "__range", "__own", "__before")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__row = 1").drop("__row")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, start: Column, end: Column) -> DataFrame:
    """Maximal runs of an equal value: keys, run (from 1), value, n, start and end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", value).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("start"), F.max(end).alias("end"))


def rank_votes(keys: list[str], score: str, tie: list[str]) -> Column:
    """1 for the best down to 0 for the worst, by rank; 1 alone."""
    w = Window.partitionBy(*keys)
    n, rank = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.desc(score), *tie))
    return F.when(n < 2, 1.0).otherwise(1 - (rank - 1) / (n - 1))


def tied_rank(keys: list[str], score: str) -> Column:
    """(n - mean rank) of equal scores, normalised to sum 1 within the keys; even where all are alone."""
    every, same = Window.partitionBy(*keys), Window.partitionBy(*keys, score)
    n = F.count(F.lit(1)).over(every)
    mean = F.rank().over(every.orderBy(F.desc(score))) + (F.count(F.lit(1)).over(same) - 1) / 2
    return F.when(n < 2, 1.0).otherwise((n - mean) / (n * (n - 1) / 2))


def tempered(keys: list[str], score: str, power: Column, floor: float = 0.0) -> Column:
    """A softmax of score / power within the keys, mixed with an even share at weight `floor`."""
    w = Window.partitionBy(*keys)
    x = F.col(score) / power
    part = F.exp(x - F.max(x).over(w))
    return (1 - floor) * part / F.sum(part).over(w) + floor / F.count(F.lit(1)).over(w)


def support(df: DataFrame, keys: list[str], label: str, share: str, coverage: float = 0.95) -> DataFrame:
    """The likeliest labels until their shares reach `coverage`, written `label:0.123` in order, with semicolons between."""
    w = Window.partitionBy(*keys).orderBy(F.desc(share), label)
    before = F.coalesce(F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = df.filter(F.col(share) > 0).withColumns({"__before": before, "__place": F.row_number().over(w)}).filter(F.col("__before") < coverage)
    entry = F.struct("__place", F.format_string("%s:%.3f", F.col(label), F.round(share, 3)).alias("text"))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ";").alias("support"), F.count(F.lit(1)).alias("n_support"))


def carried(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def cumulative(value: Column, keys: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def left_out_mean(keys: list[str], value: str) -> Column:
    """The mean of the other rows of the keys; null alone."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    return F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))


def systematic(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each key, at places floor(i * n / most)."""
    w = Window.partitionBy(*keys)
    marked = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy(*order)) - 1})
    # row i is taken if it is floor(j * n / most) for some j < most
    j = F.ceil(F.col("__i") * most / F.col("__n"))
    taken = (F.col("__n") <= most) | ((j < most) & (F.floor(j * F.col("__n") / most) == F.col("__i")))
    return marked.filter(taken).drop("__n", "__i")
