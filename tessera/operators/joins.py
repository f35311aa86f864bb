"""Joins on a coordinate: containment under named boundary rules, as-of, nearest, overlay, and band self-joins.

A containment join buckets the coordinate: a segment goes to each bucket that it touches and a point to its own, so the
join is an equi-join on (keys, bucket) whatever the number of segments, and Spark's adaptive execution splits a hot key.
As-of and nearest joins sort both sides together in a window of the keys, or of ranges of the coordinate within them, and
carry the last or next row over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: start <= x < end; start < x <= end; start <= x <= end
CLOSED = {"left": lambda x, a, b: (x >= a) & (x < b), "right": lambda x, a, b: (x > a) & (x <= b), "both": lambda x, a, b: (x >= a) & (x <= b)}


def crossed(left: DataFrame, right: DataFrame, on: list[str], most: int = 1 << 22) -> DataFrame:
    """left.join(right, on), where few keys have very many rows on both sides: the left rows of a key are dealt to blocks, of `most` pairs or so each, and the right ones go to all of these.

    The number of tasks follows from that of the pairs, not from the bytes read, and neither side is broadcast."""
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    pairs = F.col("__left") * F.col("__right").cast("double")
    size = count(left, "__left").join(count(right, "__right"), on).select(*on, pairs.alias("__pairs"), F.least(F.col("__left"), F.ceil(pairs / most)).cast("int").alias("__blocks"))
    total = size.agg(F.sum("__pairs")).first()[0] or 0.0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / most))
    size = size.drop("__pairs")
    by = [*on, "__block"]
    one = left.join(size, on).withColumn("__block", F.pmod(F.xxhash64(*left.columns), F.col("__blocks")).cast("int")).drop("__blocks")
    two = right.join(size, on).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    return one.repartition(tasks, *by).join(two.repartition(tasks, *by).hint("merge"), by).drop("__block")


def containing(points: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, closed: str = "left", how: str = "inner") -> DataFrame:
    """Each point with the segments of its keys that contain it; `width` is that of a bucket, best near a usual segment's."""
    bucket = lambda x: F.floor(F.col(x) / width)
    marked = points.withColumn("__bucket", bucket(at))
    spread = segments.filter(F.col(end) >= F.col(start)).withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    p, s = marked.alias("p"), spread.alias("s")
    match = CLOSED[closed](F.col(f"p.{at}"), F.col(f"s.{start}"), F.col(f"s.{end}"))
    for key in [*keys, "__bucket"]:
        match = match & (F.col(f"p.{key}") == F.col(f"s.{key}"))
    rest = [F.col(f"s.{c}") for c in segments.columns if c not in keys]
    return p.join(s, match, how).select(*[F.col(f"p.{c}") for c in points.columns], *rest)


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, values: list[str], forward: bool = False, width: float | None = None) -> DataFrame:
    """Each left row with the values of the right row last at or before it (or first at or after it); equal places count. Nulls if there is none.

    With a `width` a key's rows are windows of that range of the coordinate, each led by the last right row of those before
    it: so a hot key is as many tasks as it has ranges, and only a row a range is carried on. Right places must be distinct within the keys."""
    row = F.struct(F.col(other).alias("__at"), *values)
    one = left.select(*keys, F.col(at).alias("__x"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("__right"))
    two = right.select(*keys, F.col(other).alias("__x"), F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), row.alias("__right"))
    both, part = one.unionByName(two), list(keys)
    if width:
        both, part = both.withColumn("__range", F.floor(F.col("__x") / width)), [*keys, "__range"]
        pick = F.min_by if forward else F.max_by
        edge = both.groupBy(*part).agg(pick("__right", F.when(F.col("__right").isNotNull(), F.col("__x"))).alias("__right"))
        along = Window.partitionBy(*keys).orderBy(F.col("__range").desc() if forward else F.col("__range")).rowsBetween(Window.unboundedPreceding, -1)
        carried = edge.select(*part, F.last("__right", ignorenulls=True).over(along).alias("__right")).filter("__right is not null")
        lead = carried.select(*keys, F.col("__right.__at").alias("__x"), F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), "__right", "__range")
        both = both.unionByName(lead)
    order = [F.col("__x").desc() if forward else F.col("__x"), F.col("__right").isNull()]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__met", F.last("__right", ignorenulls=True).over(w)).filter("__left is not null")
    return met.select("__left.*", F.col("__met.__at").alias(other), *[F.col(f"__met.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, values: list[str], width: float | None = None) -> DataFrame:
    """Each left row with the nearest right row; of two equally far the one after."""
    names = [other, *values]
    before = asof(left, right, keys, at, other, values, width=width)
    before = before.select(*left.columns, F.struct(*names).alias("__before"))
    both = asof(before, right, keys, at, other, values, forward=True, width=width)
    after = F.struct(*names)
    gap = lambda s: F.abs(s[other] - F.col(at))
    pick = F.when(F.col(other).isNull(), F.col("__before")).when(F.col(f"__before.{other}").isNull(), after).when(gap(after) <= gap(F.col("__before")), after).otherwise(F.col("__before"))
    return both.select(*left.columns, pick.alias("__near")).select(*left.columns, *[F.col(f"__near.{n}").alias(n) for n in names])


def first_ending(points: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Each point with the first segment that ends at or after it, else the last one; values are null before that segment's start."""
    forward = asof(points, segments, keys, at, end, [start, *values], forward=True)
    last = segments.groupBy(*keys).agg(F.max_by(F.struct(F.col(end).alias(end), F.col(start).alias(start), *values), F.col(end)).alias("__last"))
    joined = forward.join(last, keys, "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"__last.{c}"))
    valid = F.col(at) >= pick(start)
    return joined.select(*points.columns, pick(end).alias(end), pick(start).alias(start), *[F.when(valid, pick(v)).alias(v) for v in values])


def overlay(one: DataFrame, two: DataFrame, keys: list[str], start: str, end: str, first: str, second: str, width: int) -> DataFrame:
    """The elementary intervals of two segmentations, with the owner on each; intervals that neither covers are left out."""
    ends = [d.select(*keys, F.col(c).alias("x")) for d in (one, two) for c in (start, end)]
    breaks = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct()
    w = Window.partitionBy(*keys).orderBy("x")
    pieces = breaks.select(*keys, F.col("x").alias("from"), F.lead("x").over(w).alias("to")).filter("to is not null")
    a = one.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(first).alias("first"))
    b = two.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(second).alias("second"))
    x = containing(pieces, a, keys, "from", "__s", "__e", width).select(*keys, "from", "to", "first")
    y = containing(pieces, b, keys, "from", "__s", "__e", width).select(*keys, "from", "to", "second")
    return x.join(y, [*keys, "from", "to"], "full_outer")


def clip(segments: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """The parts of segments inside a range; empty ones go."""
    return segments.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)}).filter(F.col(start) < F.col(end))
