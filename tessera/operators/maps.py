"""Recombination maps: edges, regional and local rates, contrasts, and curves on common edges. Events are (contig, track, midpoint); meioses are counted apart, as those without an event count too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name, from, to: shares of a contig's length.
REGIONS = (("first", 0.0, 0.2), ("middle", 0.2, 0.8), ("last", 0.8, 1.0))


def edges(contigs: DataFrame, key: str, low: str, high: str, width: int, boundaries: DataFrame | None = None) -> DataFrame:
    """(key, edge): every `width` from low, and high; with the places of `boundaries` (key, edge) that lie between."""
    regular = contigs.select(key, F.explode(F.array_union(F.sequence(F.col(low), F.col(high), F.lit(width).cast("long")), F.array(F.col(high)))).alias("edge"))
    if boundaries is None:
        return regular
    inside = boundaries.join(contigs, key).filter((F.col("edge") > F.col(low)) & (F.col("edge") < F.col(high))).select(key, "edge")
    return regular.union(inside).distinct()


def gametes(records: DataFrame, keys: list[str], midpoints: str) -> tuple[DataFrame, DataFrame]:
    """Records of one gamete each, with an array of crossovers: its events (keys, midpoint), and meioses (keys, meioses), to which gametes without events count."""
    return records.select(*keys, F.explode(midpoints).alias("midpoint")), records.groupBy(*keys).agg(F.count(F.lit(1)).alias("meioses"))


def regional(events: DataFrame, meioses: DataFrame, keys: list[str], contig: str, length: float, regions=REGIONS) -> DataFrame:
    """(keys, region, events, exposure, rate): events with a midpoint in [from, to) of the contigs' length (the last region is closed), over meioses * width.

    keys include the contig in `events` and `meioses`; the result sums over contigs."""
    rest = [k for k in keys if k != contig]
    name = F.lit(None).cast("string")
    last = max(b for _, _, b in regions)
    for region, a, b in regions:
        upper = F.col("midpoint") <= b * length if b == last else F.col("midpoint") < b * length
        name = F.when((F.col("midpoint") >= a * length) & upper, region).otherwise(name)
    count = events.withColumn("region", name).filter("region is not null").groupBy(*rest, "region").agg(F.count(F.lit(1)).alias("events"))
    width = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.lit((b - a) * length).alias("width")) for r, a, b in regions]))
    exposure = meioses.select(*rest, "meioses", width.alias("w")).groupBy(*rest, "w.region").agg(F.sum(F.col("meioses") * F.col("w.width")).alias("exposure"))
    met = exposure.join(count, [*rest, "region"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return met.select(*rest, "region", "events", "exposure", (F.col("events") / F.col("exposure")).alias("rate"))


def contrasts(rates: DataFrame, keys: list[str], base: str = "middle") -> DataFrame:
    """(keys, region, ratio): each other region's rate over the base region's; null where that is 0."""
    middle = rates.filter(F.col("region") == base).select(*keys, F.col("rate").alias("__base"))
    met = rates.filter(F.col("region") != base).join(middle, keys) if keys else rates.filter(F.col("region") != base).crossJoin(F.broadcast(middle))
    return met.select(*keys, "region", F.when(F.col("__base") > 0, F.col("rate") / F.col("__base")).alias("ratio"))


def local(events: DataFrame, meioses: DataFrame, keys: list[str], contig: str, length: float, bins: int = 20) -> DataFrame:
    """(keys, bin, events, relative): events in equal shares of the contigs' length, over the mean of all bins, contigs pooled."""
    rest = [k for k in keys if k != contig]
    bin_ = F.least(F.floor(F.col("midpoint") / length * bins), F.lit(bins - 1)).cast("int")
    count = events.filter((F.col("midpoint") >= 0) & (F.col("midpoint") <= length)).groupBy(*rest, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    every = meioses.select(*rest).distinct().select(*rest, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    met = every.join(count, [*rest, "bin"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return met.withColumn("relative", F.col("events") / F.avg("events").over(Window.partitionBy(*rest)))


def aligned(curves: DataFrame, keys: list[str], curve: str, at: str, value: str) -> DataFrame:
    """Each curve on the union of all curves' places, by linear interpolation between its own; beyond its ends, its end values.

    curves: (keys, curve, at, value), places distinct within a curve."""
    places = curves.select(*keys, at).distinct()
    grid = curves.select(*keys, curve).distinct().join(places, keys)
    met = grid.join(curves, [*keys, curve, at], "left")
    w = Window.partitionBy(*keys, curve).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    met = met.withColumns({"__a": before, "__b": after})
    line = F.col("__a.y") + (F.col(at) - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x")) * (F.col("__b.y") - F.col("__a.y"))
    out = F.when(F.col("__a").isNull(), F.col("__b.y")).when(F.col("__b").isNull() | (F.col("__b.x") == F.col("__a.x")), F.col("__a.y")).otherwise(line)
    return met.select(*keys, curve, at, out.alias(value))


def ratio_interval(components: DataFrame, unit: str, group: str, over: str, under: str, index: DataFrame, level: float = 0.95) -> DataFrame:
    """The ratio of two groups' rates, and percentile bounds of it over the replicates. components: (unit, group, events, exposure); a replicate with nothing below counts for nothing."""
    rate = lambda g, t: F.sum(F.when(F.col(group) == g, F.col("events") * t)) / F.sum(F.when(F.col(group) == g, F.col("exposure") * t))
    ratio = lambda t: rate(over, t) / F.nullif(rate(under, t), F.lit(0.0))
    drawn = F.broadcast(index).join(components.withColumnRenamed(unit, "unit"), "unit").groupBy("replicate").agg(ratio(F.col("times")).alias("ratio"))
    tail = (1 - level) / 2
    bounds = drawn.agg(F.percentile("ratio", F.array(F.lit(tail), F.lit(1 - tail))).alias("b"))
    return components.agg(ratio(F.lit(1)).alias("ratio")).crossJoin(F.broadcast(bounds)).select("ratio", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def flips(keys: list[str], order: str, first: Column, second: Column) -> dict[str, Column]:
    """At a bin: whether it is the first heterozygous one after a homozygous one (`opens`), and whether both tracks change there (`doubled`). Missing alleles change nothing."""
    w = Window.partitionBy(*keys).orderBy(order)
    hom, before = first == second, F.lag(first == second).over(w)
    changed = lambda x: F.coalesce(x != F.lag(x).over(w), F.lit(False))
    opens, doubled = F.coalesce(before & ~hom, F.lit(False)), changed(first) & changed(second)
    return {"opens": opens, "doubled": doubled, "boundary": opens | doubled}


def derivation_score(rows: DataFrame, keys: list[str], order: str, rate: float, lost: float = -20.0) -> DataFrame:
    """(keys, n, score): `lost` for each bin at which a strand's founder is not one of its parent's, and half the log of the chance of a switch for each real one.

    rows: keys, order, width, h1, h2 (the child's founders), a1, a2 (the first's), b1, b2 (the second's). A strand follows the parent's
    strand that has its founder (the first, if both have); a switch is real where a strand follows another one than at the bin before."""
    w = Window.partitionBy(*keys).orderBy(order)
    follows = lambda x, p, q: F.when(x == F.col(p), 0).when(x == F.col(q), 1)
    one, two = follows(F.col("h1"), "a1", "a2"), follows(F.col("h2"), "b1", "b2")
    met = rows.withColumns({"__one": one, "__two": two})
    theta = F.least(F.greatest(F.col("width") * rate, F.lit(1e-15)), F.lit(0.5))
    moved = lambda c: F.coalesce((F.col(c) != F.lag(c).over(w)).cast("int"), F.lit(0))
    gone = F.col("__one").isNull().cast("int") + F.col("__two").isNull().cast("int")
    each = met.withColumn("__x", lost * F.least(gone, F.lit(1)) + 0.5 * F.ln(theta) * (moved("__one") + moved("__two")))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__x").alias("score"))
