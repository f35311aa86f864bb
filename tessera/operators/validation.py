"""Comparisons of what was found with what is true: matches in both directions, bijections, phase, accuracies."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distances(one: DataFrame, two: DataFrame, keys: list[str], site: str, allele: str) -> DataFrame:
    """(keys, a, b, sites, percent): the share of sites at which two haplotypes, (keys, hap, site, allele) each, differ."""
    a = one.select(*keys, site, F.col("hap").alias("a"), F.col(allele).alias("__x"))
    b = two.select(*keys, site, F.col("hap").alias("b"), F.col(allele).alias("__y"))
    met = a.join(b, [*keys, site]).groupBy(*keys, "a", "b")
    return met.agg(F.count(F.lit(1)).alias("sites"), (100 * F.avg((F.col("__x") != F.col("__y")).cast("double"))).alias("percent"))


def best_match(distances: DataFrame, keys: list[str], of: str, other: str, least: float = 2.0) -> DataFrame:
    """(keys, of, best, percent, found): the nearest other of each, of equal ones the first; found below `least` percent."""
    best = distances.groupBy(*keys, of).agg(F.min(F.struct("percent", F.col(other).alias("best"))).alias("m"))
    return best.select(*keys, of, "m.best", "m.percent", (F.col("m.percent") < least).alias("found"))


def bijection(agreement: DataFrame, keys: dict[str, str], of: str, to: str, score: str) -> DataFrame:
    """(keys, of, to): the pair that agrees best is taken, and both go; then the next; ties in order of `of`, then `to`. What is left over has null.

    A group's pairs are those of two panels of haplotypes, so a group is small; Spark deals out the groups."""
    kind = agreement.schema[of].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, of, to], ascending=[False, True, True], kind="stable")
        taken, free = {}, set(rows[to])
        for a, b in zip(rows[of], rows[to], strict=True):
            if a not in taken and b in free:
                taken[a] = b
                free.discard(b)
        every = sorted(set(rows[of]))
        return pd.DataFrame({n: [v] * len(every) for n, v in zip(keys, key, strict=True)} | {of: every, to: pd.array([taken.get(a) for a in every], dtype="Int64")})

    shape = ", ".join([*(f"{k} {t}" for k, t in keys.items()), f"{of} {kind}", f"{to} long"])
    return agreement.select(*keys, of, to, score).groupBy(*keys).applyInPandas(run, shape)


def phase_accuracy(rows: DataFrame, keys: list[str], t1: Column, t2: Column, f1: Column, f2: Column) -> DataFrame:
    """(keys, n, direct, flipped, dominant, accuracy): rows right as they are, and with the strands exchanged; the better (direct, if equal) names the phase; a row is right either way."""
    direct, flipped = (t1 == f1) & (t2 == f2), (t1 == f2) & (t2 == f1)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(direct).alias("direct"), F.count_if(flipped).alias("flipped"), F.avg((direct | flipped).cast("double")).alias("accuracy"))
    return total.withColumn("dominant", F.when(F.col("direct") >= F.col("flipped"), "direct").otherwise("flipped"))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Distinct rows that only one of two tables has, with `side` (1 or 2)."""
    return one.subtract(two).withColumn("side", F.lit(1)).unionByName(two.subtract(one).withColumn("side", F.lit(2)))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that are unique on both sides; a repeated one is an error."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        return df.withColumn("__n", n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"repeated key on the {side}: "), text)))).drop("__n")

    return unique(left, "left").join(unique(right, "right"), keys, "left")


def looked_up(df: DataFrame, column: str, names: dict, out: str) -> DataFrame:
    """A column of what `names` has for each value; null where it has none."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


@lru_cache(maxsize=512)
def t_quantile(n: int, level: float = 0.95) -> float:
    """Student's t for n - 1 degrees of freedom, by integrating its density: with x = sqrt(v) * tan(a) that is cos(a)^(v - 1), which is smooth."""
    v, target = n - 1, level / 2
    scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
    low, high = 0.0, math.pi / 2
    for _ in range(60):
        top = (low + high) / 2
        area = scale * float((np.cos((_NODES + 1) * top / 2) ** (v - 1) * _WEIGHTS).sum()) * top / 2
        low, high = (top, high) if area < target else (low, top)
    return math.sqrt(v) * math.tan(low)


def mean_interval(df: DataFrame, keys: list[str], value: str, seed: str | None = None, level: float = 0.95, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(keys, n, mean, sem, lower, upper and, with `seed`, seeds): the mean's t interval, clipped to [low, high]; one value has a width of 0. Values that aren't finite count for nothing.

    The quantile is read off a table of degrees of freedom up to 200 and is a normal one (to 1 %) beyond."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    aggregates = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("sem")]
    if seed:
        aggregates.append(F.array_join(F.array_sort(F.collect_set(seed)), ",").alias("seeds"))
    table = F.array(*[F.lit(0.0 if n < 2 else t_quantile(n, level)) for n in range(1, 202)])
    t = F.element_at(table, F.least("n", F.lit(201)).cast("int"))
    out = finite.groupBy(*keys).agg(*aggregates).withColumn("__half", t * F.col("sem"))
    clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return out.withColumns({"lower": clip(F.col("mean") - F.col("__half")), "upper": clip(F.col("mean") + F.col("__half"))}).drop("__half")
