"""Sparse layered transition tables: even starts, smoothing, log-space products and folding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import crossed


def even_transitions(nodes: DataFrame, keys: list[str], layer: str, node: str, gap: int = 1) -> DataFrame:
    """Edges from each node to all of the layer `gap` on, of equal chance out of it."""
    a = nodes.select(*keys, F.col(layer).alias("layer"), F.col(node).alias("h_from"))
    b = nodes.select(*keys, (F.col(layer) - gap).alias("layer"), F.col(node).alias("h_to"))
    after = [*keys, "layer"]
    twice = a.groupBy(*after, "h_from").agg(F.count(F.lit(1)).alias("__times"))  # a node that is there twice shares its chance out
    out = b.groupBy(*after).agg(F.count(F.lit(1)).alias("__out"))
    chance = twice.join(out, after).select(*after, "h_from", (1 / (F.col("__times") * F.col("__out"))).alias("p"))
    first = a.join(chance, [*after, "h_from"])
    return crossed(first, b, after).select(*after, "h_from", "h_to", "p")


def smoothed(old: DataFrame, new: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """old * (1 - rate) + new * rate, by key; new where there was none. Both have a column p."""
    return new.join(old.withColumnRenamed("p", "__old"), keys, "left").select(*keys, F.when(F.col("__old").isNull(), F.col("p")).otherwise(F.col("__old") * (1 - rate) + F.col("p") * rate).alias("p"))


def log_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """The log-space product of (i, k, x) and (k, j, x): (i, j, x), with the greatest term taken out before exponents."""
    terms = left.select("i", "k", F.col("x").alias("a")).join(right.select("k", "j", F.col("x").alias("b")), "k").select("i", "j", (F.col("a") + F.col("b")).alias("t"))
    top = terms.groupBy("i", "j").agg(F.max("t").alias("m"))
    return terms.join(top, ["i", "j"]).groupBy("i", "j").agg((F.max("m") + F.log(F.sum(F.exp(F.col("t") - F.col("m"))))).alias("x"))


def folded(matrix: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """The lower triangle added to the upper."""
    return matrix.groupBy(F.least(i, j).alias(i), F.greatest(i, j).alias(j)).agg(F.sum(value).alias(value))


def full_outer_score(overlap: DataFrame, samples: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """(weight * overlap + 2 * samples) / (weight + 2); a score that one side lacks is 0. Both have a column score."""
    both = overlap.withColumnRenamed("score", "a").join(samples.withColumnRenamed("score", "b"), keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(*keys, ((weight * zero("a") + 2 * zero("b")) / (weight + 2)).alias("score"))
