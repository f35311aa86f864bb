"""Mixtures of Bernoulli patterns by expectation-maximisation, with restarts and the choice of their number.

Rows of a key are distinct 0/1 patterns with counts; a null place is unknown and counts for nothing. All numbers of components, and all restarts,
are models side by side: a round is one pass over the rows, with the parameters (a few patterns a model) joined by key. Chances of components,
and sums of their patterns, are column expressions and partial aggregates, so no task holds a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import log_sum_exp, mixture_bic

#: Chances of a place stay this far from 0 and 1.
EDGE = 1e-3


def distinct_patterns(rows: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, pattern, n): equal patterns counted."""
    return rows.groupBy(*keys, F.col(pattern).cast("array<int>").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def _log_joint(weight: Column, chance: Column) -> Column:
    """ln of a component's weight and of its chance of the row's pattern."""
    one = F.zip_with("pattern", chance, lambda x, q: F.when(x == 1, F.ln(q)).when(x == 0, F.ln(1 - q)).otherwise(0.0))
    return F.ln(weight) + F.aggregate(one, F.lit(0.0), lambda s, x: s + x)


def _starts(rows: DataFrame, keys: list[str], models: DataFrame, most: int, seed: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, k, turn, centres): the first patterns of each model by k-means++: each is drawn by its count times its distance to those before.

    A draw takes the least of -ln(u) / weight, with u a hash of the pattern, the model and the step: it doesn't depend on how rows are dealt."""
    far = lambda c: F.aggregate(F.zip_with("pattern", c, lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    now = rows.select(*keys).distinct().join(models).withColumn("centres", F.array().cast("array<array<int>>"))  # a few models a key
    for step in range(most):
        met = rows.join(now.filter(F.col("k") > step), keys)
        weight = F.col("n") * (F.lit(1.0) if step == 0 else F.array_min(F.transform("centres", far)))
        u = (F.pmod(F.xxhash64("pattern", "k", "turn", F.lit(seed + step)), F.lit(1 << 40)) + 0.5) / (1 << 40)
        drawn = met.withColumn("__w", weight).groupBy(*keys, "k", "turn").agg(F.min_by("pattern", F.when(F.col("__w") > 0, -F.ln(u) / F.col("__w"))).alias("__new"))
        now = written(now.join(drawn, [*keys, "k", "turn"], "left").withColumn("centres", F.when(F.col("__new").isNotNull(), F.concat("centres", F.array("__new"))).otherwise(F.col("centres"))).drop("__new"))
    return now


def fitted(rows: DataFrame, keys: list[str], most: int, written: Callable[[DataFrame], DataFrame], restarts: int = 2, rounds: int = 60, settled: float = 1e-6, seed: int = 1) -> DataFrame:
    """(keys, k, turn, weights, chances, log_likelihood, bic): every model of 1 to `most` components, `restarts` of each, fitted to rows (keys, pattern, n).

    A round never lowers a likelihood. The rounds end when none rises by more than `settled` of itself, or after `rounds`. A model has fewer components than k
    where a key has fewer patterns. bic: (k * places + k - 1) * ln(N) - 2 * log-likelihood."""
    spark = rows.sparkSession
    rows = written(rows.select(*keys, "pattern", "n"))
    models = spark.range(1, most + 1).select(F.col("id").cast("int").alias("k")).join(spark.range(restarts).select(F.col("id").cast("int").alias("turn")))
    begun = _starts(rows, keys, F.broadcast(models), most, seed, written)
    near = lambda c: F.transform(c, lambda x: F.when(x == 1, 0.8).when(x == 0, 0.2).otherwise(0.5))
    even = F.transform("centres", lambda c: 1.0 / F.size("centres"))
    now = begun.select(*keys, "k", "turn", even.alias("weights"), F.transform("centres", near).alias("chances"), F.lit(float("-inf")).alias("log_likelihood"))
    model = [*keys, "k", "turn"]
    for _ in range(rounds):
        joint = F.zip_with("weights", "chances", _log_joint)
        met = rows.join(now.drop("log_likelihood"), keys).select(*model, "pattern", "n", joint.alias("joint")).withColumn("total", log_sum_exp(F.col("joint")))
        likelihood = met.groupBy(*model).agg(F.sum(F.col("n") * F.col("total")).alias("rose"), F.sum("n").alias("__n"))
        share = met.select(*model, "pattern", "n", "total", F.posexplode("joint").alias("c", "x")).withColumn("share", F.col("n") * F.exp(F.col("x") - F.col("total")))
        weight = share.groupBy(*model, "c").agg(F.sum("share").alias("w"))
        place = share.select(*model, "c", "share", F.posexplode("pattern").alias("at", "bit")).filter("bit is not null")
        place = place.groupBy(*model, "c", "at").agg(F.sum(F.col("share") * F.col("bit")).alias("ones"), F.sum("share").alias("all"))
        chance = F.when(F.col("all") > 0, F.col("ones") / F.col("all")).otherwise(0.5)
        place = place.groupBy(*model, "c").agg(F.array_sort(F.collect_list(F.struct("at", F.least(F.greatest(chance, F.lit(EDGE)), F.lit(1 - EDGE)).alias("q")))).alias("q"))
        parts = weight.join(place, [*model, "c"]).groupBy(*model).agg(F.array_sort(F.collect_list(F.struct("c", "w", F.col("q.q").alias("q")))).alias("parts"))
        new = parts.join(likelihood, model).join(now.select(*model, "log_likelihood"), model)
        new = written(new.select(*model, F.transform("parts", lambda p: p["w"] / F.col("__n")).alias("weights"), F.col("parts.q").alias("chances"), F.col("rose").alias("log_likelihood"), F.col("log_likelihood").alias("before"), "__n"))
        now = new.select(*model, "weights", "chances", "log_likelihood")
        if new.filter(F.col("log_likelihood") - F.col("before") > settled * F.abs("log_likelihood")).isEmpty():
            break
    size = rows.groupBy(*keys).agg(F.max(F.size("pattern")).alias("__places"), F.sum("n").alias("__n"))
    k = F.size("weights")
    bic = mixture_bic(F.col("log_likelihood"), k, F.col("__places"), F.col("__n"))
    return now.join(size, keys).select(*model, "weights", "chances", "log_likelihood", bic.alias("bic"))


def chosen(models: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the model of least bic, then of fewest components, then of the first restart."""
    best = F.min_by(F.struct("k", "turn", "weights", "chances", "log_likelihood", "bic"), F.struct(F.round("bic", 6), "k", "turn"))
    return models.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")
