"""Bootstraps over an index table, so that every engine resamples the same rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def multiplicities(units: int, replicates: int, seed: int) -> tuple[tuple[int, int, int], ...]:
    """(replicate, unit, times drawn), for `units` draws with replacement from as many; units drawn at least once."""
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, units, (replicates, units))
    return tuple((r, int(u), int(n)) for r, row in enumerate(drawn) for u, n in zip(*np.unique(row, return_counts=True), strict=True))


def index_table(spark: SparkSession, units: int, replicates: int, seed: int) -> DataFrame:
    """At most units * replicates rows, which the caller chooses: small beside what is resampled."""
    return spark.createDataFrame(multiplicities(units, replicates, seed), "replicate int, unit int, times int")


def rate_interval(components: DataFrame, unit: str, count: str, exposure: str, index: DataFrame, level: float = 0.95) -> DataFrame:
    """The rate sum(count) / sum(exposure), and percentile bounds of it over the replicates."""
    drawn = F.broadcast(index).join(components.withColumnRenamed(unit, "unit"), "unit")
    rates = drawn.groupBy("replicate").agg((F.sum(F.col(count) * F.col("times")) / F.sum(F.col(exposure) * F.col("times"))).alias("rate"))
    tail = (1 - level) / 2
    bounds = rates.agg(F.percentile("rate", F.array(F.lit(tail), F.lit(1 - tail))).alias("b"))
    whole = components.agg((F.sum(count) / F.sum(exposure)).alias("rate"))
    return whole.crossJoin(F.broadcast(bounds)).select("rate", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def winners(utilities: DataFrame, group: list[str], choice: str, unit: str, utility: str, index: DataFrame) -> DataFrame:
    """How often each choice has the highest mean utility over the replicates; ties go to the least choice."""
    drawn = F.broadcast(index).join(utilities.withColumnRenamed(unit, "unit"), "unit")
    mean = drawn.groupBy("replicate", *group, choice).agg((F.sum(F.col(utility) * F.col("times")) / F.sum("times")).alias("mean"))
    first = Window.partitionBy("replicate", *group).orderBy(F.desc("mean"), choice)
    return mean.withColumn("__row", F.row_number().over(first)).filter("__row = 1").groupBy(*group, choice).agg(F.count(F.lit(1)).alias("wins"))
