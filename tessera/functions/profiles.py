"""Recombination profiles: rates over fractions of a contig, checked and summed by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def faults(profile: DataFrame, contig: str, start: str, end: str, tolerance: float = 1e-12) -> DataFrame:
    """Segments that break a profile's rules: each begins where the one before ends, the first at 0; the last ends at 1; none is empty."""
    w = Window.partitionBy(contig).orderBy(start)
    before = F.coalesce(F.lag(end).over(w), F.lit(0.0))
    last = F.lead(start).over(w).isNull()
    wrong = (F.abs(F.col(start) - before) > tolerance) | (F.col(end) <= F.col(start)) | (last & (F.abs(F.col(end) - 1) > tolerance))
    return profile.withColumn("__wrong", wrong).filter("__wrong").drop("__wrong")


def resolved(profile: DataFrame, contig: str, start: str, end: str, multiplier: str, rate: float) -> DataFrame:
    """Adds `rate`: the multipliers scaled so that their mean over the contig, weighted by length, gives `rate`."""
    width = F.col(end) - F.col(start)
    mean = F.sum(width * F.col(multiplier)).over(Window.partitionBy(contig)) / F.sum(width).over(Window.partitionBy(contig))
    return profile.withColumn("rate", rate * F.col(multiplier) / mean)


def expected(profile: DataFrame, windows: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """The mean rate over each window of a contig, weighted by overlap; windows: contig, low, high."""
    met = profile.join(windows, contig).filter((F.col(start) < F.col("high")) & (F.col(end) > F.col("low")))
    overlap = F.least(F.col(end), F.col("high")) - F.greatest(F.col(start), F.col("low"))
    return met.groupBy(contig, "low", "high").agg((F.sum(overlap * F.col("rate")) / F.sum(overlap)).alias("rate"))
