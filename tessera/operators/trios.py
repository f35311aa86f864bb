"""Whether a child's painting follows from its parents', at sampled places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .founders import explained
from .joins import containing


def support(paintings: DataFrame, pedigree: DataFrame, step: int, width: int | None = None) -> DataFrame:
    """(child, sampled, explained): places every `step` from a child's first to its last on each contig, and the share of them at which its founders come one from each parent.

    paintings: (sample, contig, start, end, h1, h2), half open; pedigree: (child, p1, p2). Places that a painting of the three
    doesn't cover, or where a founder is missing, don't count. Contigs count by their mean."""
    width = width or 16 * step
    chunks = paintings.select("sample", "contig", "start", "end", "h1", "h2")
    span = chunks.groupBy("sample", "contig").agg(F.min("start").alias("__a"), F.max("end").alias("__b")).filter("__a < __b")
    places = pedigree.filter("p1 is not null and p2 is not null").join(span.withColumnRenamed("sample", "child"), "child")
    met = places.select("child", "p1", "p2", "contig", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1, F.lit(step).cast("long"))).alias("__at"))
    for who, names in (("child", ("c1", "c2")), ("p1", ("x1", "x2")), ("p2", ("y1", "y2"))):
        own = chunks.select(F.col("sample").alias(who), "contig", "start", "end", F.col("h1").alias(names[0]), F.col("h2").alias(names[1]))
        met = containing(met, own, [who, "contig"], "__at", "start", "end", width).drop("start", "end")
    c = F.col
    found = met.withColumn("__yes", explained([c("c1"), c("c2")], [c("x1"), c("x2")], [c("y1"), c("y2")])).filter("__yes is not null")
    each = found.groupBy("child", "contig").agg(F.count(F.lit(1)).alias("__n"), F.avg(c("__yes").cast("double")).alias("__share"))
    return each.groupBy("child").agg(F.sum("__n").alias("sampled"), F.avg("__share").alias("explained"))
