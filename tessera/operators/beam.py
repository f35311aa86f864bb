"""Beam search for paths through layers of haplotypes, forward and then back over the paths that were found.

A mesh has a score for each step from a haplotype of an earlier layer to one of a later: (keys, past, layer, h_from, h_to, score). A path's step into a
layer is the mean over the earlier layers of the scores from its haplotypes there. The frontier is a table of paths; a step joins it with the
mesh, and of the longer paths each key keeps a beam, by score and by novelty (panels.diverse_beam). The way back takes a path as a
scaffold: one layer after the other, from the last, each of its haplotypes is tried, and only the steps that it touches are scored anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panels import diverse_beam


def _named(path: Column) -> Column:
    """A name that sorts as the path does."""
    return F.array_join(F.transform(path, lambda h: F.lpad(h.cast("string"), 6, "0")), "-")


def _kept(candidates: DataFrame, keys: dict[str, str], width: int, weight: float) -> DataFrame:
    """A beam of each key's candidates (keys, path, steps)."""
    total = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x)
    named = candidates.withColumns({"__id": _named(F.col("path")), "__score": F.round(total, 9)})
    chosen = diverse_beam(named.select(*keys, "__id", "__score", F.col("path").cast("array<double>").alias("__vector")), keys, "__id", "__score", "__vector", width, weight)
    return named.join(chosen.select(*keys, "__id"), [*keys, "__id"]).select(*keys, "path", "steps")


def _scored(rows: DataFrame, mesh: DataFrame, keys: dict[str, str], gap: int | None) -> DataFrame:
    """(keys, path, at, h_to, step): the steps of paths into the layer `at`: into h_to there, or into any haplotype where that is null."""
    first = F.greatest(F.lit(0), F.col("at") - gap) if gap is not None else F.lit(0)
    each = rows.filter("at > 0").withColumn("past", F.explode(F.sequence(first, F.col("at") - 1)))
    each = each.select(*keys, "path", "at", F.col("h_to").alias("__to"), "past", F.get("path", F.col("past")).cast("long").alias("h_from"))
    edges = mesh.select(*keys, F.col("past").cast("int").alias("past"), F.col("layer").cast("int").alias("at"), F.col("h_from").cast("long").alias("h_from"), F.col("h_to").cast("long").alias("h_to"), "score")
    met = each.join(edges, [*keys, "past", "at", "h_from"]).filter("__to is null or __to = h_to")
    return met.groupBy(*keys, "path", "at", "h_to").agg(F.avg("score").alias("step"))


def search(mesh: DataFrame, nodes: DataFrame, keys: dict[str, str], width: int, weight: float, written: Callable[[DataFrame], DataFrame], gap: int | None = None) -> DataFrame:
    """(keys, rank, path, score): the beam of each key after both passes, by score. nodes: (keys, layer, h), layers 0, 1, ... of each key; a key of fewer layers has shorter paths.

    `gap` bounds how many layers back a step looks. Where a beam holds all paths, the best of all is the first. `weight` is that of the score against novelty. A step without
    any score from before is impossible. A table of some hundred paths a key is written after each layer."""
    nodes = written(nodes.select(*keys, F.col("layer").cast("int").alias("layer"), F.col("h").cast("long").alias("h")).distinct())
    last = nodes.agg(F.max("layer")).first()[0]
    frontier = nodes.filter("layer = 0").select(*keys, F.array("h").alias("path"), F.array(F.lit(0.0)).alias("steps"))
    for t in range(1, (last or 0) + 1):
        steps = _scored(frontier.select(*keys, "path", F.lit(t).alias("at"), F.lit(None).cast("long").alias("h_to")), mesh, keys, gap)
        longer = frontier.join(steps, [*keys, "path"]).select(*keys, F.concat("path", F.array("h_to")).alias("path"), F.concat("steps", F.array("step")).alias("steps"))
        ended = frontier.join(nodes.filter(F.col("layer") == t).select(*keys).distinct(), [*keys], "left_anti")
        frontier = written(_kept(longer, keys, width, weight).unionByName(ended))
    for t in range(last or 0, -1, -1):
        tried = frontier.join(nodes.filter(F.col("layer") == t).select(*keys, "h"), [*keys])
        new = F.transform("path", lambda x, i: F.when(i == t, F.col("h")).otherwise(x))
        same = F.get("path", F.lit(t)) == F.col("h")
        variants = tried.filter(~same).select(*keys, new.alias("path"), "steps").dropDuplicates([*keys, "path"])
        until = F.least(F.size("path") - 1, F.lit(t + gap)) if gap is not None else F.size("path") - 1
        touched = variants.withColumn("at", F.explode(F.sequence(F.lit(t), F.greatest(until, F.lit(t))))).withColumn("h_to", F.get("path", F.col("at")))
        steps = _scored(touched, mesh, keys, gap).groupBy(*keys, "path").agg(F.map_from_entries(F.collect_list(F.struct("at", "step"))).alias("__new"), F.count(F.lit(1)).alias("__n"))
        met = variants.join(steps, [*keys, "path"], "left")
        fresh = F.transform("steps", lambda x, i: F.coalesce(F.element_at("__new", i), x))
        complete = F.coalesce(F.col("__n"), F.lit(0)) == F.greatest(until, F.lit(t)) - t + (0 if t == 0 else 1)  # a step of no score is impossible
        changed = met.filter(complete).select(*keys, "path", F.when(F.col("__new").isNull(), F.col("steps")).otherwise(fresh).alias("steps"))
        short = frontier.join(nodes.filter(F.col("layer") == t).select(*keys).distinct(), [*keys], "left_anti")
        whole = frontier.join(short.select(*keys).distinct(), [*keys], "left_anti")
        every = whole.unionByName(changed.join(whole.select(*keys, "path"), [*keys, "path"], "left_anti"))
        frontier = written(_kept(every, keys, width, weight).unionByName(short))
    score = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), _named(F.col("path")))
    return frontier.select(*keys, "path", score.alias("score")).withColumn("rank", F.row_number().over(w).cast("long")).select(*keys, "rank", "path", "score")
