"""Painting of samples with pairs of founders: emissions by bins of sites, best paths, and what follows from their switches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths


def equal_bins(sites: DataFrame, keys: list[str], site: str, per_bin: int) -> DataFrame:
    """(keys, site, bin): bins of about `per_bin` consecutive sites, the first ones greater by one where they don't come out even.

    Sites are a table of one genome's places, not of samples: a window of a contig's places is small."""
    w = Window.partitionBy(*keys)
    n, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(site)) - 1
    bins = F.greatest(F.lit(1), F.floor(n / per_bin))
    size, over = F.floor(n / bins), n % bins
    bin_ = F.when(place < over * (size + 1), F.floor(place / (size + 1))).otherwise(over + F.floor((place - over * (size + 1)) / size))
    return sites.select(*keys, site).distinct().withColumn("bin", bin_.cast("long"))


def log_emission(p: Column, epsilon: float = 0.01) -> Column:
    """ln of a genotype's chance mixed with an even one, between -50 and 0."""
    return F.greatest(F.ln(F.greatest(p * (1 - epsilon) + epsilon / 3, F.lit(1e-300))), F.lit(-50.0))


def pair_genotypes(founders: DataFrame, keys: list[str], site: str) -> DataFrame:
    """(keys, site, h1, h2, g): the genotype of every ordered pair of founders."""
    one = founders.select(*keys, site, F.col("hap").alias("h1"), F.col("allele").alias("__a"))
    two = founders.select(*keys, site, F.col("hap").alias("h2"), F.col("allele").alias("__b"))
    return one.join(two, [*keys, site]).select(*keys, site, "h1", "h2", (F.col("__a") + F.col("__b")).alias("g"))


def binned_emissions(probabilities: DataFrame, founders: DataFrame, keys: list[str], sample: str, site: str, per_bin: int, epsilon: float = 0.01) -> DataFrame:
    """(sample, bin, h1, h2, log_emission): log emissions summed over the sites of a bin.

    probabilities: (keys, sample, site, p0, p1, p2); founders: (keys, hap, site, allele). Sums are partial before they are shuffled."""
    bins = equal_bins(founders, keys, site, per_bin)
    states = pair_genotypes(founders, keys, site).join(bins, [*keys, site])
    p = F.when(F.col("g") == 0, F.col("p0")).when(F.col("g") == 1, F.col("p1")).otherwise(F.col("p2"))
    met = probabilities.join(states, [*keys, site])
    return met.groupBy(*keys, sample, "bin", "h1", "h2").agg(F.sum(log_emission(p, epsilon)).alias("log_emission"))


def painted(emissions: DataFrame, keys: dict[str, str], bin_: str, centre: str, founders: int, rate: float, damping: float) -> DataFrame:
    """Segments of the best path of pairs: keys, seg, h1, h2, start and end (bins), n, score. Pairs that differ in order alone make one segment, named as its last bin is.

    emissions: keys, bin, centre, h1, h2 (below `founders`), log_emission; a pair that is missing has no chance."""
    state = F.col("h1") * founders + F.col("h2")
    table = F.map_from_entries(F.collect_list(F.struct(state.cast("int").alias("s"), "log_emission")))
    rows = emissions.groupBy(*keys, bin_).agg(F.first(centre).alias("__centre"), table.alias("__m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(founders**2 - 1)), lambda s: F.coalesce(F.element_at("__m", s), F.lit(-1e9)))
    rows = rows.select(*keys, bin_, array.alias("e"), (F.col("__centre") - F.lag("__centre").over(Window.partitionBy(*keys).orderBy(bin_))).alias("gap"))
    runs = paths.best_paths(rows, keys, bin_, paths.diploid(founders, "e", "gap", rate, damping))
    h1, h2 = F.floor(F.col("state") / founders), F.col("state") % founders
    pair = runs.withColumns({"h1": h1, "h2": h2, "__pair": F.array_sort(F.array(h1, h2))})
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.lag("__pair").over(w) == F.col("__pair"), 0).otherwise(1)
    marked = pair.withColumn("__new", new).withColumn("seg", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct("h1", "h2"), "start")
    out = marked.groupBy(*keys, "seg").agg(last.alias("__h"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.first("score").alias("score"))
    return out.select(*keys, "seg", "__h.h1", "__h.h2", "start", "end", "n", "score")


def crossovers(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parent, midpoint, before, after) of a trio's best path: changes of each parent's strand from one normal run to the next, bursts passed over.

    The midpoint is between the last row before, and the first row after, whatever burst lies between."""
    w = Window.partitionBy(*keys).orderBy("start")
    normal = runs.filter("state < 8").withColumns({"__end": F.lag("end").over(w), "__state": F.lag("state").over(w)}).filter("__state is not null")
    strand = lambda c, shift: F.shiftright(F.col(c), shift).bitwiseAND(F.lit(1).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("parent"), strand("__state", 1 - k).alias("before"), strand("state", 1 - k).alias("after")) for k in (0, 1)]))
    found = normal.select(*keys, ((F.col("__end") + F.col("start")) / 2).alias("midpoint"), each.alias("c"))
    return found.select(*keys, "c.parent", "midpoint", "c.before", "c.after").filter("before <> after")


def switch_costs(theta: Column, damping: float, founders: int, both: float = 1.5) -> dict[int, Column]:
    """The cost of 0, 1 and 2 switches, as expressions."""
    switch, stay, spread = F.ln(theta) - damping, F.ln(1 - theta), math.log(max(1, founders - 1))
    return {0: 2 * stay, 1: switch + stay - spread, 2: both * switch - 2 * spread}
