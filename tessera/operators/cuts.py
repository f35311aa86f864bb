"""Maximum cuts of graphs of pairs, and the haplotypes that a cut leaves open: sites whose alleles may be exchanged between its sides.

Small graphs (panels of a block) are one row each, and every cut of one is scored within its row; larger ones stay edges, and their nodes change
sides in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of a graph whose 2^(nodes - 1) cuts are all scored.
EXACT = 14


def pair_weights(pairs: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """(keys, a, b, weight): how many rows have each two different members, a < b. Nulls count for nothing."""
    return pairs.filter(F.col(first) != F.col(second)).groupBy(*keys, F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def _summed(edges: DataFrame, keys: list[str]) -> DataFrame:
    real = edges.filter((F.col("a") != F.col("b")) & F.col("weight").isNotNull())
    return real.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def maximum_cuts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, across, within): every cut of the greatest weight across, as the sorted nodes that aren't on the first node's side.

    edges: (keys, a, b, weight), weights integers of either sign. A cut and its complement are one, as the least node stays. Graphs of more than EXACT nodes
    raise an error: improved_cut() is for them. Exact for any weights; ties are all returned."""
    summed = _summed(edges, keys)
    rows = summed.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("nodes"), F.collect_list(F.struct("a", "b", "weight")).alias("edges"), F.sum("weight").alias("total"))
    rows = rows.withColumn("nodes", F.when(F.size("nodes") <= EXACT, F.col("nodes")).otherwise(F.raise_error(F.lit(f"a graph of more than {EXACT} nodes"))))
    mask = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position("nodes", x) - 1).cast("int"))
    rows = rows.withColumn("edges", F.transform("edges", lambda e: F.struct(mask(e["a"]).alias("p"), mask(e["b"]).alias("q"), e["weight"].alias("weight"))))
    apart = lambda s, e: (s.bitwiseAND(e["p"]) == 0) != (s.bitwiseAND(e["q"]) == 0)
    across = lambda s: F.aggregate("edges", F.lit(0).cast("bigint"), lambda t, e: t + F.when(apart(s, e), e["weight"]).otherwise(0))
    # The least node is the lowest bit and stays 0.
    cuts = F.transform(F.sequence(F.lit(1).cast("bigint"), F.expr("shiftleft(1L, size(nodes) - 1)") - 1), lambda h: F.struct(across(h * 2).alias("across"), (h * 2).alias("s")))
    rows = rows.withColumn("cuts", cuts).withColumn("top", F.array_max("cuts.across"))
    best = rows.select(*keys, "nodes", "total", F.explode(F.filter("cuts", lambda c: c["across"] == F.col("top"))).alias("c"))
    far = F.filter("nodes", lambda x: F.col("c.s").bitwiseAND(mask(x)) != 0)
    return best.select(*keys, far.alias("side"), F.col("c.across").alias("across"), (F.col("total") - F.col("c.across")).alias("within"))


def improved_cut(edges: DataFrame, keys: list[str], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, node, side): a cut of a graph of any size that no single node's change betters; at least half the weight, where weights aren't negative, lies across.

    Begins with sides by a hash. In a round every node that gains by a change, and gains more than its gaining neighbours (of equal gains the least node), changes: no two
    neighbours do at once, so their gains hold and the weight rises until the rounds end."""
    one = _summed(edges, keys)
    both = written(one.unionByName(one.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    state = written(both.select(*keys, F.col("a").alias("node")).distinct().withColumn("side", F.pmod(F.xxhash64("node"), F.lit(2)).cast("int")))
    near = lambda s, x, y: s.select(*keys, F.col("node").alias(x), F.col("side").alias(y))
    while True:
        met = both.join(near(state, "a", "sa"), [*keys, "a"]).join(near(state, "b", "sb"), [*keys, "b"])
        gain = met.groupBy(*keys, F.col("a").alias("node")).agg(F.sum(F.when(F.col("sa") == F.col("sb"), F.col("weight")).otherwise(-F.col("weight"))).alias("gain"))
        gaining = written(gain.filter("gain > 0"))
        if gaining.isEmpty():
            return state
        named = lambda x, y: gaining.select(*keys, F.col("node").alias(x), F.col("gain").alias(y))  # noqa: E731, B023
        beaten = both.join(named("a", "ga"), [*keys, "a"]).join(named("b", "gb"), [*keys, "b"]).filter("gb > ga or (gb = ga and b < a)")
        turn = gaining.join(beaten.select(*keys, F.col("a").alias("node")).distinct(), [*keys, "node"], "left_anti").select(*keys, "node", F.lit(1).alias("__turn"))
        state = written(state.join(turn, [*keys, "node"], "left").select(*keys, "node", F.when(F.col("__turn") == 1, 1 - F.col("side")).otherwise(F.col("side")).alias("side")))


def open_sites(haplotypes: DataFrame, cuts: DataFrame, keys: list[str], hap: str, site: str, allele: str) -> DataFrame:
    """(keys, side, site, own): sites at which each side of a cut has one allele, and the two differ; own is that of the near side.

    To exchange both leaves the dosage of every pair across the cut as it is. haplotypes: one row a (key, hap, site)."""
    met = haplotypes.join(cuts.select(*keys, "side").distinct(), keys).withColumn("__far", F.array_contains("side", F.col(hap)))
    two = lambda far: (F.min(F.when(F.col("__far") == far, F.col(allele))), F.max(F.when(F.col("__far") == far, F.col(allele))))
    low, high = two(False), two(True)
    seen = met.groupBy(*keys, "side", site).agg(low[0].alias("n0"), low[1].alias("n1"), high[0].alias("f0"), high[1].alias("f1"))
    return seen.filter("n0 = n1 and f0 = f1 and n0 <> f0").select(*keys, "side", site, F.col("n0").alias("own"))


def turned_sites(open: DataFrame, haplotypes: DataFrame, pairs: DataFrame, probabilities: DataFrame, keys: list[str], sample: str, site: str, floor: float = 1e-12, margin: float = 1e-9) -> DataFrame:
    """The open sites with the losses, before and after an exchange, of the samples whose pair lies on one side, and whether they call for it: (..., before, after, turned).

    pairs: (keys, sample, a, b); probabilities: (keys, sample, site, p0, p1, p2); haplotypes: (keys, hap, site, allele). A site no such sample tells about has no loss and stays."""
    inside = open.join(pairs, keys).filter(F.array_contains("side", F.col("a")) == F.array_contains("side", F.col("b")))
    of = lambda x: haplotypes.select(*keys, site, F.col("hap").alias(x), F.col("allele").alias(f"x{x}"))
    met = inside.join(of("a"), [*keys, site, "a"]).join(of("b"), [*keys, site, "b"]).join(probabilities, [*keys, sample, site])
    log = lambda g: -F.ln(F.greatest(_of(g), F.lit(floor)))
    g = F.col("xa") + F.col("xb")
    loss = met.groupBy(*keys, "side", site).agg(F.sum(log(g)).alias("before"), F.sum(log(2 - g)).alias("after"))
    found = open.join(loss, [*keys, "side", site], "left").fillna(0.0, ["before", "after"])
    return found.withColumn("turned", F.col("after") < F.col("before") - margin)


def _of(g: Column) -> Column:
    return F.when(g == 0, F.col("p0")).when(g == 1, F.col("p1")).otherwise(F.col("p2"))
