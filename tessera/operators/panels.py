"""Panels of haplotypes: canonical forms, near-equality, duplicates, similarity, usage from block to block, beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed(alleles: DataFrame, keys: list[str], hap: str, site: str, allele: str) -> DataFrame:
    """(keys, hap, row): a haplotype's alleles in the order of its sites, as text: equal texts are equal haplotypes, and texts sort as rows do."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(site).alias("s"), F.col(allele).cast("string").alias("x"))))
    return alleles.groupBy(*keys, hap).agg(F.array_join(F.transform(cells, lambda c: c["x"]), "").alias("row"))


def canonical(rows: DataFrame, keys: list[str], hap: str) -> DataFrame:
    """(keys, hap, row, canonical): equal rows are one, numbered from 0 in the order of the rows."""
    return rows.withColumn("canonical", F.dense_rank().over(Window.partitionBy(*keys).orderBy("row")) - 1)


def canonical_pairs(pairs: DataFrame, numbers: DataFrame, keys: list[str], first: str, second: str, hap: str) -> DataFrame:
    """Pairs of haplotypes by their canonical numbers, the smaller first."""
    one = numbers.select(*keys, F.col(hap).alias(first), F.col("canonical").alias("__a"))
    two = numbers.select(*keys, F.col(hap).alias(second), F.col("canonical").alias("__b"))
    met = pairs.join(one, [*keys, first]).join(two, [*keys, second])
    return met.withColumns({first: F.least("__a", "__b"), second: F.greatest("__a", "__b")}).drop("__a", "__b")


def sharpest(rows: pd.DataFrame, near: float) -> list[int]:
    """Greedy: in order, a row within `near` percent of a kept one is its duplicate, and takes its slot if it is sharper. Returns the kept places, a slot each."""
    kept: list[int] = []
    bits = [np.frombuffer(x.encode(), np.uint8) for x in rows["row"]]
    sharp = rows["sharpness"].to_numpy()
    for i, x in enumerate(bits):
        slot = next((k for k, j in enumerate(kept) if 100 * np.mean(bits[j] != x) < near), None)
        if slot is None:
            kept.append(i)
        elif sharp[i] > sharp[kept[slot]]:
            kept[slot] = i
    return kept


def without_duplicates(rows: DataFrame, keys: dict[str, str], hap: str, near: float = 1.0) -> DataFrame:
    """(keys, slot, hap): a panel's haplotypes without near duplicates. rows: keys, hap, row, sharpness. A panel is some tens of rows, and one task's group."""
    kind = rows.schema[hap].dataType.simpleString()

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(hap, kind="stable")
        kept = sharpest(group, near)
        return pd.DataFrame({n: [v] * len(kept) for n, v in zip(keys, key, strict=True)} | {"slot": range(len(kept)), hap: group[hap].to_numpy()[kept]})

    return rows.select(*keys, hap, "row", "sharpness").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {t}" for k, t in keys.items()), "slot long", f"{hap} {kind}"]))


def similarity(chances: DataFrame, keys: list[str], hap: str, site: str, p: str) -> DataFrame:
    """(keys, a, b, similarity): the mean chance that two haplotypes have the same allele, over the root of the product of their own."""
    x = chances.select(*keys, site, F.col(hap).alias("a"), F.col(p).alias("__x"))
    y = chances.select(*keys, site, F.col(hap).alias("b"), F.col(p).alias("__y"))
    same = F.col("__x") * F.col("__y") + (1 - F.col("__x")) * (1 - F.col("__y"))
    mean = x.join(y, [*keys, site]).groupBy(*keys, "a", "b").agg(F.avg(same).alias("__s"))
    own = mean.filter("a = b").select(*keys, "a", F.col("__s").alias("__a"))
    met = mean.join(own, [*keys, "a"]).join(own.withColumnsRenamed({"a": "b", "__a": "__b"}), [*keys, "b"])
    return met.select(*keys, "a", "b", (F.col("__s") / F.sqrt(F.col("__a") * F.col("__b"))).alias("similarity"))


def successors(pairs: DataFrame, sample: str, block: str, haps: list[str]) -> DataFrame:
    """(block, a, b, samples): how many samples have haplotype a in a block and b in the next; a sample counts once."""
    each = pairs.select(sample, block, F.explode(F.array_distinct(F.array(*haps))).alias("hap"))
    one = each.withColumnRenamed("hap", "a")
    two = each.select(sample, (F.col(block) - 1).alias(block), F.col("hap").alias("b"))
    return one.join(two, [sample, block]).groupBy(block, "a", "b").agg(F.count(F.lit(1)).alias("samples"))


def usage_score(counts: DataFrame, block: str) -> DataFrame:
    """(block, a, b, forward, backward): 100 * min(1, 2 * share)^2 of the samples of a that go on to b, and of b that come from a; 0 where none do."""
    cells = counts.select(block, "a").distinct().join(counts.select(block, "b").distinct(), block).join(counts, [block, "a", "b"], "left")
    n = F.coalesce(F.col("samples"), F.lit(0))
    share = lambda side: n / F.sum(n).over(Window.partitionBy(block, side))
    score = lambda x: 100 * F.pow(F.least(F.lit(1.0), 2 * x), F.lit(2.0))
    return cells.select(block, "a", "b", score(share("a")).alias("forward"), score(share("b")).alias("backward"))


def overlap_score(alleles: DataFrame, block: str, hap: str, site: str, allele: str) -> DataFrame:
    """(block, a, b, score): the share of equal alleles of a block's and the next one's haplotypes over the sites of both; 1 for every pair where they share none."""
    one = alleles.select(block, site, F.col(hap).alias("a"), F.col(allele).alias("__x"))
    two = alleles.select((F.col(block) - 1).alias(block), site, F.col(hap).alias("b"), F.col(allele).alias("__y"))
    met = one.join(two, [block, site]).groupBy(block, "a", "b").agg(F.avg((F.col("__x") == F.col("__y")).cast("double")).alias("score"))
    every = one.select(block, "a").distinct().join(two.select(block, "b").distinct(), block)
    return every.join(met, [block, "a", "b"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))


def intra_block_switches(scores: DataFrame, keys: list[str], first: str, last: str, h1: str, h2: str) -> DataFrame:
    """(keys, at_start, at_end, switched): the best pair at a block's start and at its end, and whether they differ, in whatever order. Of equal ones the first pair."""
    pair = F.struct(F.array_sort(F.array(h1, h2)).alias("p"))
    best = lambda c: F.min_by(pair, F.struct(-F.col(c), F.col(h1), F.col(h2)))["p"]
    return scores.groupBy(*keys).agg(best(first).alias("at_start"), best(last).alias("at_end")).withColumn("switched", F.col("at_start") != F.col("at_end"))


def supported_share(votes: DataFrame, keys: list[str], agrees: Column, least: int) -> DataFrame:
    """(keys, votes, confidence): the share of votes that agree; null where fewer than `least` vote."""
    return votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"), F.when(F.count(F.lit(1)) >= least, F.avg(agrees.cast("double"))).alias("confidence"))


def effective_support(records: DataFrame, keys: list[str], sample: str, weight: str) -> DataFrame:
    """(keys, support): a sample's greatest weight, summed over samples: one vote each."""
    return records.groupBy(*keys, sample).agg(F.max(weight).alias("__w")).groupBy(*keys).agg(F.sum("__w").alias("support"))


def set_overlap(pairs: DataFrame, keys: list[str], set_: str, member: str) -> DataFrame:
    """(keys, a, b, overlap): the members that two sets share, over the smaller one's; pairs that share none are left out."""
    rows = pairs.select(*keys, F.col(set_).alias("__s"), F.col(member).alias("__m")).distinct()
    size = rows.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__n"))
    one, two = rows.withColumnRenamed("__s", "a"), rows.withColumnRenamed("__s", "b")
    both = one.join(two, [*keys, "__m"]).filter("a < b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("__both"))
    met = both.join(size.withColumnsRenamed({"__s": "a", "__n": "__x"}), [*keys, "a"]).join(size.withColumnsRenamed({"__s": "b", "__n": "__y"}), [*keys, "b"])
    return met.select(*keys, "a", "b", (F.col("__both") / F.least("__x", "__y")).alias("overlap"))


def strided(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every s-th row of each key from the first, s = ceil(n / most)."""
    w = Window.partitionBy(*keys)
    stride, place = F.ceil(F.count(F.lit(1)).over(w) / most), F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumns({"__s": stride, "__i": place}).filter("__i % __s = 0").drop("__s", "__i")


def pair_chances(founders: DataFrame, keys: list[str], site: str, p: str) -> DataFrame:
    """(keys, site, h1, h2, p0, p1, p2), h1 <= h2: the chances of the genotypes of each unordered pair of founders with alternative chance p."""
    x = founders.select(*keys, site, F.col("hap").alias("h1"), F.col(p).alias("__x"))
    y = founders.select(*keys, site, F.col("hap").alias("h2"), F.col(p).alias("__y"))
    a, b = F.col("__x"), F.col("__y")
    return x.join(y, [*keys, site]).filter("h1 <= h2").select(*keys, site, "h1", "h2", ((1 - a) * (1 - b)).alias("p0"), (a * (1 - b) + b * (1 - a)).alias("p1"), (a * b).alias("p2"))


def diverse_beam(candidates: DataFrame, keys: dict[str, str], id: str, score: str, vector: str, width: int, weight: float) -> DataFrame:
    """(keys, id, place): a beam by maximal marginal relevance: time and again the candidate with the greatest weight * score + (1 - weight) * novelty,
    scores scaled to [0, 1], novelty the least share of places that differ from a chosen one; ties to the first id. Groups no wider than the beam stay whole.

    A beam's candidates are one step's of one search: some hundreds, one task's group."""
    kind = candidates.schema[id].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id, kind="stable")
        x, s = np.stack([np.asarray(v) for v in rows[vector]]), rows[score].to_numpy(float)
        if len(rows) <= width:
            order = np.arange(len(rows))
        else:
            spread = s.max() - s.min()
            scaled = (s - s.min()) / spread if spread > 0 else np.zeros(len(s))
            novelty, order, left = np.ones(len(s)), [], np.ones(len(s), bool)
            for _ in range(width):
                each = np.where(left, weight * scaled + (1 - weight) * novelty, -np.inf)
                i = int(each.round(12).argmax())
                order.append(i)
                left[i] = False
                novelty = np.minimum(novelty, (x != x[i]).mean(axis=1))
            order = np.array(order)
        return pd.DataFrame({n: [v] * len(order) for n, v in zip(keys, key, strict=True)} | {id: rows[id].to_numpy()[order], "place": np.arange(len(order))})

    return candidates.select(*keys, id, score, vector).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {t}" for k, t in keys.items()), f"{id} {kind}", "place long"]))
