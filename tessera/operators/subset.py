"""Choice of a block's haplotypes from a fixed pool, over losses that are worked out once.

The losses of a pack of samples under every pair of the pool (and with a wildcard) are one row of a written table. A round reads them, and sends on, for each
move of a block's choice, the sum of its samples' losses; a move adds, drops or exchanges haplotypes. All blocks move together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import discovery

#: Haplotypes of a pool whose subsets are all scored by enumerated().
SMALL = 12


def pool_losses(probabilities: DataFrame, pool: DataFrame, block: str, kind: str, sample: str, site: str, wildcard: float = discovery.WILDCARD) -> DataFrame:
    """(block, pack, sites, n, haps, losses): the losses of a pack's samples under every pair of the block's pool, doubles (sample, member, member), the last member the wildcard.

    probabilities: (block, sample, site, p0, p1, p2); pool: (block, hap, site, allele), one row each; a missing allele is 0. Blocks without a pool, or without samples, go."""
    cell = F.struct(F.col(site).cast("long").alias("s"), F.col("allele").cast("int").alias("x"))
    rows = pool.groupBy(block, "hap").agg(F.collect_list(cell).alias("cells")).groupBy(block).agg(F.array_sort(F.collect_list(F.struct(F.col("hap").cast("long").alias("hap"), "cells"))).alias("pool"))
    met = discovery.packs(probabilities, block, sample, site).join(rows, block)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                sites = np.asarray(r["sites"])
                haps = np.zeros((len(r["pool"]), len(sites)), np.int64)
                for k, h in enumerate(r["pool"]):
                    for c in h["cells"]:
                        at = np.searchsorted(sites, c["s"])
                        if at < len(sites) and sites[at] == c["s"] and c["x"] is not None:
                            haps[k, at] = c["x"]
                pack = discovery.Pack(np.frombuffer(r["logs"], np.float32).reshape(-1, len(sites), 3).astype(float), wildcard)
                i, j = discovery.pairs(len(haps))
                cube = np.empty((len(pack.wild), len(haps) + 1, len(haps) + 1))
                for at, loss in pack.losses(haps):
                    cube[at : at + len(loss), i, j] = cube[at : at + len(loss), j, i] = loss
                out.append({block: r[block], "pack": r["pack"], "sites": len(sites), "n": len(cube), "haps": [h["hap"] for h in r["pool"]], "losses": cube.tobytes()})
            yield pd.DataFrame(out, columns=[block, "pack", "sites", "n", "haps", "losses"])

    return met.mapInPandas(run, f"`{block}` {kind}, pack int, sites int, n long, haps array<long>, losses binary")


def moves(cube: np.ndarray, chosen: np.ndarray, wide: bool = False) -> Iterator[tuple[list[int], list[int], float]]:
    """(gone, added, loss of all samples) of every move from a choice. A sample's loss is that of its best pair of members, the wildcard always among them.

    A move takes away one at most and adds one at most; a wide one takes away two or adds two, or both."""
    wild = cube.shape[1] - 1
    own, rest = np.append(chosen, wild).astype(np.int64), np.setdiff1d(np.arange(wild), chosen)
    within, beside = cube[:, own][:, :, own], cube[:, rest][:, :, own]
    twice, between = np.einsum("nii->ni", cube)[:, rest], cube[:, rest][:, :, rest]
    for gone in [(), *combinations(range(len(chosen)), 1), *(combinations(range(len(chosen)), 2) if wide else ())]:
        left = np.setdiff1d(np.arange(len(own)), gone)
        now = within[:, left][:, :, left].min(axis=(1, 2))
        one = np.minimum(now[:, None], np.minimum(beside[:, :, left].min(axis=2), twice))  # with each new member
        names = [int(chosen[m]) for m in gone]
        if not wide or len(gone) == 2 or not gone:
            yield names, [], float(now.sum())
        if not wide or len(gone) == 2:
            yield from ((names, [int(c)], float(x)) for c, x in zip(rest, one.sum(axis=0), strict=True))
        if wide:
            for k in range(len(rest)):
                both = np.minimum(np.minimum(one[:, k, None], one[:, k + 1 :]), between[:, k, k + 1 :]).sum(axis=0)
                yield from ((names, [int(rest[k]), int(d)], float(x)) for d, x in zip(rest[k + 1 :], both, strict=True))


def _costs(held: DataFrame, block: str, scale: float) -> DataFrame:
    """(block, cost): of one haplotype, scale * sites / 200 * samples."""
    return held.groupBy(block).agg((scale * F.max("sites") / 200 * F.sum("n")).alias("cost"))


def chosen(held: DataFrame, block: str, kind: str, written: Callable[[DataFrame], DataFrame], scale: float = 0.5, settled: float = 1e-6) -> DataFrame:
    """(block, haps, loss, bic) of each block of pool_losses() (written): the choice that no move betters, by bic = haplotypes * cost + 2 * loss.

    A choice grows from nothing by its best addition as long as that lowers bic; then additions, drops and exchanges are taken, the best first (of equal ones that of fewest
    haplotypes, then of the first in the pool), and, when none of them lowers it, moves of two, which may be exchanged for two others: a sample needs two haplotypes, and the one may
    be worth nothing without the other. A better choice that lies further off than two for two isn't found: enumerated() finds it. When these don't help either a block is done, so it is never worse than additions alone. A choice may be empty."""
    costs = written(_costs(held, block, scale))
    state = held.groupBy(block).agg(F.first("haps").alias("pool")).select(block, "pool", F.array().cast("array<int>").alias("now"), F.lit("add").alias("phase"))
    done: list[DataFrame] = []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                k = len(r["pool"]) + 1
                out += [{block: r[block], "gone": g, "added": a, "loss": x} for g, a, x in moves(np.frombuffer(r["losses"]).reshape(-1, k, k), np.asarray(r["now"], np.int64), r["phase"] == "wide")]
            yield pd.DataFrame(out, columns=[block, "gone", "added", "loss"])

    while True:
        measured = held.select(block, "losses").join(state, block).select(block, "pool", "now", "phase", "losses").mapInPandas(run, f"`{block}` {kind}, gone array<int>, added array<int>, loss double")
        summed = measured.groupBy(block, "gone", "added").agg(F.sum("loss").alias("loss")).join(state, block).join(costs, block)
        summed = summed.withColumn("size", F.size("now") + F.size("added") - F.size("gone")).withColumn("bic", F.col("size") * F.col("cost") + 2 * F.col("loss"))
        stays = (F.size("gone") == 0) & (F.size("added") == 0)
        body = F.struct("gone", "added", "loss", "bic")
        open_ = F.when(~stays & ((F.col("phase") != "add") | (F.size("gone") == 0)), F.struct(F.round("bic", 6), "size", "gone", "added"))
        best = summed.groupBy(block).agg(F.min_by(body, open_).alias("best"), F.min_by(body, ~stays).alias("own"), *[F.first(c).alias(c) for c in ("pool", "now", "phase")])
        moved = F.coalesce(F.col("best.bic") < F.col("own.bic") - settled, F.lit(False))
        after = F.array_sort(F.concat(F.array_except("now", "best.gone"), "best.added"))
        phase = F.when(moved, F.when(F.col("phase") == "add", "add").otherwise("one")).when(F.col("phase") == "add", "one").when(F.col("phase") == "one", "wide").otherwise("done")
        step = written(best.select(block, "pool", F.when(moved, after).otherwise(F.col("now")).alias("now"), phase.alias("phase"), F.col("own.loss").alias("loss"), F.col("own.bic").alias("bic")))
        done.append(step.filter("phase = 'done'"))
        state = step.filter("phase <> 'done'").select(block, "pool", "now", "phase")
        if state.isEmpty():
            break
        if len(done) % 32 == 0:  # the plan of the result stays short
            done = [written(_union(done))]
    return _union(done).select(block, F.transform("now", lambda x: F.get("pool", x)).alias("haps"), "loss", "bic")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def subset_losses(cube: np.ndarray) -> np.ndarray:
    """The loss of all samples under each subset of a pool, by its bits: a pair of a subset lacks one of two of its members, or is these two."""
    wild = cube.shape[1] - 1
    best = np.empty((1 << wild, len(cube)))
    best[0] = cube[:, wild, wild]
    for s in range(1, 1 << wild):
        members = [k for k in range(wild) if s >> k & 1]
        i = members[0]
        if len(members) == 1:
            best[s] = np.minimum(best[0], np.minimum(cube[:, i, i], cube[:, i, wild]))
        else:
            j = members[1]
            best[s] = np.minimum(np.minimum(best[s & ~(1 << i)], best[s & ~(1 << j)]), cube[:, i, j])
    return best.sum(axis=1)


def enumerated(held: DataFrame, block: str, kind: str, scale: float = 0.5) -> DataFrame:
    """(block, haps, loss, bic): the best of all subsets of each pool; of equal ones that of fewest, then of the least bits. Pools of more than SMALL raise an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                k = len(r["haps"]) + 1
                if k - 1 > SMALL:
                    raise ValueError(f"a pool of more than {SMALL} haplotypes")
                loss = subset_losses(np.frombuffer(r["losses"]).reshape(-1, k, k))
                yield pd.DataFrame({block: r[block], "bits": np.arange(len(loss)), "loss": loss})

    total = held.mapInPandas(run, f"`{block}` {kind}, bits long, loss double").groupBy(block, "bits").agg(F.sum("loss").alias("loss")).join(_costs(held, block, scale), block)
    total = total.withColumn("bic", F.bit_count("bits") * F.col("cost") + 2 * F.col("loss"))
    best = total.groupBy(block).agg(F.min_by(F.struct("bits", "loss", "bic"), F.struct(F.round("bic", 6), F.bit_count("bits"), "bits")).alias("b"))
    pools = held.groupBy(block).agg(F.first("haps").alias("pool"))
    haps = F.filter("pool", lambda x, i: F.call_function("shiftright", F.col("b.bits"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return best.join(pools, block).select(block, haps.alias("haps"), "b.loss", "b.bic")
