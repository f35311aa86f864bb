"""Linking of blocks: how the haplotypes of a block go on in the next, learnt from samples whose pairs are not known.

A sample has an unordered pair of haplotypes in each block of a chain; each of the two goes on by the transition table of the
blocks, apart from the other. `paths` sums over all chains of pairs, in pieces; expected steps between pairs are summed
over samples inside the tasks, then split between the two ways in which the strands of a pair may go on. Tables are a row
an edge (keys, layer, h_from, h_to, p), where `layer` is the one that the edge leads to.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import transitions
from .paths import Model, _stacked, expected_moves, scores, unordered


def pairs_model(haplotypes: int) -> Model:
    """Unordered pairs of haplotypes below `haplotypes`; columns e (log emissions of the pairs) and t (log transitions, row by row; null where the chain begins)."""
    a, b = unordered(haplotypes)
    crossed = np.where(a == b, -np.inf, 0.0)

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        begins = rows["t"].isna().to_numpy()
        t = np.full((len(rows), haplotypes, haplotypes), -np.inf)
        if not begins.all():
            t[~begins] = _stacked(rows[~begins], "t", haplotypes, haplotypes)
        # a pair of equal haplotypes on the right is come to in one way
        straight = t[:, a[:, None], a[None, :]] + t[:, b[:, None], b[None, :]]
        across = t[:, a[:, None], b[None, :]] + t[:, b[:, None], a[None, :]] + crossed[None, None, :]
        move = np.logaddexp(straight, across)
        with np.errstate(divide="ignore"):
            move[begins] = np.log(np.eye(len(a)))
        return move + _stacked(rows, "e", len(a))[:, None, :]

    return Model(np.where(a == b, 0.0, np.log(2.0)) - 2 * np.log(haplotypes), ["e", "t"], matrices, likelihood=True)


def chains(emissions: DataFrame, keys: list[str], sample: str, layer: str, haplotypes: int) -> DataFrame:
    """(keys, sample, layer, e): the array of log emissions of unordered pairs; one that is missing is impossible. emissions: h1, h2, log_emission, of ordered pairs or not; of several rows of a pair the greatest."""
    a, b = unordered(haplotypes)
    number = F.array(*[F.lit(int(k)) for k in (a * haplotypes + b)])
    code = F.least("h1", "h2") * haplotypes + F.greatest("h1", "h2")
    one = emissions.groupBy(*keys, sample, layer, code.cast("int").alias("__pair")).agg(F.max("log_emission").alias("__e"))
    table = one.groupBy(*keys, sample, layer).agg(F.map_from_entries(F.collect_list(F.struct("__pair", "__e"))).alias("__m"))
    return table.select(*keys, sample, layer, F.transform(number, lambda k: F.coalesce(F.element_at("__m", k), F.lit(float("-inf")))).alias("e"))


def _with_transitions(rows: DataFrame, edges: DataFrame, keys: list[str], layer: str, haplotypes: int) -> DataFrame:
    """The rows with their layer's log transitions as an array; null for the first layer, which no edge leads to."""
    code = (F.col("h_from") * haplotypes + F.col("h_to")).cast("int")
    table = edges.groupBy(*keys, "layer").agg(F.map_from_entries(F.collect_list(F.struct(code.alias("c"), F.ln("p").alias("x")))).alias("__m"))
    cells = F.sequence(F.lit(0), F.lit(haplotypes**2 - 1))
    wide = table.select(*keys, F.col("layer").alias(layer), F.transform(cells, lambda k: F.coalesce(F.element_at("__m", k), F.lit(float("-inf")))).alias("t"))
    return rows.join(wide, [*keys, layer], "left")


def haploid_counts(moves: DataFrame, edges: DataFrame, keys: list[str], haplotypes: int) -> DataFrame:
    """(keys, layer, h_from, h_to, expected): expected steps between unordered pairs, split over the strands by what their transitions make of either way."""
    a, b = unordered(haplotypes)
    at = lambda c, side: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in side]), (F.col(c) + 1).cast("int"))
    named = moves.select(*keys, "layer", at("h_from", a).alias("__a"), at("h_from", b).alias("__b"), at("h_to", a).alias("__c"), at("h_to", b).alias("__d"), "expected")
    for x, y in (("__a", "__c"), ("__b", "__d"), ("__a", "__d"), ("__b", "__c")):
        p = edges.select(*keys, "layer", F.col("h_from").cast("long").alias(x), F.col("h_to").cast("long").alias(y), F.col("p").alias(f"p{x}{y}"))
        named = named.join(p, [*keys, "layer", x, y], "left")
    straight, across = (F.coalesce(F.col(x) * F.col(y), F.lit(0.0)) for x, y in (("p__a__c", "p__b__d"), ("p__a__d", "p__b__c")))
    share = F.when(straight + across > 0, straight / (straight + across)).otherwise(0.0)
    step = lambda x, y, w: F.struct(F.col(x).alias("h_from"), F.col(y).alias("h_to"), (F.col("expected") * w).alias("expected"))
    both = F.explode(F.array(step("__a", "__c", share), step("__b", "__d", share), step("__a", "__d", 1 - share), step("__b", "__c", 1 - share)))
    split = named.select(*keys, "layer", both.alias("x")).select(*keys, "layer", "x.*").filter("expected > 0")
    return split.groupBy(*keys, "layer", "h_from", "h_to").agg(F.sum("expected").alias("expected"))


def expected_transitions(rows: DataFrame, edges: DataFrame, keys: dict[str, str], sample: dict[str, str], layer: str, haplotypes: int, width: float = 1 << 16) -> DataFrame:
    """(keys, layer, h_from, h_to, expected) over all samples; rows as of chains()."""
    met = _with_transitions(rows, edges, [*keys], layer, haplotypes).withColumn("layer", F.col(layer).cast("long"))
    moves = expected_moves(met.filter("e is not null"), keys | sample, layer, pairs_model(haplotypes), keys | {"layer": "long"}, width)
    return haploid_counts(moves.join(edges.select(*keys, "layer").distinct(), [*keys, "layer"], "left_semi"), edges, [*keys], haplotypes)


def log_likelihoods(rows: DataFrame, edges: DataFrame, keys: dict[str, str], sample: dict[str, str], layer: str, haplotypes: int, width: float = 1 << 16) -> DataFrame:
    """(keys, sample, n, score): the log-likelihood of each sample's chain."""
    return scores(_with_transitions(rows, edges, [*keys], layer, haplotypes), keys | sample, layer, pairs_model(haplotypes), width)


def baum_welch(
    rows: DataFrame, nodes: DataFrame, keys: dict[str, str], sample: dict[str, str], layer: str, haplotypes: int, written: Callable[[DataFrame], DataFrame], rounds: int = 10, rate: float = 1.0, decay: float = 0.9, least_rate: float = 0.1, settled: float = 1e-3, width: float = 1 << 16
) -> DataFrame:
    """(keys, layer, h_from, h_to, p): transitions that settle, from even ones; nodes: (keys, layer, h), the haplotypes of each layer.

    A round takes the expected steps under the last table, as shares of what leaves each haplotype, and moves the table to them by a
    rate that falls by `decay` down to `least_rate`. The rounds end when no transition moves by more than `settled`, or
    after `rounds`. A haplotype that no sample is expected to leave keeps its transitions. `written` cuts the lineage of a round."""
    names = [*keys]
    edges = written(transitions.even_transitions(nodes, names, "layer", "h").withColumn("layer", F.col("layer") + 1).select(*names, "layer", "h_from", "h_to", "p"))
    edge = [*names, "layer", "h_from", "h_to"]
    for turn in range(rounds):
        found = expected_transitions(rows, edges, keys, sample, layer, haplotypes, width)
        out = F.sum("expected").over(Window.partitionBy(*names, "layer", "h_from"))
        new = found.withColumn("q", F.col("expected") / out).select(*edge, "q")
        leaving = new.select(*names, "layer", "h_from").distinct().withColumn("known", F.lit(True))
        met = edges.join(new, edge, "left").join(leaving, [*names, "layer", "h_from"], "left")
        target = F.when(F.col("known"), F.coalesce("q", F.lit(0.0))).otherwise(F.col("p"))
        now = max(rate * decay**turn, least_rate)
        moved = written(met.select(*edge, (F.col("p") * (1 - now) + target * now).alias("p"), F.col("p").alias("before")))
        edges = moved.select(*edge, "p")
        if moved.filter(F.abs(F.col("p") - F.col("before")) > settled).isEmpty():
            break
    return edges
