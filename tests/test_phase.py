"""Phase correction: planted flips put right through a pedigree of three generations, and paths equal to enumeration."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import graph, phase

RATE, WIDTH = 5e-8, 10_000


def gamete(rng, parent, turns):
    """A strand of a parent (bin, 2), with crossovers at the given bins; and which strand each bin is of."""
    strand = rng.integers(0, 2)
    of = np.array([(strand + sum(t <= k for t in turns)) % 2 for k in range(len(parent))])
    return parent[np.arange(len(parent)), of]


def pedigree(seed, bins):
    """Two couples of founders, a child of each (20, 21), six children of these two; no founder is anywhere twice."""
    rng = np.random.default_rng(seed)
    truth = {k: np.tile([2 * k, 2 * k + 1], (bins, 1)) for k in range(4)}
    parents = {20: (0, 1), 21: (2, 3)} | {30 + k: (20, 21) for k in range(6)}
    for child, (f, m) in parents.items():
        truth[child] = np.stack([gamete(rng, truth[f], rng.integers(3, bins - 3, 1)), gamete(rng, truth[m], rng.integers(3, bins - 3, 1))], 1)
    return truth, parents


def frames(spark, painted, parents):
    rows = [(k, b, float(WIDTH), *(None if x < 0 else int(x) for x in v[b])) for k, v in painted.items() for b in range(len(v))]
    return spark.createDataFrame(rows, "sample long, bin long, width double, h1 long, h2 long"), spark.createDataFrame([(c, f, m) for c, (f, m) in parents.items()] + [(0, None, None), (99, 0, 1), (98, 0, None)], "child long, father long, mother long")


def test_planted_flips_are_put_right(spark):
    truth, parents = pedigree(3, 40)
    wrong = {k: v.copy() for k, v in truth.items()}
    for k, at in ((20, slice(10, 25)), (21, slice(30, 40)), (30, slice(0, 7)), (33, slice(15, 21)), (35, slice(0, 40))):
        wrong[k][at] = wrong[k][at][:, ::-1]
    wrong[31][5] = -1  # unknown founders
    wrong[34][20] = truth[34][20] = truth[34][20][::-1]  # two changes of phase cost more than one bin's misfits: it stays
    df, known = frames(spark, wrong, parents)
    found, rounds = phase.corrected(df, known, "long", graph.written, RATE)
    got = {(r["sample"], r["bin"]): (r["h1"], r["h2"]) for r in found.collect()}
    assert 1 <= rounds <= 4 and len(got) == sum(map(len, truth.values()))
    for k, v in truth.items():
        for b in range(40):
            assert got[k, b] == ((None, None) if (k, b) == (31, 5) else tuple(v[b])), (k, b)
    again, none = phase.corrected(found, known, "long", graph.written, RATE)
    assert none == 0 and again.count() == found.count()


def score(path, cells, moved, kids):
    """The log score of a path of (phase, strand of the first, strand of the second), by its definition."""
    total, switch, stay = 0.0, math.log(WIDTH * RATE), math.log(1 - WIDTH * RATE)
    for b, (f, s, t) in enumerate(path):
        c, p, q = cells[b]
        total -= phase.MISMATCH * (int(c[f] != p[s]) + int(c[1 - f] != q[t]))
        if b:
            free = len(set(c)) == 1 or len(set(cells[b - 1][0])) == 1
            total += sum(switch if x != y else stay for x, y in zip(path[b - 1][1:], (s, t), strict=True))
            turn = f != path[b - 1][0]
            total -= phase.TURN if turn and not free else 0.0
            total += moved[b] * (stay if turn else switch) + (kids - moved[b]) * (switch if turn else stay)
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_are_the_best_of_all(spark, seed):
    """A sample between two parents and three children, five bins: the path's score is that of the best of 8^5."""
    rng, bins = np.random.default_rng(seed), 5
    painted = {k: rng.integers(0, 3, (bins, 2)) for k in (0, 1, 10, 11, 30, 31, 32)}
    parents = {10: (0, 1)} | {k: (10, 11) for k in (30, 31, 32)}
    df, known = frames(spark, painted, parents)
    trios = phase._trios(df, known, RATE)
    got = phase.inherited(trios, "long").collect()
    moved = [sum(r["moved"] for r in got if r["parent"] == 10 and r["bin"] == b) for b in range(bins)]
    cells = [(painted[10][b], painted[0][b], painted[1][b]) for b in range(bins)]
    every = {p: score(p, cells, moved, 3) for p in itertools.product(itertools.product((0, 1), repeat=3), repeat=bins)}
    top = max(every.values())
    best = {tuple(x[0] for x in p) for p, v in every.items() if v > top - 1e-9}
    found = sorted((r["bin"], r["phase"]) for r in phase.phases(df, known, "long", RATE).filter("sample = 10").collect())
    assert tuple(p for _, p in found) in best
    for child in (30, 31, 32):  # and the strands a child has got
        cells = [(painted[child][b], painted[10][b], painted[11][b]) for b in range(bins)]
        every = {p: score(p, cells, [0] * bins, 0) for p in itertools.product(itertools.product((0, 1), repeat=3), repeat=bins)}
        top = max(every.values())
        strands = {(r["parent"], r["bin"]): r["strand"] for r in got if r["child"] == child}
        assert tuple(strands[10, b] for b in range(bins)) in {tuple(x[1] for x in p) for p, v in every.items() if v > top - 1e-9}
        assert tuple(strands[11, b] for b in range(bins)) in {tuple(x[2] for x in p) for p, v in every.items() if v > top - 1e-9}
