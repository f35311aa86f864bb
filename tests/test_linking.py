"""Posteriors, expected steps and the learning of transitions between blocks, against sums over all paths."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, linking, paths


def sums(start, mats):
    """Of every path: chances of each state at each row, of each step, and the likelihood."""
    n, s = len(mats), len(start)
    post, moves, total = np.zeros((n, s)), np.zeros((n, s, s)), 0.0
    for path in itertools.product(range(s), repeat=n + 1):
        p = math.exp(start[path[0]]) * math.prod(math.exp(m[a, b]) for m, a, b in zip(mats, path, path[1:], strict=False))
        total += p
        for t, (a, b) in enumerate(zip(path, path[1:], strict=False)):
            post[t, b] += p
            moves[t, a, b] += p
    return post / total, moves / total, math.log(total)


@pytest.mark.parametrize("width", [1, 4, 100])
def test_posteriors_and_steps_are_sums_over_all_paths(spark, width):
    rng = np.random.default_rng(2)
    model = paths.strands(["e0", "e1"], "t")
    rows, expected = [], {}
    for k in "ab":
        e, t = rng.uniform(0.1, 1, (7, 2)), rng.uniform(0, 0.6, 7)
        if k == "b":
            t[3], t[5], e[2, 0] = 0.0, 1.0, 0.0
        rows += [(k, i, float(e[i, 0]), float(e[i, 1]), float(t[i]), i % 2) for i in range(7)]
        with np.errstate(divide="ignore"):
            mats = [np.log([[1 - t[i], t[i]], [t[i], 1 - t[i]]]) + np.log(e[i]) for i in range(7)]
        expected[k] = sums(model.start, mats)
    df = spark.createDataFrame(rows, "k string, i long, e0 double, e1 double, t double, odd long")
    found = {(r["k"], r["i"]): r for r in paths.posteriors(df, {"k": "string"}, "i", model, width).collect()}
    assert len(found) == 14
    for (k, i), r in found.items():
        assert np.allclose(r["posterior"], expected[k][0][i]) and abs(r["log_likelihood"] - expected[k][2]) < 1e-9
    assert np.allclose([r["score"] for r in sorted(paths.scores(df, {"k": "string"}, "i", model, width).collect())], [expected["a"][2], expected["b"][2]])
    moves = {(r["odd"], r["h_from"], r["h_to"]): r["expected"] for r in paths.expected_moves(df, {"k": "string"}, "i", model, {"odd": "long"}, width).collect()}
    for odd, i, j in itertools.product((0, 1), repeat=3):
        assert abs(moves[odd, i, j] - sum(expected[k][1][odd::2, i, j].sum() for k in "ab")) < 1e-9


@pytest.mark.parametrize("t, e", [(0.0, (0.5, 0.25)), (1.0, (0.5, 0.25)), (0.3, (0.0, 0.5)), (0.0, (0.0, 0.5))])
def test_strands_at_the_edges_of_chance(spark, t, e):
    """Certain switches, impossible ones and impossible states: sums stay numbers, or are impossible."""
    df = spark.createDataFrame([("k", i, *e, t if i else 0.5) for i in range(3)], "k string, i long, e0 double, e1 double, t double")
    total = 0.0
    for path in itertools.product((0, 1), repeat=3):
        total += 0.5 * math.prod(e[s] for s in path) * math.prod(t if a != b else 1 - t for a, b in zip(path, path[1:], strict=False))
    found = paths.scores(df, {"k": "string"}, "i", paths.strands(["e0", "e1"], "t")).first()["score"]
    assert (found == -math.inf) if total == 0 else abs(found - math.log(total)) < 1e-9


def test_a_sequence_that_nothing_explains_is_impossible(spark):
    df = spark.createDataFrame([("k", 0, 0.0, 0.0, 0.5), ("k", 1, 1.0, 1.0, 0.5)], "k string, i long, e0 double, e1 double, t double")
    model = paths.strands(["e0", "e1"], "t")
    assert paths.scores(df, {"k": "string"}, "i", model).first()["score"] == -math.inf
    assert all(x is None for r in paths.posteriors(df, {"k": "string"}, "i", model).collect() for x in r["posterior"])
    assert paths.expected_moves(df, {"k": "string"}, "i", model, {"k": "string"}).count() == 0


@pytest.mark.parametrize("width", [1, 3, 100])
def test_folded_pairs_equal_ordered_pairs_with_one_switch(spark, width):
    rng = np.random.default_rng(5)
    k, rate = 3, 0.01
    a, b = paths.unordered(k)
    e = np.log(rng.uniform(0.05, 1, (4, len(a))))
    gaps = [None, 30.0, 0.0, 90.0]
    index = {(x, y): n for n, (x, y) in enumerate(zip(a, b, strict=True))}
    post, total = np.zeros((4, len(a))), 0.0
    for path in itertools.product(itertools.product(range(k), repeat=2), repeat=4):
        p = k**-2.0
        for i, (x, y) in enumerate(path):
            if i:
                theta = min(max(gaps[i], 1.0) * rate, 0.5)
                apart = (x != path[i - 1][0]) + (y != path[i - 1][1])
                p *= {0: (1 - theta) ** 2, 1: theta * (1 - theta) / (k - 1), 2: 0.0}[apart]
            p *= math.exp(e[i, index[min(x, y), max(x, y)]])
        total += p
        for i, (x, y) in enumerate(path):
            post[i, index[min(x, y), max(x, y)]] += p
    df = spark.createDataFrame([("s", i, e[i].tolist(), gaps[i]) for i in range(4)], "k string, i long, e array<double>, gap double")
    found = sorted(paths.posteriors(df, {"k": "string"}, "i", paths.folded(k, "e", "gap", rate), width).collect(), key=lambda r: r["i"])
    assert np.allclose([r["posterior"] for r in found], post / total) and abs(found[0]["log_likelihood"] - math.log(total)) < 1e-9


def chained(seed, samples, layers, k):
    """Emissions of pairs, and transitions with a zero and rows of uneven chances."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(0.05, 1, (samples, layers, k, k))
    e = (e + e.transpose(0, 1, 3, 2)) / 2
    t = rng.dirichlet(np.ones(k), (layers - 1, k))
    return e, t


@pytest.mark.parametrize("width", [1, 2, 7])
def test_expected_transitions_are_sums_over_all_chains_of_ordered_pairs(spark, width):
    samples, layers, k = 3, 4, 2
    e, t = chained(3, samples, layers, k)
    t[1, 0] = [1.0, 0.0]
    counts, logs = np.zeros((layers - 1, k, k)), []
    for s in range(samples):
        part, total = np.zeros_like(counts), 0.0
        for path in itertools.product(itertools.product(range(k), repeat=2), repeat=layers):
            p = k**-2.0 * math.prod(e[s, i, x, y] for i, (x, y) in enumerate(path))
            p *= math.prod(t[i - 1, path[i - 1][m], path[i][m]] for i in range(1, layers) for m in (0, 1))
            total += p
            for i in range(1, layers):
                for m in (0, 1):
                    part[i - 1, path[i - 1][m], path[i][m]] += p
        counts += part / total
        logs.append(math.log(total))
    rows = [("c", s, i, x, y, math.log(e[s, i, x, y])) for s in range(samples) for i in range(layers) for x in range(k) for y in range(k)]
    chain = linking.chains(spark.createDataFrame(rows, "c string, s long, i long, h1 long, h2 long, log_emission double"), ["c"], "s", "i", k)
    edges = spark.createDataFrame([("c", i + 1, x, y, float(t[i, x, y])) for i in range(layers - 1) for x in range(k) for y in range(k) if t[i, x, y] > 0], "c string, layer long, h_from long, h_to long, p double")
    args = ({"c": "string"}, {"s": "long"}, "i", k, width)
    found = {(r["layer"], r["h_from"], r["h_to"]): r["expected"] for r in linking.expected_transitions(chain, edges, *args).collect()}
    for i, x, y in itertools.product(range(layers - 1), range(k), range(k)):
        assert abs(found.get((i + 1, x, y), 0.0) - counts[i, x, y]) < 1e-9
    assert np.allclose(sorted(r["score"] for r in linking.log_likelihoods(chain, edges, *args).collect()), sorted(logs))


def test_transitions_are_learnt_from_pairs_without_order(spark):
    """Samples whose haplotypes go on as a fixed permutation: the table settles on it, and the likelihood never falls on the way."""
    rng = np.random.default_rng(7)
    k, layers, after = 3, 3, [1, 2, 0]
    rows = []
    for s in range(40):
        pair = rng.integers(0, k, 2)
        for i in range(layers):
            rows += [("c", s, i, x, y, math.log(0.9 if sorted((x, y)) == sorted(pair) else 0.02)) for x in range(k) for y in range(x, k)]
            pair = np.array([after[h] for h in pair])
    chain = linking.chains(spark.createDataFrame(rows, "c string, s long, i long, h1 long, h2 long, log_emission double"), ["c"], "s", "i", k)
    chain = graph.written(chain)
    nodes = spark.createDataFrame([("c", i, h) for i in range(layers) for h in range(k)], "c string, layer long, h long")
    args = ({"c": "string"}, {"s": "long"}, "i", k)
    total = []
    for rounds in (1, 2, 6):
        edges = linking.baum_welch(chain, nodes, *args, graph.written, rounds=rounds)
        total.append(linking.log_likelihoods(chain, edges, *args).agg(F.sum("score")).first()[0])
    assert total == sorted(total)
    p = {(r["layer"], r["h_from"], r["h_to"]): r["p"] for r in edges.collect()}
    assert len(p) == 2 * k * k and all(p[i, h, after[h]] > 0.9 for i in (1, 2) for h in range(k))
    assert all(abs(sum(p[i, h, x] for x in range(k)) - 1) < 1e-9 for i in (1, 2) for h in range(k))
