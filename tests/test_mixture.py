"""Bernoulli mixtures: planted components and their number, and likelihoods that never fall."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import graph, mixture


def planted(seed, centres, rows, noise):
    rng = np.random.default_rng(seed)
    which = rng.integers(0, len(centres), rows)
    return np.where(rng.random((rows, centres.shape[1])) < noise, 1 - centres[which], centres[which])


@pytest.fixture(scope="module")
def patterns(spark):
    rng = np.random.default_rng(5)
    three, one = rng.integers(0, 2, (3, 24)), rng.integers(0, 2, (1, 24))
    rows = [("three", x.tolist()) for x in planted(1, three, 300, 0.05)] + [("one", x.tolist()) for x in planted(2, one, 200, 0.05)]
    rows[7][1][3] = None
    return three, one, rows, mixture.distinct_patterns(spark.createDataFrame(rows, "key string, bits array<int>"), ["key"], "bits")


def log_likelihood(rows, weights, chances):
    total = 0.0
    for x in rows:
        total += math.log(sum(w * math.prod(1.0 if b is None else q if b else 1 - q for b, q in zip(x, c, strict=True)) for w, c in zip(weights, chances, strict=True)))
    return total


def test_components_and_their_number_are_found(spark, patterns):
    three, one, rows, df = patterns
    models = graph.written(mixture.fitted(df, ["key"], 4, graph.written, settled=1e-4))
    assert models.count() == 2 * 4 * 2
    best = {r["key"]: r for r in mixture.chosen(models, ["key"]).collect()}
    assert {k: r["k"] for k, r in best.items()} == {"three": 3, "one": 1}
    for key, centres in (("three", three), ("one", one)):
        got = sorted([int(q > 0.5) for q in c] for c in best[key]["chances"])
        assert got == sorted(centres.tolist()) and abs(sum(best[key]["weights"]) - 1) < 1e-9


def test_likelihoods_never_fall_and_are_those_of_the_parameters_before(spark, patterns):
    _, _, rows, df = patterns
    own = [x for k, x in rows if k == "three"]
    last, before = {}, {}
    for rounds in (1, 2, 4):
        now = {(r["k"], r["turn"]): r for r in mixture.fitted(df.filter("key = 'three'"), ["key"], 3, graph.written, rounds=rounds).collect()}
        assert all(now[m]["log_likelihood"] >= last[m] - 1e-9 for m in last)
        if rounds == 2:  # the likelihood of a round is that of the parameters of the round before
            for m, r in now.items():
                assert abs(r["log_likelihood"] - log_likelihood(own, before[m]["weights"], before[m]["chances"])) < 1e-6
        last, before = {m: r["log_likelihood"] for m, r in now.items()}, now
    assert all(a["bic"] == pytest.approx((m[0] * 24 + m[0] - 1) * math.log(300) - 2 * a["log_likelihood"]) for m, a in now.items())
    assert len({m for m in itertools.product((1, 2, 3), (0, 1))} - set(now)) == 0
