"""Best assignments against enumeration."""

import itertools

import numpy as np
import pytest

from tessera.operators import matching


def enumerated(w, locked=None, barred=()):
    n = len(w)
    found = [(-sum(int(w[i, s[i]]) for i in range(n)), s) for s in itertools.permutations(range(n)) if all(s[i] == j for i, j in (locked or {}).items()) and not any(s[i] == j for i, j in barred)]
    return [(-less, s) for less, s in sorted(found)]


@pytest.mark.parametrize("seed", range(30))
def test_all_assignments_in_order(seed):
    """Up to 6 x 6; few values make many ties."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 7))
    w = rng.integers(-3, 4, (n, n)) if seed % 2 else rng.integers(-(10**9), 10**9, (n, n))
    assert list(matching.assignments(w, 200)) == enumerated(w)[:200]


@pytest.mark.parametrize("seed", range(40))
def test_locked_and_forbidden_pairs(seed):
    rng = np.random.default_rng(100 + seed)
    n = 5
    w = rng.integers(0, 3, (n, n))
    locked = dict(zip(rng.permutation(n)[:seed % 3].tolist(), rng.permutation(n).tolist(), strict=False))
    barred = {(int(i), int(j)) for i, j in rng.integers(0, n, (seed % 9, 2))}
    expected = enumerated(w, locked, barred)
    assert matching.assignment(w, locked, barred) == (expected[0] if expected else None)


def test_a_wide_table():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1000, (40, 40))
    first, second = matching.assignments(w, 2)
    swapped = [sum(w[i, s] for i, s in enumerate(first[1])) for _ in range(1)][0]
    assert swapped == first[0] >= second[0] and sorted(first[1]) == list(range(40)) and first[1] != second[1]


def test_groups_of_weights(spark):
    rows = [("a", 10, "x", 0.5), ("a", 10, "y", 0.25), ("a", 20, "x", 0.75), ("a", 20, "y", 0.5), ("b", 1, "x", 1.0), ("b", 1, "y", None), ("b", 2, "x", 1.0), ("b", 2, "y", 0.5), ("b", 2, "y", 0.25), ("c", 1, "x", 1.0), ("c", 2, "x", 1.0), ("d", 1, "x", None)]
    df = spark.createDataFrame(rows, "k string, i long, j string, w double")
    got = sorted(tuple(r) for r in matching.best_assignments(df, {"k": "string"}, "i", "j", "w", 3).collect())
    assert got == [("a", 1, 10, "x", 1.0), ("a", 1, 20, "y", 1.0), ("a", 2, 10, "y", 1.0), ("a", 2, 20, "x", 1.0), ("b", 1, 1, "x", 1.5), ("b", 1, 2, "y", 1.5)]
