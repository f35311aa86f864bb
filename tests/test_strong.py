"""Strong components and choices without cycles, against plain Python."""

import itertools

import numpy as np
import pytest

from tessera.operators import graph


def reach(edges):
    nodes = {x for e in edges for x in e}
    far = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for i in nodes:
            if k in far[i]:
                far[i] |= far[k]
    return far


def by_hand(edges):
    far = reach(edges)
    return {n: min(m for m in far if m in far[n] and n in far[m]) for n in far if n in far[n]}


def found(spark, edges, small=0):
    return {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(edges, "child long, parent long"), small).collect()}


@pytest.mark.parametrize("seed, small", [(0, 1 << 17), (1, 1 << 17), (2, 0), (3, 20)])
def test_components_of_small_graphs(spark, seed, small):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 24, (26 + 6 * seed, 2))] + [(40, 41), (41, 42), (42, 40), (42, 43), (43, 44), (44, 50), (50, 51), (51, 50), (60, 60), (60, 61), (61, 62)]
    assert found(spark, edges, small) == by_hand(edges)


def test_a_ring_and_a_tail_by_joins_alone(spark):
    assert found(spark, [*((i, (i + 1) % 30) for i in range(30)), (3, 40), (40, 41)]) == dict.fromkeys(range(30), 0)


def test_long_cycles_and_tails(spark, k=50, small=1 << 17):
    """A cycle of 2,000 nodes with a chord's detour, a way to another cycle, and a tail."""
    ring = [(i, (i + 1) % (40 * k)) for i in range(40 * k)]
    detour = [(10, 5000), *((5000 + i, 5001 + i) for i in range(6 * k)), (5000 + 6 * k, 20)]
    other = [(9000 + i, 9000 + (i + 1) % (14 * k)) for i in range(14 * k)]
    way = [(5, 7000), *((7000 + i, 7001 + i) for i in range(10 * k)), (7000 + 10 * k, 9000)]
    tail = [(9001, 12000), *((12000 + i, 12001 + i) for i in range(16 * k))]
    got = found(spark, ring + detour + other + way + tail, small)
    assert got == {i: 0 for i in [*range(40 * k), *range(5000, 5001 + 6 * k)]} | {i: 9000 for i in range(9000, 9000 + 14 * k)}
    assert found(spark, tail, small) == {} and found(spark, [(None, 1), (1, None)], small) == {}


def plain_choice(rows, passes, tolerance=1e-9):
    by = {}
    for c, a, b, x in sorted(rows, key=lambda r: (r[0], -r[3], -1 if r[1] is None else r[1], -1 if r[2] is None else r[2])):
        by.setdefault(c, []).append((x, a, b))
    margin = {c: o[0][0] - o[1][0] for c, o in by.items() if len(o) > 1 and o[0][0] - o[1][0] > tolerance}
    order, chosen = sorted(margin, key=lambda c: (-margin[c], c)), {}

    def cyclic(c, option):
        up = {k: {p for p in v[1:] if p is not None} for k, v in (chosen | {c: option}).items()}
        far = reach([(k, p) for k, v in up.items() for p in v] or [(None, None)])
        return any(n in far[n] for n in far if n is not None)

    def best(c):
        fine = [o for o in by[c] if not cyclic(c, o)]
        return None if not fine or len(fine) > 1 and fine[0][0] - fine[1][0] <= tolerance else fine[0]

    for turn in range(passes + 1):
        for c in order:
            chosen.pop(c, None)
            option = best(c)
            if option:
                chosen[c] = option
    return {c: o[1:] for c, o in chosen.items()}


@pytest.mark.parametrize("seed", range(3))
def test_parents_are_chosen_in_the_order_of_margins(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(14):
        for a, b in itertools.islice(itertools.combinations(rng.permutation([x for x in range(14) if x != c]).tolist(), 2), int(rng.integers(1, 6))):
            rows.append((c, a, None if rng.random() < 0.2 else b, float(rng.integers(0, 12))))
    rows += [(100, 3, 4, 5.0), (100, 5, 6, 1.0), (101, 3, 4, 5.0), (101, 5, 6, 5.0), (102, 1, 2, 9.0)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "c long, a long, b long, s double")
    got = {r["c"]: (r["a"], r["b"]) for r in graph.acyclic_choice(df, "c", "a", "b", "s", passes=2).collect()}
    assert got == plain_choice(rows, 2) and 100 in got and 101 not in got and 102 not in got
    far = reach([(c, p) for c, o in got.items() for p in o if p is not None])
    assert not any(n in far[n] for n in far)


def test_a_pedigree_with_a_long_cycle_loses_one_pair_of_parents(spark):
    rows = [(i, (i + 1) % 2000, None, 0.5) for i in range(2000)] + [(3000, 7, None, 0.1), (3001, 7, None, 0.1)]
    out = {r["c"]: r["p"] for r in graph.resolve_cycles(spark.createDataFrame(rows, "c long, p long, q long, s double"), "c", ["p", "q"], "s").collect()}
    assert [c for c, p in out.items() if p is None] == [7]  # it has most children
