"""Density clusters against plain Python over all distances: Kruskal's tree, and the condensed tree by taking sets of points apart."""

import numpy as np
import pytest

from tessera.operators import density, graph

LEAST = density.LEAST


def apart(x, y):
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    return sum(a != b for a, b in both) / len(both) if both else 1.0


def reachability(rows, near):
    d = np.array([[apart(x, y) for y in rows] for x in rows])
    core = [sorted(np.delete(d[i], i))[: near][-1] if len(rows) > 1 else 0.0 for i in range(len(rows))]
    return core, np.array([[max(d[i, j], core[i], core[j]) for j in range(len(rows))] for i in range(len(rows))])


def pieces(points, w, below):
    left, out = set(points), []
    while left:
        part, edge = set(), [min(left)]
        while edge:
            p = edge.pop()
            if p not in part:
                part.add(p)
                edge += [q for q in left if q != p and q not in part and w[p, q] < below]
        out.append(part)
        left -= part
    return out


def kruskal(w):
    part, total = list(range(len(w))), []
    for x, i, j in sorted((w[i, j], i, j) for i in range(len(w)) for j in range(i)):
        if part[i] != part[j]:
            part = [part[i] if p == part[j] else p for p in part]
            total.append(x)
    return total


def by_hand(w, size, whole):
    """The chosen clusters, as sets, with their stabilities."""

    def taken(points, birth, top):
        now, stability = set(points), 0.0
        while True:
            level = min(x for x in sorted({w[i, j] for i in now for j in now if i != j}) if len(pieces(now, w, x + 1e-12)) == 1)
            gone = pieces(now, w, level)
            large, d = [p for p in gone if len(p) >= size], 1 / max(level, LEAST)
            if len(large) == 1:
                stability += (d - birth) * (len(now) - len(large[0]))
                now = large[0]
                continue
            stability += (d - birth) * len(now)
            inner = [x for p in large for x in taken(p, d, False)]
            if (whole or not top) and stability >= sum(s for _, s in inner) - 1e-12:
                return [(frozenset(points), stability)]
            return inner

    return dict(taken(set(range(len(w))), 0.0, True)) if len(w) > 1 else {}


def planted(seed, centres, each, noise, stray, sites=40):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2, (centres, sites))
    x = np.where(rng.random((centres * each, sites)) < noise, 1 - np.repeat(h, each, 0), np.repeat(h, each, 0))
    return np.concatenate([x, rng.integers(0, 2, (stray, sites))]).tolist()


CASES = {"three": planted(1, 3, 12, 0.05, 5), "near": planted(2, 2, 15, 0.12, 0), "copies": planted(3, 4, 6, 0.0, 3), "noise": planted(4, 0, 0, 0, 20), "one": [[0, 1] * 20], "two": planted(5, 1, 2, 0.1, 0)}
CASES["three"][4][7] = CASES["three"][20][0] = None


@pytest.mark.parametrize("side, size, near, whole", [(1024, 4, 3, False), (7, 5, 1, False), (5, 2, 2, True)])
def test_clusters(spark, side, size, near, whole):
    rows = [(k, i, x) for k, v in CASES.items() for i, x in enumerate(v)] + [("three", 3, CASES["three"][3]), ("three", None, [0] * 40), ("three", 99, None)]
    df = spark.createDataFrame(rows, "key string, id long, bits array<int>")
    found = density.clusters(df, ["key"], "id", "bits", size, near, graph.written, side=side, whole=whole).collect()
    clean = graph.written(df.filter("id is not null and bits is not null").distinct())
    core = {(r["key"], r["id"]): r["core"] for r in density.core_distances(clean, ["key"], "id", "bits", near, side=side).collect()}
    tree = density.spanning_tree(density.reachability_edges(clean, ["key"], "id", "bits", near, graph.written, side=side), ["key"], graph.written).collect()
    for k, v in CASES.items():
        cores, w = reachability(v, near)
        assert len(v) == 1 or [core[k, i] for i in range(len(v))] == pytest.approx(cores)
        own = [r for r in tree if r["key"] == k]
        assert sorted(r["weight"] for r in own) == pytest.approx(sorted(kruskal(w)))
        assert all(r["weight"] == pytest.approx(w[r["a"], r["b"]]) for r in own)
        sets, stability = {}, {}
        for r in (r for r in found if r["key"] == k):
            if r["cluster"] is not None:
                sets.setdefault(r["cluster"], set()).add(r["id"])
                stability[r["cluster"]] = r["stability"]
        assert [min(sets[c]) for c in sorted(sets)] == sorted(min(s) for s in sets.values()) and sorted(sets) == list(range(len(sets)))
        assert {frozenset(s): pytest.approx(stability[c]) for c, s in sets.items()} == by_hand(np.round(w, 12), size, whole)
        assert sum(r["key"] == k for r in found) == len(v)
    if near == 3:
        assert sorted(len({r["id"] for r in found if r["key"] == "three" and r["cluster"] == c}) >= 11 for c in range(3)) == [True] * 3


def test_ids_are_strings_and_sizes_have_a_least(spark):
    df = spark.createDataFrame([(f"s{i:02d}", x) for i, x in enumerate(planted(7, 2, 8, 0.03, 0))], "name string, bits array<int>")
    found = {r["name"]: r["cluster"] for r in density.clusters(df, [], "name", "bits", 4, 2, graph.written, side=6).collect()}
    assert {found[f"s{i:02d}"] for i in range(8)} == {0} and {found[f"s{i:02d}"] for i in range(8, 16)} == {1}
    with pytest.raises(ValueError, match="two points"):
        density.clusters(df, [], "name", "bits", 1, 2, graph.written)
    assert density.clusters(df.limit(0), [], "name", "bits", 2, 1, graph.written).count() == 0
