"""Triangles of words, maximum cuts and choices from a pool, against enumeration in plain Python."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import cuts, discovery, graph, subset, triangles


def words(seed, haps, sites, noise):
    """The het words of all pairs of some haplotypes, with noise; the pairs as ids."""
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2, (haps, sites))
    pairs = list(itertools.combinations(range(haps), 2))
    return h, pairs, np.array([np.where(rng.random(sites) < noise, 1 - (h[a] ^ h[b]), h[a] ^ h[b]) for a, b in pairs])


def by_hand(bits, mismatch, distinct):
    apart = lambda i, j: int((bits[i] ^ bits[j]).sum())
    out = set()
    for i, j, k in itertools.combinations(range(len(bits)), 3):
        d = int((bits[i] ^ bits[j] ^ bits[k]).sum())
        if d <= mismatch and min(apart(i, j), apart(i, k), apart(j, k)) > distinct:
            out.add((i, j, k, d))
    return out


@pytest.mark.parametrize("seed, haps, sites, mismatch, distinct", [(1, 8, 80, 4, 3), (2, 12, 64, 6, 0), (3, 5, 10, 2, -1), (4, 4, 200, 0, 5), (5, 6, 3, 5, 0)])
def test_triangles(spark, seed, haps, sites, mismatch, distinct):
    _, pairs, bits = words(seed, haps, sites, 0.02)
    bits = np.concatenate([bits, bits[:2], np.zeros((2, sites), int)])  # copies, and groups without heterozygous sites
    rows = [("k", i, x.tolist()) for i, x in enumerate(bits)] + [("k", 3, bits[3].tolist()), ("k", 999, None), ("other", 0, bits[0].tolist()), ("other", 1, bits[0][:2].tolist()), ("other", 2, [])]
    df = spark.createDataFrame(rows, "key string, g long, bits array<int>")
    found = [tuple(r) for r in triangles.xor_triangles(df, ["key"], "g", "bits", mismatch, distinct).select("key", "g1", "g2", "g3", "differ").collect()]
    assert len(found) == len(set(found)) and {r[1:] for r in found} == by_hand(bits, mismatch, distinct) and {r[0] for r in found} <= {"k"}


def test_triangles_give_back_the_haplotypes(spark):
    h, pairs, _ = words(6, 5, 40, 0.0)
    df = spark.createDataFrame([(i, (h[a] ^ h[b]).tolist(), (h[a] + h[b]).tolist()) for i, (a, b) in enumerate(pairs)], "g long, bits array<int>, dosage array<int>")
    trios = triangles.xor_triangles(df, [], "g", "bits", 0, 3)
    assert trios.count() == math.comb(5, 3)
    got = {tuple(r["hap"]): r["support"] for r in triangles.shared(trios, df, [], "g", "dosage").collect()}
    assert got == {tuple(x): math.comb(4, 2) for x in h.tolist()}


def best_cuts(nodes, weight):
    scored = {}
    for far in itertools.chain.from_iterable(itertools.combinations(nodes[1:], r) for r in range(1, len(nodes))):
        scored[far] = sum(w for (a, b), w in weight.items() if (a in far) != (b in far))
    top = max(scored.values())
    return {(far, top, sum(weight.values()) - top) for far, x in scored.items() if x == top}


@pytest.mark.parametrize("seed, n, low", [(1, 2, 0), (2, 7, 0), (3, 12, -5), (4, 9, -9), (5, 5, 1)])
def test_maximum_cuts(spark, seed, n, low):
    rng = np.random.default_rng(seed)
    nodes = [3 * k + 1 for k in range(n)]
    weight = {e: int(rng.integers(low, 10)) if seed != 5 else 1 for e in itertools.combinations(nodes, 2)}
    rows = [("k", b, a, w) for (a, b), w in weight.items()] + [("k", 1, 1, 50), ("tie", 1, 2, 1), ("tie", 3, 4, 1)]  # a loop counts for nothing
    found = cuts.maximum_cuts(spark.createDataFrame(rows, "key string, a long, b long, weight long"), ["key"]).collect()
    assert {(tuple(r["side"]), r["across"], r["within"]) for r in found if r["key"] == "k"} == best_cuts(nodes, weight)
    assert sorted(r["side"] for r in found if r["key"] == "tie") == [[2, 3], [2, 4]]


def test_large_graphs_are_refused_by_the_exact_cut_and_bettered_by_rounds(spark):
    rng = np.random.default_rng(9)
    edges = {(int(min(a, b)), int(max(a, b))): int(w) for a, b, w in zip(*rng.integers(0, 150, (2, 900)), rng.integers(0, 9, 900), strict=True) if a != b}
    star = {(1000, 1001 + i): 1 for i in range(200)}
    df = spark.createDataFrame([("k", a, b, w) for (a, b), w in edges.items()] + [("star", a, b, w) for (a, b), w in star.items()], "key string, a long, b long, weight long")
    with pytest.raises(Exception, match="more than 14 nodes"):
        cuts.maximum_cuts(df, ["key"]).collect()
    side = {(r["key"], r["node"]): r["side"] for r in cuts.improved_cut(df, ["key"], graph.written).collect()}
    for key, weight in (("k", edges), ("star", star)):
        across = sum(w for (a, b), w in weight.items() if side[key, a] != side[key, b])
        assert 2 * across >= sum(weight.values())
        for n in {x for e in weight for x in e}:
            assert sum(w if side[key, a] == side[key, b] else -w for (a, b), w in weight.items() if n in (a, b)) <= 0
    assert len({side["star", 1001 + i] for i in range(200)}) == 1


def test_open_sites_are_turned_by_pairs_on_one_side(spark):
    """Haplotypes 0, 1 | 2, 3: the third site is turned wrongly, the fourth rightly, the first two aren't open."""
    haps = {0: [0, 0, 0, 1], 1: [0, 1, 0, 1], 2: [0, 1, 1, 0], 3: [1, 1, 1, 0]}
    truth = {k: [*v[:2], 1 - v[2], v[3]] for k, v in haps.items()}
    pairs = [(0, 0, 2), (1, 1, 3), (2, 0, 1), (3, 0, 3), (4, 2, 2)]
    chance = lambda g, d: 0.9 if g == d else 0.05
    cells = [("k", s, site, *[chance(g, truth[a][site] + truth[b][site]) for g in range(3)]) for s, a, b in pairs for site in range(4)]
    df = spark.createDataFrame(cells, "key string, sample long, site long, p0 double, p1 double, p2 double")
    panel = spark.createDataFrame([("k", k, i, x) for k, v in haps.items() for i, x in enumerate(v)], "key string, hap long, site long, allele int")
    used = spark.createDataFrame([("k", *p) for p in pairs], "key string, sample long, a long, b long")
    found = cuts.maximum_cuts(cuts.pair_weights(used, ["key"], "a", "b"), ["key"]).filter("array_join(side, ',') = '2,3'")
    assert [(r["across"], r["within"]) for r in found.collect()] == [(3, 1)]
    open_ = cuts.open_sites(panel, found, ["key"], "hap", "site", "allele")
    assert sorted((r["site"], r["own"]) for r in open_.collect()) == [(2, 0), (3, 1)]
    turned = {r["site"]: r for r in cuts.turned_sites(open_, panel, used, df, ["key"], "sample", "site").collect()}
    assert turned[2]["turned"] and not turned[3]["turned"]
    assert turned[2]["before"] == pytest.approx(-2 * math.log(0.05)) and turned[2]["after"] == pytest.approx(-2 * math.log(0.9))


def pools(seed, founders, extra, samples, sites, noise):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2, (founders, sites))
    a, b = rng.integers(0, founders, (2, samples))
    dosage = h[a] + h[b]
    p = np.full((samples, sites, 3), noise)
    np.put_along_axis(p, dosage[:, :, None], 1 - 2 * noise, 2)
    wrong = h[rng.integers(0, founders, extra)].copy()
    wrong[rng.random(wrong.shape) < 0.2] ^= 1
    return h, np.concatenate([h, wrong]), p


def losses(p, haps, wildcard):
    """(sample, member, member) by its definition, the wildcard last."""
    logs, (n, sites, _) = np.log(np.maximum(p, 1e-12)), p.shape
    k = len(haps)
    out = np.empty((n, k + 1, k + 1))
    for i, j in itertools.product(range(k + 1), repeat=2):
        for s in range(n):
            free = [{0, 1} if m == k else None for m in (i, j)]
            t = 0.0
            for x in range(sites):
                one, two = ([*(free[0] or {haps[i][x]})], [*(free[1] or {haps[j][x]})])
                t -= max(logs[s, x, u + v] for u in one for v in two)
            out[s, i, j] = t + wildcard * sites * ((i == k) + (j == k))
    return out


def test_choices_equal_enumeration_and_find_the_founders(spark):
    blocks = {"a": pools(1, 3, 5, 40, 30, 0.02), "b": pools(2, 4, 4, 60, 30, 0.05), "c": pools(3, 1, 7, 10, 20, 0.1), "d": pools(4, 2, 6, 5, 25, 0.3)}
    cells = [(k, f"s{s}", x, *map(float, p[s, x])) for k, (_, _, p) in blocks.items() for s in range(len(p)) for x in range(p.shape[1])]
    panel = [(k, 10 + i, x, int(v)) for k, (_, pool, _) in blocks.items() for i, h in enumerate(pool) for x, v in enumerate(h)] + [("nobody", 1, 0, 1)]
    held = subset.pool_losses(spark.createDataFrame(cells, "block string, sample string, site long, p0 double, p1 double, p2 double"), spark.createDataFrame(panel, "block string, hap long, site long, allele int"), "block", "string", "sample", "site")
    held = graph.written(held)
    for scale in (0.5, 4.0, 1e6):
        local = {r["block"]: r for r in subset.chosen(held, "block", "string", graph.written, scale).collect()}
        whole = {r["block"]: r for r in subset.enumerated(held, "block", "string", scale).collect()}
        assert set(local) == set(whole) == set(blocks)
        for k, (_, pool, p) in blocks.items():
            cube, cost = losses(p, pool, discovery.WILDCARD), scale * p.shape[1] / 200 * len(p)
            best = {}
            for chosen in itertools.chain.from_iterable(itertools.combinations(range(8), r) for r in range(9)):
                own = [*chosen, 8]
                best[chosen] = len(chosen) * cost + 2 * cube[:, own][:, :, own].min(axis=(1, 2)).sum()
            top = min(best, key=lambda c: (round(best[c], 4), len(c)))
            assert whole[k]["bic"] == pytest.approx(best[top], rel=1e-5) and whole[k]["haps"] == [10 + c for c in top]
            assert local[k]["bic"] == pytest.approx(best[top], rel=1e-5) and sorted(local[k]["haps"]) == [10 + c for c in top]
            if scale == 1e6:
                assert local[k]["haps"] == []
    found = {r["block"]: r["haps"] for r in subset.chosen(held, "block", "string", graph.written).collect()}
    assert sorted(found["a"]) == [10, 11, 12] and sorted(found["b"]) == [10, 11, 12, 13]


def test_moves_are_the_losses_of_the_choices_they_lead_to():
    rng = np.random.default_rng(4)
    cube = rng.random((30, 8, 8))
    cube = np.minimum(cube, cube.transpose(0, 2, 1))
    table = subset.subset_losses(cube)
    for chosen in ([], [2], [0, 3, 6], list(range(7))):
        met = []
        for wide in (False, True):
            for gone, added, loss in subset.moves(cube, np.array(chosen, np.int64), wide):
                after = (set(chosen) - set(gone)) | set(added)
                own = [*sorted(after), 7]
                assert loss == pytest.approx(cube[:, own][:, :, own].min(axis=(1, 2)).sum()) == pytest.approx(table[sum(1 << c for c in after)])
                met.append((tuple(gone), tuple(added)))
        n, m = len(chosen), 7 - len(chosen)
        assert len(met) == len(set(met)) + 1  # to stay is among both
        assert len(set(met)) == (1 + n) * (1 + m + m * (m - 1) // 2) + n * (n - 1) // 2 * (1 + m + m * (m - 1) // 2)
