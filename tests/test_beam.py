"""Beam search over layers against enumeration and a plain search."""

import itertools

import numpy as np
import pytest

from tessera.operators import beam, graph


def layered(seed, sizes):
    rng = np.random.default_rng(seed)
    return {(a, b): np.round(rng.normal(size=(sizes[a], sizes[b])), 6) for a in range(len(sizes)) for b in range(a + 1, len(sizes))}


def steps(path, mesh, gap):
    return [0.0] + [float(np.mean([mesh[p, t][path[p], path[t]] for p in range(max(0, t - gap), t)])) for t in range(1, len(path))]


def mmr(candidates, width, weight):
    """Of (path, score) the beam, as panels.diverse_beam has it."""
    candidates = sorted(candidates)
    if len(candidates) <= width:
        return candidates
    score = np.array([round(s, 9) for _, s in candidates])
    scaled = (score - score.min()) / (score.max() - score.min()) if score.max() > score.min() else np.ones(len(score))
    paths, chosen = np.array([p for p, _ in candidates]), [int(score.argmax())]
    while len(chosen) < width:
        novelty = np.min([(paths != paths[c]).mean(axis=1) for c in chosen], axis=0)
        value = weight * scaled + (1 - weight) * novelty
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return [candidates[c] for c in chosen]


def plain(mesh, sizes, width, weight, gap):
    total = lambda p: sum(steps(p, mesh, gap))
    now = [((h,), 0.0) for h in range(sizes[0])]
    for t in range(1, len(sizes)):
        now = mmr([((*p, h), total((*p, h))) for p, _ in now for h in range(sizes[t])], width, weight)
    for t in range(len(sizes) - 1, -1, -1):
        now = mmr([(p, total(p)) for p in {(*p[:t], h, *p[t + 1 :]) for p, _ in now for h in range(sizes[t])}], width, weight)
    return [p for p, _ in sorted(now, key=lambda x: (-round(x[1], 9), x[0]))]


@pytest.mark.parametrize("width, gap", [(1000, None), (4, None), (3, 2)])
def test_beams(spark, width, gap):
    blocks = {"a": [2, 3, 2, 3], "b": [3, 2]}
    meshes = {k: layered(n, s) for n, (k, s) in enumerate(blocks.items())}
    edges = [(k, p, t, i, j, float(m[i, j])) for k, mesh in meshes.items() for (p, t), m in mesh.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    nodes = [(k, t, h) for k, s in blocks.items() for t, n in enumerate(s) for h in range(n)]
    found = beam.search(spark.createDataFrame(edges, "k string, past long, layer long, h_from long, h_to long, score double"), spark.createDataFrame(nodes, "k string, layer long, h long"), {"k": "string"}, width, 0.7, graph.written, gap)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["k"], r["rank"])):
        got.setdefault(r["k"], []).append((tuple(r["path"]), r["score"]))
    for k, sizes in blocks.items():
        assert [p for p, _ in got[k]] == plain(meshes[k], sizes, width, 0.7, gap or 99)
        assert all(abs(x - sum(steps(p, meshes[k], gap or 99))) < 1e-9 for p, x in got[k])
        if width == 1000:
            every = list(itertools.product(*map(range, sizes)))
            assert len(got[k]) == len(every) and got[k][0][0] == max(every, key=lambda p: sum(steps(p, meshes[k], 99)))
