"""Choices from a pool whose losses come some samples at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import discovery, graph, subset

from .test_selection import losses, pools


@pytest.fixture(scope="module")
def made(spark):
    _, pool, p = pools(7, 3, 4, 30, 20, 0.03)
    cells = [(1, s, x, *map(float, p[s, x])) for s in range(len(p)) for x in range(p.shape[1])]
    panel = [(1, i, x, int(v)) for i, h in enumerate(pool) for x, v in enumerate(h)]
    frames = spark.createDataFrame(cells, "block int, sample long, site long, p0 double, p1 double, p2 double"), spark.createDataFrame(panel, "block int, hap long, site long, allele int")
    return graph.written(subset.pool_losses(*frames, "block", "int", "sample", "site")), pool, p


def test_a_pack_has_the_losses_of_every_sample_and_pair(made):
    held, pool, p = made
    [r] = held.collect()
    cube = np.frombuffer(r["losses"]).reshape(r["n"], len(pool) + 1, len(pool) + 1)
    assert r["n"] == len(p) and np.allclose(np.sort(cube, axis=0), np.sort(losses(p, pool, discovery.WILDCARD), axis=0), atol=1e-3)


def test_the_choice_finds_the_founders(made):
    assert subset.chosen(made[0], "block", "int", graph.written).select(F.array_sort("haps")).first()[0] == [0, 1, 2]


def test_the_enumeration_finds_the_founders(made):
    assert subset.enumerated(made[0], "block", "int").select(F.array_sort("haps")).first()[0] == [0, 1, 2]


def test_losses_are_whole_however_few_samples_come_at_a_time(made, monkeypatch):
    _, pool, p = made
    pack = discovery.Pack(np.log(np.maximum(p, 1e-12)))
    whole = np.concatenate([x for _, x in pack.losses(pool)])
    monkeypatch.setattr(discovery, "CELLS", 3 * whole.shape[1])
    parts = list(pack.losses(pool))
    assert len(parts) == 10 and [at for at, _ in parts] == list(range(0, 30, 3)) and np.allclose(np.concatenate([x for _, x in parts]), whole)
