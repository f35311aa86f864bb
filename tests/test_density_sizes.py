"""Density clusters: what blocks send on and hold grows with a group's rows, and few edges are left between components."""

import tracemalloc

import numpy as np

from tessera.operators import density, graph


def test_a_block_holds_some_distances_at_a_time():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 2, (2000, 16)).astype(float) for _ in range(2))
    tracemalloc.start()
    least = density._nearest(x, y, 3, density.share_apart, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # all distances at once would be 32 MB
    d = (x[:, None, :] != y[None, :, :]).mean(axis=2)
    assert np.allclose(np.sort(least, axis=1), np.sort(d, axis=1)[:, :3])


def test_one_edge_is_left_between_two_components(spark):
    """Two groups of near points with all edges between them: after the first round the least of these is left."""
    edges = [(a, b, 1.0 if a // 5 == b // 5 else 5.0 + abs(a - b)) for a in range(10) for b in range(a + 1, 10)]
    df = spark.createDataFrame(edges, "a long, b long, weight double").selectExpr("0 as key", "*")
    live = []

    def written(df):
        out = graph.written(df)
        if "ca" in out.columns:
            live.append(out.count())
        return out

    tree = density.spanning_tree(df, ["key"], written).collect()
    assert live[0] == len(edges) and all(n <= 1 for n in live[1:])
    assert len(tree) == 9 and sorted(r["weight"] for r in tree) == [1.0] * 8 + [6.0] and [(r["a"], r["b"]) for r in tree if r["weight"] > 1] == [(4, 5)]


def test_rows_go_to_few_blocks(spark, tmp_path):
    """The queries' blocks: a label's rows, some thousand of them, aren't sent to many blocks."""
    from tessera.plans import registry

    rng = np.random.default_rng(2)
    rows = [(0, k, rng.normal(size=8).round(3).tolist()) for k in range(3000)]
    spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, dealt = [], density.dealt_blocks
    density.dealt_blocks = lambda *a: seen.append(dealt(*a)) or seen[-1]
    try:
        registry.QUERIES["q_core_distances"](spark, str(tmp_path))
    finally:
        density.dealt_blocks = dealt
    assert [x.count() for x in seen] == [6000]
