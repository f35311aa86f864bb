"""Even transitions without a window over the pairs."""

from tessera.operators import transitions


def test_even_transitions_of_a_hot_layer(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(20)] + [(2, k) for k in range(20)] + [(2, 3), (4, 1)], "layer int, h long")
    found = transitions.even_transitions(nodes, [], "layer", "h")
    got = {}
    for r in found.collect():
        got.setdefault((r["layer"], r["h_from"]), []).append(r["p"])
    assert got.keys() == {(1, k) for k in range(20)} and all(p == [1 / 21] * 21 for p in got.values())
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
