"""Phase correction holds no table of bins on the driver."""

from tessera.operators import graph, phase


def test_phases_broadcast_no_table_of_bins(spark):
    painted = graph.written(spark.createDataFrame([(s, b, 1e4, s % 2, b % 2) for s in range(6) for b in range(4)], "sample long, bin long, width double, h1 long, h2 long"))
    known = spark.createDataFrame([(s, s - 2, s - 1) for s in range(2, 6)], "child long, father long, mother long")
    plan = phase.phases(painted, known, "long")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
