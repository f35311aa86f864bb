"""Joins of few keys with very many rows on both sides."""

from tessera.operators import joins


def test_crossed_is_a_join_of_few_keys_in_many_tasks(spark):
    left = spark.createDataFrame([(k % 2, k) for k in range(40)] + [(1, 7), (5, 1), (None, 2)], "g int, x long")
    right = spark.createDataFrame([(k % 2, k) for k in range(30)] + [(0, 4), (6, 1), (None, 2)], "g int, y long")
    found = joins.crossed(left, right, ["g"], 50)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, "g").select("g", "x", "y").collect()))
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 4 and max(sizes) < found.count() / 2
    assert joins.crossed(left.filter("g = 5"), right, ["g"]).count() == 0
