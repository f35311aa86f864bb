"""The tasks of block confidences are the more the more rows there are."""

from tessera.plans import registry

from .test_queries import DATA


def test_block_confidence_has_tasks_by_rows(spark, monkeypatch):
    expected = sorted(map(tuple, registry.QUERIES["q_block_confidence"](spark, DATA).collect()))
    monkeypatch.setattr("tessera.plans.evidence.ROWS", 500)
    found = registry.QUERIES["q_block_confidence"](spark, DATA)
    assert found.rdd.getNumPartitions() >= 2 * 6000 / 500
    assert sorted(map(tuple, found.collect())) == expected
