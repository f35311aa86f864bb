"""Chains of blocks are made of unordered pairs from the start."""

from pyspark.sql import functions as F

from tessera.operators import linking as operators
from tessera.plans import registry  # noqa: F401
from tessera.plans import linking, paths
from tessera.plans.tables import table

from .test_queries import DATA


def test_chains_make_no_pair_twice(spark):
    found = linking._chains(spark, DATA)
    label = table(spark, DATA, "embeddings").select(F.col("vec_id").alias("sample"), "label")
    both = paths._emission_table(spark, DATA).select("sample", F.col("bin").alias("layer"), "h1", "h2", "log_emission").join(label, "sample")
    plain = lambda df: sorted((r["label"], r["sample"], r["layer"], [round(x, 9) for x in r["e"]]) for r in df.collect())
    assert plain(found) == plain(operators.chains(both, ["label"], "sample", "layer", 4))
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert any("h1" in x and "<= h2" in x for x in joins)
