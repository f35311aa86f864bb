"""Triangles of groups: three 0/1 words, any of which is nearly the exclusive or of the other two, and the haplotypes that they share.

Of mismatch + 1 blocks of sites one at least must agree whole, so candidates come from equi-joins on a block's value: pairs of distinct values
whose exclusive or is a value too, joined back to their groups. Distinct values are counted out before they are paired, and no pair of groups is made
that has no third on a block. A block's candidates are about n^3 / 2^width for n groups, so width, sites / (mismatch + 1), should be above log2 n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sites of a packed number; parts that the pairs of a key's values are dealt to.
WORD, PARTS = 62, 16


def _packed(bits: Column, start: Column, length: Column) -> Column:
    places = F.slice(bits, start.cast("int") + 1, length.cast("int"))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.coalesce(x, F.lit(0)).cast("bigint"))


def _apart(*words: str) -> Column:
    """In how many places the exclusive or of the words is 1."""
    one = F.col(words[0])
    for w in words[1:]:
        one = F.zip_with(one, F.col(w), lambda x, y: x.bitwiseXOR(y))
    return F.aggregate(one, F.lit(0), lambda s, x: s + F.bit_count(x))


def xor_triangles(groups: DataFrame, keys: list[str], group: str, bits: str, mismatch: int, distinct: int) -> DataFrame:
    """(keys, g1, g2, g3, differ): groups g1 < g2 < g3 of a key whose words' exclusive or has at most `mismatch` ones, any two of them more than `distinct` apart.

    bits: array of 0/1, a null place is 0. Groups of null words, and of words of unlike lengths, make no triangles; equal rows count once."""
    n = F.size("__bits")
    edge = lambda k: F.floor(k * n / (mismatch + 1))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / WORD), F.lit(1)) - 1), lambda w: _packed(F.col("__bits"), w * WORD, F.lit(WORD)))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(mismatch)), lambda k: _packed(F.col("__bits"), edge(k), F.least(edge(k + 1) - edge(k), F.lit(WORD))))
    rows = groups.filter(F.col(bits).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("g"), F.col(bits).alias("__bits"))
    rows = rows.select(*keys, "g", n.alias("__n"), words.alias("w"), blocks.alias("k")).distinct()
    member = rows.select(*keys, "__n", "g", "w", "k", F.posexplode("k").alias("at", "v"))
    own = [*keys, "__n", "at"]
    values = member.select(*own, "v").distinct()
    one = values.select(*own, F.col("v").alias("v1")).withColumn("__part", F.pmod(F.xxhash64("v1"), F.lit(PARTS)).cast("int"))
    two = values.select(*own, F.col("v").alias("v2")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    three = one.join(two, [*own, "__part"]).filter("v1 <= v2").withColumn("v3", F.col("v1").bitwiseXOR(F.col("v2"))).filter("v2 <= v3").drop("__part")
    three = three.join(values.withColumnRenamed("v", "v3"), [*own, "v3"], "left_semi")
    side = lambda i: member.select(*own, F.col("v").alias(f"v{i}"), F.col("g").alias(f"a{i}"), F.col("w").alias(f"w{i}"), F.col("k").alias(f"k{i}"))
    ordered = lambda i, j: (F.col(f"v{i}") < F.col(f"v{j}")) | (F.col(f"a{i}") < F.col(f"a{j}"))  # noqa: E731  a value's own groups in order
    pairs = three.join(side(2), [*own, "v2"]).join(side(3), [*own, "v3"]).filter(ordered(2, 3) & (_apart("w2", "w3") > distinct))
    met = pairs.join(side(1), [*own, "v1"]).filter(ordered(1, 2) & (_apart("w1", "w2") > distinct) & (_apart("w1", "w3") > distinct))
    agree = F.zip_with(F.zip_with("k1", "k2", lambda x, y: x.bitwiseXOR(y)), "k3", lambda x, y: x == y)
    met = met.withColumn("differ", _apart("w1", "w2", "w3")).filter((F.col("differ") <= mismatch) & (F.array_position(agree, True) == F.col("at") + 1))
    trio = F.array_sort(F.array("a1", "a2", "a3"))
    return met.select(*keys, *[F.get(trio, F.lit(i)).alias(f"g{i + 1}") for i in range(3)], "differ")


def shared(triangles: DataFrame, dosages: DataFrame, keys: list[str], group: str, dosage: str) -> DataFrame:
    """(keys, hap, support): the three haplotypes of each triangle, and from how many triangles each comes.

    Three groups a + b, a + c, b + c add up to twice a + b + c; half of that (rounded down) less a group is the haplotype it lacks, cut to 0..1."""
    side = lambda i: dosages.select(*keys, F.col(group).alias(f"g{i}"), F.col(dosage).alias(f"d{i}"))
    met = triangles.join(side(1), [*keys, "g1"]).join(side(2), [*keys, "g2"]).join(side(3), [*keys, "g3"])
    total = F.zip_with(F.zip_with("d1", "d2", lambda x, y: x + y), "d3", lambda x, y: F.floor((x + y) / 2).cast("int"))
    less = lambda d: F.zip_with("__half", d, lambda h, x: F.least(F.greatest(h - x, F.lit(0)), F.lit(1)).cast("int"))
    each = met.withColumn("__half", total).select(*keys, F.explode(F.array(*[less(f"d{i}") for i in (1, 2, 3)])).alias("hap"))
    return each.groupBy(*keys, "hap").agg(F.count(F.lit(1)).alias("support"))
