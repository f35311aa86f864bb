"""Parents and their states: candidate panels, utilities, evidence of states, stability, and the pedigree made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import rank_votes, tempered, tied_rank


def trio_panel(scores: DataFrame, child: str, parent: str, score: str, top: int, anchors: int) -> DataFrame:
    """(child, a, b), a < b: pairs of a child's `top` parents, and of its `anchors` best with any other."""
    place = F.row_number().over(Window.partitionBy(child).orderBy(F.desc(score), parent))
    ranked = scores.withColumn("__place", place)
    one = ranked.select(child, F.col(parent).alias("__p"), F.col("__place").alias("__i"))
    two = ranked.select(child, F.col(parent).alias("__q"), F.col("__place").alias("__j"))
    near = ((F.col("__i") <= top) & (F.col("__j") <= top)) | (F.col("__i") <= anchors)
    met = one.filter(F.col("__i") <= max(top, anchors)).join(two, child).filter(near & (F.col("__p") != F.col("__q")))
    return met.select(child, F.least("__p", "__q").alias("a"), F.greatest("__p", "__q").alias("b")).distinct()


def alternatives(zero: DataFrame, one: DataFrame, two: DataFrame, child: str, contamination: float) -> DataFrame:
    """(child, state, a, b, score): no parent, one, or two; the scores of parents are mixed with that of none, at `contamination`.

    zero: (child, score); one: (child, a, score); two: (child, a, b, score)."""
    base = zero.select(child, F.col("score").alias("__zero"))
    none = zero.select(child, F.lit("none").alias("state"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "score")
    x, y = F.col("score") + F.ln(F.lit(1 - contamination)), F.col("__zero") + F.ln(F.lit(contamination))
    mixed = F.greatest(x, y) + F.ln(1 + F.exp(-F.abs(x - y)))
    some = lambda df, state, b: df.join(base, child).select(child, F.lit(state).alias("state"), F.col("a").cast("long").alias("a"), b.alias("b"), mixed.alias("score"))
    return none.unionByName(some(one, "one", F.lit(None).cast("long"))).unionByName(some(two, "two", F.col("b").cast("long")))


def unique_margin(keys: list[str], score: str, tolerance: float = 1e-9) -> Column:
    """Whether the best of the keys is ahead of the next by more than the tolerance; alone it isn't."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.nth_value(score, 1).over(w) - F.nth_value(score, 2).over(w) > tolerance, F.lit(False))


def source_utility(keys: list[str], score: str, weight: float = 0.35, floor: float = -60.0) -> Column:
    """The tied rank at `weight`, and a softmax of the score (not below the best by more than `floor`) at the rest; even where the best isn't alone."""
    w = Window.partitionBy(*keys)
    part = F.exp(F.greatest(F.col(score) - F.max(score).over(w), F.lit(floor)))
    mixed = weight * tied_rank(keys, score) + (1 - weight) * part / F.sum(part).over(w)
    return F.when(unique_margin(keys, score), mixed).otherwise(1 / F.count(F.lit(1)).over(w))


def information_weights(sources: DataFrame, keys: list[str], markers: str, ratio: float) -> DataFrame:
    """The square root of each source's markers over the median one, within [1/ratio, ratio], normalised to sum 1 within the keys."""
    w = Window.partitionBy(*keys)
    root = sources.withColumn("__root", F.sqrt(F.col(markers).cast("double")))
    middle = root.groupBy(*keys).agg(F.median("__root").alias("__middle"))
    clipped = root.join(middle, keys).withColumn("__w", F.least(F.greatest(F.col("__root") / F.col("__middle"), F.lit(1 / ratio)), F.lit(float(ratio))))
    return clipped.withColumn("weight", F.col("__w") / F.sum("__w").over(w)).drop("__root", "__middle", "__w")


def robust_utility(keys: list[str], score: str, tie: list[str], blocks: Column, rank_weight: float = 0.9, power: float = 0.5, contamination: float = 0.01) -> Column:
    """The rank vote at `rank_weight`, and a tempered softmax with an even share mixed in at the rest; scores are divided by blocks^power."""
    return rank_weight * rank_votes(keys, score, tie) + (1 - rank_weight) * tempered(keys, score, F.pow(blocks.cast("double"), F.lit(power)), contamination)


def state_evidence(scores: DataFrame, keys: list[str], state: str, score: str, priors: dict[str, float]) -> DataFrame:
    """(keys, state, evidence, weight, best): the log of the mean likelihood of a state's alternatives with its prior, its share, and whether it is the keys' best (of equal ones the first in `priors`)."""
    top = scores.withColumn("__top", F.max(score).over(Window.partitionBy(*keys, state)))
    prior = F.element_at(F.create_map(*[F.lit(x) for k, p in priors.items() for x in (k, float(p))]), F.col(state))
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(priors) for x in (k, i)]), F.col(state))
    mean = top.groupBy(*keys, state).agg((F.max("__top") + F.ln(F.avg(F.exp(F.col(score) - F.col("__top"))))).alias("__mean"))
    found = mean.withColumns({"evidence": F.col("__mean") + F.ln(prior), "__place": place})
    w = Window.partitionBy(*keys)
    part = F.exp(F.col("evidence") - F.max("evidence").over(w))
    first = F.row_number().over(w.orderBy(F.desc("evidence"), "__place"))
    return found.withColumns({"weight": part / F.sum(part).over(w), "best": first == 1}).drop("__mean", "__place")


def marginal(counts: DataFrame, child: str, pair: list[str], count: str) -> DataFrame:
    """(child, parent, count): counts of pairs summed to their parents; a pair of one twice counts once."""
    each = counts.select(child, count, F.explode(F.array_distinct(F.array(*pair))).alias("parent")).filter("parent is not null")
    return each.groupBy(child, "parent").agg(F.sum(count).alias(count))


def held_out_regret(utilities: DataFrame, group: list[str], unit: str, choice: str, utility: str, blocks: Column) -> DataFrame:
    """(group, unit, winner, rank, regret): the choice that wins by the mean of the other units, its rank in the unit, and how far it is below the unit's best, times the root of the unit's blocks."""
    w, own = Window.partitionBy(*group, choice), Window.partitionBy(*group, unit)
    n = F.count(F.lit(1)).over(w)
    rows = utilities.withColumns({"__others": F.when(n > 1, (F.sum(utility).over(w) - F.col(utility)) / (n - 1)), "__rank": F.row_number().over(own.orderBy(F.desc(utility), choice)), "__best": F.max(utility).over(own), "__blocks": blocks})
    first = F.row_number().over(own.orderBy(F.desc_nulls_last("__others"), choice))
    won = rows.withColumn("__first", first).filter("__first = 1")
    return won.select(*group, unit, F.col(choice).alias("winner"), F.col("__rank").alias("rank"), ((F.col("__best") - F.col(utility)) * F.sqrt(F.col("__blocks").cast("double"))).alias("regret"))


def tier(rules: list[tuple[str, Column]], otherwise: str = "C") -> Column:
    """The first label whose rule holds; a rule that is null doesn't."""
    return reduce(lambda rest, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(rest), reversed(rules), F.lit(otherwise))


def assembled(members: DataFrame, seeds: DataFrame, assigned: DataFrame, sample: str, generation: str, parents: list[str]) -> DataFrame:
    """The pedigree: founders without parents, the first generation's from `seeds`, the second's from `assigned`, both (sample, parents). A member of these two without a row there is an error."""
    s = seeds.select(sample, F.struct(*parents).alias("__seed"))
    a = assigned.select(sample, F.struct(*parents).alias("__assigned"))
    met = members.join(s, sample, "left").join(a, sample, "left")
    row = F.when(F.col(generation) == "F1", F.col("__seed")).when(F.col(generation) == "F2", F.col("__assigned"))
    missing = F.col(generation).isin("F1", "F2") & row.isNull()
    checked = met.filter(F.when(missing, F.raise_error(F.concat(F.lit("no parents for "), F.col(sample).cast("string")))).otherwise(True))
    return checked.select(*members.columns, *[row[p].alias(p) for p in parents])
