"""Queries over candidate parents, utilities, states and the pedigree made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assignments, validation
from .ranking import _UTILITIES, _utilities
from .registry import query
from .tables import table

_SCORED = "sc AS (SELECT o_custkey % 100 AS child, o_orderkey % 12 AS parent, round(avg(o_totalprice) / 50000, 9) AS score FROM orders GROUP BY 1, 2)"


def _scored(spark, sf_dir):
    """(child, parent, score) of orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 100).alias("child"), (F.col("o_orderkey") % 12).alias("parent")).agg(F.round(F.avg("o_totalprice") / 50000, 9).alias("score"))


_PANEL = f"{_SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) AS i FROM sc), pn AS (SELECT DISTINCT x.child, least(x.parent, y.parent) AS a, greatest(x.parent, y.parent) AS b FROM rk x JOIN rk y ON x.child = y.child AND x.parent <> y.parent AND ((x.i <= 3 AND y.i <= 3) OR x.i <= 1))"


@query(f"WITH {_PANEL} SELECT child, a, b FROM pn")
def q_trio_panel(spark, sf_dir):
    """Pairs of a child's three best parents, and of its best with any."""
    return assignments.trio_panel(_scored(spark, sf_dir), "child", "parent", "score", 3, 1)


_ALTERNATIVES = f"""{_PANEL}, ze AS (SELECT child, avg(score) AS score FROM sc GROUP BY child), tw AS (SELECT pn.child, pn.a, pn.b, x.score + y.score - 2 AS score FROM pn JOIN sc x ON x.child = pn.child AND x.parent = pn.a JOIN sc y ON y.child = pn.child AND y.parent = pn.b),
al AS (SELECT child, 'none' AS state, NULL::BIGINT AS a, NULL::BIGINT AS b, score FROM ze UNION ALL SELECT child, 'one', parent, NULL, greatest(sc.score + ln(0.95), ze.score + ln(0.05)) + ln(1 + exp(-abs(sc.score + ln(0.95) - ze.score - ln(0.05)))) FROM sc JOIN ze USING (child)
UNION ALL SELECT child, 'two', a, b, greatest(tw.score + ln(0.95), ze.score + ln(0.05)) + ln(1 + exp(-abs(tw.score + ln(0.95) - ze.score - ln(0.05)))) FROM tw JOIN ze USING (child))"""


def _alternatives(spark, sf_dir):
    s = _scored(spark, sf_dir)
    zero = s.groupBy("child").agg(F.avg("score").alias("score"))
    one = s.select("child", F.col("parent").alias("a"), "score")
    panel = assignments.trio_panel(s, "child", "parent", "score", 3, 1)
    two = panel.join(s.select("child", F.col("parent").alias("a"), F.col("score").alias("x")), ["child", "a"]).join(s.select("child", F.col("parent").alias("b"), F.col("score").alias("y")), ["child", "b"])
    return assignments.alternatives(zero, one, two.select("child", "a", "b", (F.col("x") + F.col("y") - 2).alias("score")), "child", 0.05)


@query(f"WITH {_ALTERNATIVES} SELECT child, state, a, b, round(score, 7) AS score FROM al")
def q_parent_alternatives(spark, sf_dir):
    """No parent, one or two, with the scores of parents mixed with that of none."""
    return _alternatives(spark, sf_dir).withColumn("score", F.round("score", 7))


@query(f"""WITH {_ALTERNATIVES}, m AS (SELECT child, state, max(score) AS t FROM al GROUP BY ALL), e AS (SELECT child, state, max(t) + ln(avg(exp(score - t))) + ln(CASE state WHEN 'none' THEN 0.2 WHEN 'one' THEN 0.3 ELSE 0.5 END) AS e FROM al JOIN m USING (child, state) GROUP BY child, state),
w AS (SELECT *, exp(e - max(e) OVER (PARTITION BY child)) AS p, row_number() OVER (PARTITION BY child ORDER BY e DESC, state) = 1 AS best FROM e) SELECT child, state, round(e, 6) AS evidence, round(p / sum(p) OVER (PARTITION BY child), 6) AS weight, best FROM w""")
def q_state_evidence(spark, sf_dir):
    """How likely it is that a child has no parent, one or two among the candidates."""
    e = assignments.state_evidence(_alternatives(spark, sf_dir), ["child"], "state", "score", {"none": 0.2, "one": 0.3, "two": 0.5})
    return e.select("child", "state", F.round("evidence", 6).alias("evidence"), F.round("weight", 6).alias("weight"), "best")


@query(f"""WITH {_SCORED}, b AS (SELECT *, count(*) OVER w AS n, rank() OVER (w ORDER BY score DESC) + (count(*) OVER (PARTITION BY child, score) - 1) / 2.0 AS mean, max(score) OVER w AS top FROM sc WINDOW w AS (PARTITION BY child)),
c AS (SELECT *, exp(greatest(score - top, -60)) AS p FROM b), t AS (SELECT child, score AS second FROM sc QUALIFY row_number() OVER (PARTITION BY child ORDER BY score DESC) = 2),
d AS (SELECT c.*, coalesce(top - second > 1e-9, false) AS ahead FROM c LEFT JOIN t USING (child)) SELECT child, parent, ahead, round(CASE WHEN ahead THEN 0.35 * CASE WHEN n < 2 THEN 1 ELSE (n - mean) / (n * (n - 1) / 2.0) END + 0.65 * p / sum(p) OVER (PARTITION BY child) ELSE 1.0 / n END, 7) AS utility FROM d""")
def q_source_utility(spark, sf_dir):
    """A parent's utility to a child from one source: its tied rank and a softmax; even where the best isn't alone."""
    s = _scored(spark, sf_dir)
    return s.select("child", "parent", assignments.unique_margin(["child"], "score").alias("ahead"), F.round(assignments.source_utility(["child"], "score"), 7).alias("utility"))


@query("""WITH s AS (SELECT s_nationkey AS g, s_suppkey AS source, sqrt(count(*)::DOUBLE) AS root FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2), m AS (SELECT g, median(root) AS middle FROM s GROUP BY g),
c AS (SELECT g, source, least(greatest(root / middle, 1 / 1.05), 1.05) AS w FROM s JOIN m USING (g)) SELECT g, source, round(w / sum(w) OVER (PARTITION BY g), 8) AS weight FROM c""")
def q_information_weights(spark, sf_dir):
    """Weights of a nation's suppliers by the root of their lines, neither far above nor below the median."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("markers"))
    s = table(spark, sf_dir, "supplier").join(l, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("source"), "markers")
    return assignments.information_weights(s, ["g"], "markers", 1.05).select("g", "source", F.round("weight", 8).alias("weight"))


@query(f"""WITH {_SCORED}, b AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY score DESC, parent) AS i, score / pow(8, 0.5) AS x FROM sc WINDOW w AS (PARTITION BY child)), c AS (SELECT *, exp(x - max(x) OVER (PARTITION BY child)) AS p FROM b)
SELECT child, parent, round(0.9 * CASE WHEN n < 2 THEN 1 ELSE 1 - (i - 1) / (n - 1.0) END + 0.1 * (0.99 * p / sum(p) OVER (PARTITION BY child) + 0.01 / n), 7) AS utility FROM c""")
def q_robust_utility(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("child", "parent", F.round(assignments.robust_utility(["child"], "score", ["parent"], F.lit(8)), 7).alias("utility"))


@query("WITH p AS (SELECT o_custkey % 40 AS child, o_orderkey % 9 AS a, o_custkey % 7 AS b, count(*) AS n FROM orders GROUP BY 1, 2, 3) SELECT child, parent, CAST(sum(n) AS BIGINT) AS n FROM (SELECT child, n, unnest(list_distinct([a, b])) AS parent FROM p) GROUP BY child, parent")
def q_parent_marginals(spark, sf_dir):
    """Counts of pairs of parents summed to single parents."""
    p = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("child"), (F.col("o_orderkey") % 9).alias("a"), (F.col("o_custkey") % 7).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return assignments.marginal(p, "child", ["a", "b"], "n")


@query(f"""WITH {_UTILITIES}, v AS (SELECT contig, child, pair, round(utility, 9) AS utility FROM u), n AS (SELECT *, count(*) OVER p AS k, (sum(utility) OVER p - utility) AS rest, row_number() OVER (PARTITION BY child, contig ORDER BY utility DESC, pair) AS place, max(utility) OVER (PARTITION BY child, contig) AS top FROM v WINDOW p AS (PARTITION BY child, pair)),
o AS (SELECT *, CASE WHEN k > 1 THEN round(rest / (k - 1), 9) END AS others FROM n) SELECT child, contig, pair AS winner, place AS "rank", round((top - utility) * 2, 6) AS regret FROM o QUALIFY row_number() OVER (PARTITION BY child, contig ORDER BY others DESC NULLS LAST, pair) = 1""")
def q_held_out_regret(spark, sf_dir):
    """What a contig thinks of the pair that wins on the others."""
    u = _utilities(spark, sf_dir).withColumn("utility", F.round("utility", 9))
    found = assignments.held_out_regret(u, ["child"], "contig", "pair", "utility", F.lit(4))
    return found.select("child", "contig", "winner", "rank", F.round("regret", 6).alias("regret"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN 'A' WHEN o_totalprice > 100000 THEN 'B' ELSE 'C' END AS tier FROM orders""")
def q_tiers(spark, sf_dir):
    """A cascade of rules."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", assignments.tier([("A", (price > 200000) & (F.col("o_orderstatus") == "F")), ("B", price > 100000)]).alias("tier"))


@query("""WITH m AS (SELECT c_custkey AS sample, CASE WHEN c_custkey % 3 = 0 THEN 'F0' WHEN c_custkey % 3 = 1 THEN 'F1' ELSE 'F2' END AS generation FROM customer)
SELECT sample, generation, CASE generation WHEN 'F1' THEN sample - 1 WHEN 'F2' THEN sample - 1 END AS father, CASE generation WHEN 'F1' THEN 0 WHEN 'F2' THEN sample - 2 END AS mother FROM m""")
def q_built_pedigree(spark, sf_dir):
    """Customers of three generations with the parents that two tables give them."""
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_custkey") % 3 == 0, "F0").when(F.col("c_custkey") % 3 == 1, "F1").otherwise("F2").alias("generation"))
    rows = lambda g, mother: m.filter(F.col("generation") == g).select("sample", (F.col("sample") - 1).alias("father"), mother.cast("long").alias("mother"))
    return assignments.assembled(m, rows("F1", F.lit(0)), rows("F2", F.col("sample") - 2), "sample", "generation", ["father", "mother"])


@query("""WITH s AS (SELECT o_orderpriority AS group_, o_orderstatus AS k, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY group_ ORDER BY score DESC, k) AS place, max(score) OVER (PARTITION BY group_) AS top FROM s)
SELECT group_, k, place, round(top - score, 2) AS behind FROM r WHERE place <= 2""")
def q_shortlist(spark, sf_dir):
    """The two best of each group, and how far the second is behind."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("group_"), F.col("o_orderstatus").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    w = Window.partitionBy("group_")
    r = s.withColumns({"place": F.row_number().over(w.orderBy(F.desc("score"), "k")), "behind": F.round(F.max("score").over(w) - F.col("score"), 2)})
    return r.filter("place <= 2").select("group_", "k", "place", "behind")


def _t(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} = {k} THEN {0.0 if k < 2 else validation.t_quantile(k):.12f}" for k in range(1, 201)) + f" ELSE {validation.t_quantile(201):.12f} END"


@query(f"""WITH g AS (SELECT c_nationkey AS depth, count(*) AS n, avg(c_acctbal / 100) AS mean, coalesce(stddev_samp(c_acctbal / 100) / sqrt(count(*)), 0) AS sem, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS seeds FROM customer GROUP BY 1)
SELECT depth, n, round(mean, 6) AS mean, round(sem, 6) AS sem, seeds, round(least(greatest(mean - sem * {_t('n')}, 0), 100), 6) AS lower, round(least(greatest(mean + sem * {_t('n')}, 0), 100), 6) AS upper FROM g""")
def q_mean_interval(spark, sf_dir):
    """Means with Student's intervals, clipped to percentages, and the seeds that they come from."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("depth"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_mktsegment").alias("seed"))
    found = validation.mean_interval(c, ["depth"], "x", "seed")
    return found.select("depth", "n", *[F.round(k, 6).alias(k) for k in ("mean", "sem")], "seeds", *[F.round(k, 6).alias(k) for k in ("lower", "upper")])
