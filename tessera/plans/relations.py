"""Queries over joins of keys, cubes, unions, graphs and transition tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genotype
from ..operators import graph, joins, pairs, transitions
from .registry import query
from .tables import table


@query("""SELECT n_nationkey, s_suppkey, c_custkey FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey WHERE s_acctbal > 5000 AND c_mktsegment = 'BUILDING'""")
def q_cross_pairs(spark, sf_dir):
    """Every father with every mother of a nation."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    fathers = table(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey")
    return joins.crossed(c, fathers, ["n_nationkey"]).select("n_nationkey", "s_suppkey", "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) / 100000 AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS score FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT k, round((1.5 * coalesce(a.score, 0) + 2 * coalesce(b.score, 0)) / 3.5, 4) AS score FROM a FULL OUTER JOIN b USING (k)""")
def q_full_outer_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    a = o.filter("o_orderstatus = 'F'").groupBy("k").agg((F.sum("o_totalprice") / 100000).alias("score"))
    b = o.filter("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return transitions.full_outer_score(a, b, ["k"], 1.5).select("k", F.round("score", 4).alias("score"))


_SEGMENTS = "(SELECT DISTINCT c_mktsegment FROM customer), p AS (SELECT DISTINCT o_orderpriority FROM orders), n AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH s AS {_SEGMENTS} SELECT c_mktsegment, o_orderpriority, round(100 * pow(least(1, 2.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY c_mktsegment)), 2), 6) AS usage FROM s CROSS JOIN p LEFT JOIN n USING (c_mktsegment, o_orderpriority)""")
def q_usage_share(spark, sf_dir):
    """How much of a segment goes to each priority, those of none included."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    every = c.select("c_mktsegment").distinct().crossJoin(o.select("o_orderpriority").distinct())  # two short lists of names
    zero = F.coalesce("n", F.lit(0))
    share = zero / F.sum(zero).over(Window.partitionBy("c_mktsegment"))
    return every.join(n, ["c_mktsegment", "o_orderpriority"], "left").select("c_mktsegment", "o_orderpriority", F.round(100 * F.pow(F.least(F.lit(1.0), 2 * share), F.lit(2.0)), 6).alias("usage"))


_CELLS = "e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS site, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("site", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"""WITH {_CELLS}, m AS (SELECT label, site, avg(x) AS x FROM e GROUP BY ALL), q AS (SELECT u.label AS a, v.label AS b, u.site, (u.x + v.x) / 2 AS x FROM m u JOIN m v ON u.site = v.site AND u.label <= v.label),
d AS (SELECT vec_id, a, b, sum(abs(e.x - q.x)) AS distance FROM e JOIN q USING (site) GROUP BY vec_id, a, b) SELECT vec_id, a, b, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, a, b) = 1""")
def q_pair_match_argmin(spark, sf_dir):
    """The pair of label means nearest to each vector."""
    e = _cells(spark, sf_dir)
    m = e.groupBy("label", "site").agg(F.avg("x").alias("x"))
    u, v = m.select("site", F.col("label").alias("a"), F.col("x").alias("y")), m.select("site", F.col("label").alias("b"), F.col("x").alias("z"))
    q = u.join(v, "site").filter("a <= b").select("site", "a", "b", ((F.col("y") + F.col("z")) / 2).alias("mean"))
    d = e.join(q, "site").groupBy("vec_id", "a", "b").agg(F.sum(F.abs(F.col("x") - F.col("mean"))).alias("distance"))
    best = d.groupBy("vec_id").agg(F.min(F.struct("distance", "a", "b")).alias("r"))
    return best.select("vec_id", "r.a", "r.b", F.round("r.distance", 6).alias("distance"))


@query(f"""WITH {_CELLS} SELECT u.vec_id AS a, v.vec_id AS b, round(avg(u.x * v.x), 7) AS gram FROM e u JOIN e v ON u.label = v.label AND u.site = v.site AND u.vec_id < v.vec_id GROUP BY u.vec_id, v.vec_id""")
def q_gram_agreement(spark, sf_dir):
    """The mean product of two vectors of a label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    found = pairs.blocked(v, ["label"], "vec_id", "embedding", lambda x, y: {"gram": x @ y.T / x.shape[1]}, "gram double")
    return found.withColumn("gram", F.round("gram", 7))


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'All') AS quality, coalesce(CAST(toxic AS VARCHAR), 'All') AS toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def q_confusion_cube(spark, sf_dir):
    """A crosstab with margins."""
    cube = table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce(F.col("quality").cast("string"), F.lit("All")).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("All")).alias("toxic"), "n")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def q_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def q_union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True)


def _pedigree(spark, sf_dir):
    """(child, father, mother, sex): orders with a customer and a nation as parents, some unknown."""
    o = table(spark, sf_dir, "orders")
    known = lambda c, n: F.when(F.col("o_orderkey") % n != 0, c)
    return o.select(F.col("o_orderkey").alias("child"), known(F.col("o_custkey"), 5).alias("father"), known(F.col("o_custkey") % 25, 7).alias("mother"), F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M").alias("sex"))


_PEDIGREE = "ped AS (SELECT o_orderkey AS child, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS father, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 25 END AS mother, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex FROM orders)"


@query(f"WITH {_PEDIGREE} SELECT child, 1 AS slot, father AS parent FROM ped WHERE father IS NOT NULL UNION ALL SELECT child, 2, mother FROM ped WHERE mother IS NOT NULL")
def q_unpivot_edges(spark, sf_dir):
    return graph.parent_edges(_pedigree(spark, sf_dir), "child", ["father", "mother"])


@query(f"WITH {_PEDIGREE} SELECT 'fam' AS fid, CAST(child AS VARCHAR) AS iid, coalesce(CAST(father AS VARCHAR), '0') AS pid, coalesce(CAST(mother AS VARCHAR), '0') AS mid, CASE sex WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS sex, -9 AS phenotype FROM ped")
def q_fam(spark, sf_dir):
    return graph.fam(_pedigree(spark, sf_dir), "fam", "child", "father", "mother", "sex")


@query(f"WITH {_PEDIGREE} SELECT child, father * 11 AS parent FROM ped WHERE father IS NOT NULL AND father * 11 NOT IN (SELECT child FROM ped WHERE child IS NOT NULL)")
def q_unknown_parents(spark, sf_dir):
    """Fathers, their numbers spread out, that are no order's key."""
    return graph.unknown_parents(_pedigree(spark, sf_dir).withColumn("father", F.col("father") * 11), "child", ["father"]).select("child", "parent")


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS node, 1 AS generation FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, generation + 1 FROM r JOIN part ON p_partkey // 3 = node AND p_partkey > 0) SELECT node, max(generation) AS generation FROM r GROUP BY node""")
def q_generation_labels(spark, sf_dir):
    """The depth of each part in the tree where k's parent is k / 3."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = p.filter("node > 0").select(F.col("node").alias("child"), F.floor(F.col("node") / 3).alias("parent"))
    return graph.generations(edges, p)


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Founder_1' ELSE o_orderpriority END AS t1, o_orderstatus AS t2, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS f1, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS f2 FROM orders)
SELECT o_orderkey, CASE WHEN contains(t1, 'Founder') THEN f1 IS NULL AND f2 IS NULL ELSE list_sort(list_distinct([t1, t2])) = list_sort(list_distinct([f1, f2])) END AS matched FROM t""")
def q_unordered_match(spark, sf_dir):
    """Whether two parents are the right ones, in either order."""
    k = F.col("o_orderkey")
    t1 = F.when(k % 3 == 0, "Founder_1").otherwise(F.col("o_orderpriority"))
    f1 = F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    f2 = F.when(k % 2 == 0, F.col("o_orderpriority")).when(k % 5 > 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", genotype.unordered_match([t1, F.col("o_orderstatus")], [f1, f2]).alias("matched"))


_STEPS = "s AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), c AS (SELECT event_type AS i, nxt AS k, ln(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY event_type)) AS x FROM s WHERE nxt IS NOT NULL GROUP BY event_type, nxt)"


def _steps(spark, sf_dir):
    """(i, k, x): the log of the share of an event type's followers."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("i"), F.lead("event_type").over(w).alias("k")).filter("k is not null")
    n = s.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"))
    return n.select("i", "k", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("x"))


@query(f"WITH {_STEPS}, t AS (SELECT a.i, b.k AS j, a.x + b.x AS t FROM c a JOIN c b ON a.k = b.i) SELECT i, j, round(max(t) + ln(sum(exp(t - m))), 8) AS x FROM (SELECT *, max(t) OVER (PARTITION BY i, j) AS m FROM t) GROUP BY i, j")
def q_log_product(spark, sf_dir):
    """Chances of two steps between event types, in log space."""
    c = _steps(spark, sf_dir)
    return transitions.log_product(c, c.select(F.col("i").alias("k"), F.col("k").alias("j"), "x")).select("i", "j", F.round("x", 8).alias("x"))


@query(f"WITH {_STEPS} SELECT i, k, round(0.3 * exp(x) + 0.7 / 5, 8) AS p FROM c")
def q_smoothed_transitions(spark, sf_dir):
    """Transitions learnt at a rate of 0.3 from an even start."""
    c = _steps(spark, sf_dir).select("i", "k", F.exp("x").alias("p"))
    return transitions.smoothed(c.withColumn("p", F.lit(0.2)), c, ["i", "k"], 0.3).select("i", "k", F.round("p", 8).alias("p"))


@query("SELECT least(o_orderpriority, o_orderstatus) AS i, greatest(o_orderpriority, o_orderstatus) AS j, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY ALL")
def q_folded_matrix(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("i"), F.col("o_orderstatus").alias("j"), F.col("o_totalprice").alias("x"))
    return transitions.folded(m, "i", "j", "x").select("i", "j", F.round("x", 2).alias("x"))


@query("SELECT a.s_nationkey AS layer, a.s_suppkey AS h_from, b.s_suppkey AS h_to, round(1.0 / count(*) OVER (PARTITION BY a.s_nationkey, a.s_suppkey), 9) AS p FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey + 1")
def q_even_transitions(spark, sf_dir):
    """Edges between suppliers of successive nations, of equal chance."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    return transitions.even_transitions(s, [], "s_nationkey", "s_suppkey").select("layer", "h_from", "h_to", F.round("p", 9).alias("p"))
