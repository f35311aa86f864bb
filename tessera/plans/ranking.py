"""Queries over ranks, utilities, supports and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resample, windows
from .registry import query
from .tables import MARKS, marks, table

SEED, REPLICATES = 104729, 200


@query("SELECT s_suppkey, s_nationkey, round(CASE WHEN count(*) OVER w < 2 THEN 1 ELSE 1 - (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1.0) / (count(*) OVER w - 1) END, 9) AS vote FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def q_rank_votes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.round(windows.rank_votes(["s_nationkey"], "s_acctbal", ["s_suppkey"]), 9).alias("vote"))


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, count(*) OVER (PARTITION BY p_brand) AS n, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS mean FROM part)
SELECT p_partkey, p_brand, round(CASE WHEN n < 2 THEN 1.0 ELSE (n - mean) / (n * (n - 1) / 2.0) END, 9) AS share FROM r""")
def q_tied_rank(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round(windows.tied_rank(["p_brand"], "p_size"), 9).alias("share"))


_SCORES = "scores AS (SELECT o_orderpriority AS contig, c_nationkey AS child, o_orderstatus AS pair, avg(o_totalprice) / 20000 AS score, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _scores(spark, sf_dir):
    """(contig, child, pair, score, n): by priority, nation and status."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("contig"), F.col("c_nationkey").alias("child"), F.col("o_orderstatus").alias("pair")).agg((F.avg("o_totalprice") / 20000).alias("score"), F.count(F.lit(1)).alias("n"))


_UTILITIES = _SCORES + """, u AS (SELECT *, 0.9 * (CASE WHEN count(*) OVER w < 2 THEN 1 ELSE 1 - (row_number() OVER (PARTITION BY contig, child ORDER BY score DESC, pair) - 1.0) / (count(*) OVER w - 1) END)
 + 0.1 * (0.9 * exp(score / 2 - max(score / 2) OVER w) / s + 0.1 / count(*) OVER w) AS utility FROM (SELECT *, sum(exp(score / 2 - m)) OVER (PARTITION BY contig, child) AS s FROM (SELECT *, max(score / 2) OVER (PARTITION BY contig, child) AS m FROM scores)) WINDOW w AS (PARTITION BY contig, child))"""


def _utilities(spark, sf_dir):
    """Nine tenths of the rank vote and one tenth of a tempered share."""
    keys = ["contig", "child"]
    u = 0.9 * windows.rank_votes(keys, "score", ["pair"]) + 0.1 * windows.tempered(keys, "score", F.lit(2.0), 0.1)
    return _scores(spark, sf_dir).withColumn("utility", u)


@query(f"WITH {_UTILITIES} SELECT contig, child, pair, round(utility, 7) AS utility FROM u")
def q_margin_utility(spark, sf_dir):
    return _utilities(spark, sf_dir).select("contig", "child", "pair", F.round("utility", 7).alias("utility"))


@query(f"""WITH {_UTILITIES}, t AS (SELECT child, pair, sum(utility) AS total, count(*) AS n FROM u GROUP BY ALL), l AS (SELECT u.contig, u.child, u.pair, (total - utility) / (t.n - 1) AS mean FROM u JOIN t USING (child, pair) WHERE t.n > 1)
SELECT contig, child, pair, round(mean, 7) AS mean FROM l QUALIFY row_number() OVER (PARTITION BY contig, child ORDER BY round(mean, 9) DESC, pair) = 1""")
def q_loco_winner(spark, sf_dir):
    """The pair of the highest mean utility over the other contigs, for each left out."""
    out = _utilities(spark, sf_dir).withColumn("mean", windows.left_out_mean(["child", "pair"], "utility")).filter("mean is not null")
    first = Window.partitionBy("contig", "child").orderBy(F.round("mean", 9).desc(), "pair")
    return out.withColumn("__row", F.row_number().over(first)).filter("__row = 1").select("contig", "child", "pair", F.round("mean", 7).alias("mean"))


@query(f"""WITH {MARKS}, s AS (SELECT user_id, event_type, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM marks GROUP BY user_id, event_type),
c AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY user_id ORDER BY share DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT user_id, string_agg(event_type || ':' || printf('%.3f', round(share, 3)), ';' ORDER BY share DESC, event_type) AS support, count(*) AS n_support FROM c WHERE before < 0.7 GROUP BY user_id""")
def q_support_set(spark, sf_dir):
    """A user's likeliest types up to a share of 0.7."""
    counts = marks(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return windows.support(shares, ["user_id"], "event_type", "share", 0.7)


def _index_values(units: int) -> str:
    return ", ".join(f"({r}, {u}, {n})" for r, u, n in resample.multiplicities(units, REPLICATES, SEED))


_COMPONENTS = "components AS (SELECT o_custkey % 22 AS unit, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS exposure FROM orders GROUP BY 1)"


def _components(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 22).cast("int").alias("unit")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count(F.lit(1)).alias("exposure"))


@query(f"""WITH {_COMPONENTS}, i(replicate, unit, times) AS (VALUES {_index_values(22)}), r AS (SELECT replicate, sum(hits * times) / sum(exposure * times) AS rate FROM components JOIN i USING (unit) GROUP BY replicate)
SELECT (SELECT round(sum(hits) / sum(exposure), 9) FROM components) AS rate, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high FROM r""")
def q_bootstrap_ci(spark, sf_dir):
    """A rate over 22 units and its bootstrap bounds."""
    found = resample.rate_interval(_components(spark, sf_dir), "unit", "hits", "exposure", resample.index_table(spark, 22, REPLICATES, SEED))
    return found.select(*[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])


@query(f"""WITH {_UTILITIES}, v AS (SELECT *, dense_rank() OVER (ORDER BY contig) - 1 AS unit FROM u), i(replicate, unit, times) AS (VALUES {_index_values(5)}),
m AS (SELECT replicate, child, pair, round(sum(utility * times) / sum(times), 9) AS mean FROM v JOIN i USING (unit) GROUP BY ALL), w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY replicate, child ORDER BY mean DESC, pair) = 1)
SELECT child, pair, count(*) AS wins FROM w GROUP BY ALL""")
def q_bootstrap_winners(spark, sf_dir):
    """How often each pair wins a child over resampled contigs."""
    u = _utilities(spark, sf_dir)
    contigs = u.select("contig").distinct().withColumn("unit", (F.dense_rank().over(Window.orderBy("contig")) - 1).cast("int"))
    u = u.join(F.broadcast(contigs), "contig").withColumn("utility", F.round("utility", 12))
    drawn = resample.winners(u, ["child"], "pair", "unit", "utility", resample.index_table(spark, 5, REPLICATES, SEED))
    return drawn.select("child", "pair", "wins")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value) / sqrt(count(*)), 0), 6) AS sem, round(avg(value) - 1.96 * coalesce(stddev_samp(value) / sqrt(count(*)), 0), 6) AS low, round(avg(value) + 1.96 * coalesce(stddev_samp(value) / sqrt(count(*)), 0), 6) AS high FROM events GROUP BY event_type""")
def q_group_mean_ci(spark, sf_dir):
    sem = F.coalesce(F.stddev_samp("value") / F.sqrt(F.count(F.lit(1))), F.lit(0.0))
    mean = F.avg("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean"), F.round(sem, 6).alias("sem"), F.round(mean - 1.96 * sem, 6).alias("low"), F.round(mean + 1.96 * sem, 6).alias("high"))


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2""")
def q_top_two(spark, sf_dir):
    first = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("__row", F.row_number().over(first)).filter("__row <= 2").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_topn(spark, sf_dir):
    """The twenty dearest orders."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")
