"""Queries over panels of haplotypes and comparisons with the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype
from ..operators import panels, validation
from .paths import FOUNDERS, cells, founder_alleles
from .registry import query
from .tables import MARKS, marks, table

_TRUE = "tru AS (SELECT label, vec_id % 3 AS hap, generate_subscripts(embedding, 1) - 1 AS site, unnest(embedding) AS x FROM embeddings), truth AS (SELECT label, hap, site, CASE WHEN avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) >= 0.5 THEN 1 ELSE 0 END AS allele FROM tru GROUP BY label, hap, site)"
_DISTANCE = f"{FOUNDERS}, {_TRUE}, di AS (SELECT f.label, f.hap AS a, t.hap AS b, count(*) AS sites, 100 * avg(CASE WHEN f.allele <> t.allele THEN 1.0 ELSE 0 END) AS percent FROM founders f JOIN truth t USING (label, site) GROUP BY f.label, f.hap, t.hap)"


def _truth(spark, sf_dir):
    """(label, hap, site, allele): three other panels' founders, by the remainders of the ids."""
    x = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("hap"), F.posexplode("embedding").alias("site", "x"))
    return x.groupBy("label", "hap", "site").agg((F.avg((F.col("x") > 0).cast("double")) >= 0.5).cast("int").alias("allele"))


def _distances(spark, sf_dir):
    return validation.distances(founder_alleles(spark, sf_dir), _truth(spark, sf_dir), ["label"], "site", "allele")


@query(f"""WITH {_DISTANCE}, x AS (SELECT label, 'found' AS side, a AS hap, b AS best, percent FROM di UNION ALL SELECT label, 'true', b, a, percent FROM di)
SELECT label, side, hap, best, round(percent, 6) AS percent, percent < 25 AS found FROM x QUALIFY row_number() OVER (PARTITION BY label, side, hap ORDER BY percent, best) = 1""")
def q_best_match(spark, sf_dir):
    """The nearest haplotype of the other panel to each, in both directions."""
    d = _distances(spark, sf_dir)
    one = validation.best_match(d, ["label"], "a", "b", 25.0).select("label", F.lit("found").alias("side"), F.col("a").cast("long").alias("hap"), F.col("best").cast("long").alias("best"), "percent", "found")
    two = validation.best_match(d, ["label"], "b", "a", 25.0).select("label", F.lit("true").alias("side"), F.col("b").alias("hap"), F.col("best").cast("long").alias("best"), "percent", "found")
    return one.unionByName(two).withColumn("percent", F.round("percent", 6))


@query(f"""WITH RECURSIVE {_DISTANCE}, p AS (SELECT label, a, b, row_number() OVER (PARTITION BY label ORDER BY percent, a, b) AS i FROM di),
r(label, i, froms, tos) AS (SELECT label, i, [a], [b] FROM p WHERE i = 1 UNION ALL SELECT p.label, p.i, CASE WHEN list_contains(froms, a) OR list_contains(tos, b) THEN froms ELSE list_append(froms, a) END, CASE WHEN list_contains(froms, a) OR list_contains(tos, b) THEN tos ELSE list_append(tos, b) END FROM r JOIN p ON p.label = r.label AND p.i = r.i + 1),
l AS (SELECT label, unnest(froms) AS a, unnest(tos) AS b FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1)) SELECT d.label, d.a, l.b FROM (SELECT DISTINCT label, a FROM di) d LEFT JOIN l USING (label, a)""")
def q_bijection(spark, sf_dir):
    """One true haplotype at most for each that was found, the best pairs first."""
    d = _distances(spark, sf_dir).withColumn("agreement", -F.col("percent"))
    return validation.bijection(d, {"label": "int"}, "a", "b", "agreement")


@query("""WITH t AS (SELECT l_suppkey, l_partkey % 2 AS t1, l_orderkey % 2 AS t2, l_linenumber % 2 AS f1, l_partkey % 2 AS f2 FROM lineitem)
SELECT l_suppkey, count(*) AS n, count_if(t1 = f1 AND t2 = f2)::BIGINT AS direct, count_if(t1 = f2 AND t2 = f1)::BIGINT AS flipped, CASE WHEN count_if(t1 = f1 AND t2 = f2) >= count_if(t1 = f2 AND t2 = f1) THEN 'direct' ELSE 'flipped' END AS dominant,
round(avg(((t1 = f1 AND t2 = f2) OR (t1 = f2 AND t2 = f1))::INT), 7) AS accuracy FROM t GROUP BY l_suppkey""")
def q_phase_accuracy(spark, sf_dir):
    c = F.col
    found = validation.phase_accuracy(table(spark, sf_dir, "lineitem"), ["l_suppkey"], c("l_partkey") % 2, c("l_orderkey") % 2, c("l_linenumber") % 2, c("l_partkey") % 2)
    return found.withColumn("accuracy", F.round("accuracy", 7))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS x, l_linenumber AS y FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS x, l_linenumber AS y FROM lineitem WHERE l_linestatus = 'O')
SELECT *, 1 AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 2 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def q_pair_difference(spark, sf_dir):
    """Pairs that only returned lines have, and that only open ones have."""
    rows = lambda where: table(spark, sf_dir, "lineitem").filter(where).select(F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("y"))
    return validation.difference(rows("l_returnflag = 'R'"), rows("l_linestatus = 'O'"))


@query("""SELECT c_custkey, c_acctbal, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def q_one_to_one(spark, sf_dir):
    """Customers with their nations, where the nation is of the first three regions; nations are unique, customers are keyed by themselves."""
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    keyed = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("k"))
    small = keyed.join(n, "k", "left").select(F.col("c_custkey").alias("k"), "n_name", "n_regionkey")
    return validation.one_to_one(keyed.select(F.col("c_custkey").alias("k"), "c_acctbal"), small, ["k"]).select(F.col("k").alias("c_custkey"), "c_acctbal", "n_name", "n_regionkey")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, concat_ws('+', o_orderstatus, o_orderpriority) AS label, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS class FROM orders""")
def q_lookup_labels(spark, sf_dir):
    """A looked-up name (none for other statuses), a joined label, and a class of three."""
    o = validation.looked_up(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": "filled", "O": "open"}, "status")
    kind = F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_totalprice") < 200000, "middle").otherwise("high")
    return o.select("o_orderkey", "status", F.concat_ws("+", "o_orderstatus", "o_orderpriority").alias("label"), kind.alias("class"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey % 3 AS x FROM orders), i AS (SELECT l_orderkey AS k, max(l_linenumber) % 3 AS x, max(l_returnflag) AS mode FROM lineitem GROUP BY l_orderkey)
SELECT mode, count(*) AS n, round(avg((t.x = i.x)::INT), 7) AS accuracy, round(avg(CASE WHEN t.x > 0 THEN (t.x = i.x)::INT END), 7) AS accuracy_of_some FROM t JOIN i USING (k) GROUP BY mode""")
def q_conditional_accuracy(spark, sf_dir):
    """The share of orders that are right, of all and of those of the later generations, by return flag."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("x_true"))
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_linenumber") % 3).alias("x_found"), F.max("l_returnflag").alias("mode"))
    right = (F.col("x_true") == F.col("x_found")).cast("double")
    return t.join(i, "k").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 7).alias("accuracy"), F.round(F.avg(F.when(F.col("x_true") > 0, right)), 7).alias("accuracy_of_some"))


@query("""WITH b AS (SELECT l_returnflag || l_linestatus AS stage, l_partkey AS block, avg(l_discount) AS error, min(l_tax) > 0.005 AS whole FROM lineitem GROUP BY 1, 2)
SELECT stage, count(*) AS blocks, round(avg(error), 6) AS error, round(100 * avg(whole::INT), 4) AS percent_whole FROM b GROUP BY stage""")
def q_stage_summary(spark, sf_dir):
    """By stage, the mean error of its blocks, and the percentage of them that are found whole."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("stage"), F.col("l_partkey").alias("block")).agg(F.avg("l_discount").alias("error"), (F.min("l_tax") > 0.005).alias("whole"))
    return b.groupBy("stage").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("error"), 6).alias("error"), F.round(100 * F.avg(F.col("whole").cast("double")), 4).alias("percent_whole"))


_ROWS = f"{FOUNDERS}, {_TRUE}, al AS (SELECT label, hap, site, allele FROM founders UNION ALL SELECT label, hap + 10, site, allele FROM truth UNION ALL SELECT label, hap + 20, site, allele FROM founders), pk AS (SELECT label, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY site) AS w FROM al GROUP BY label, hap)"


def _rows(spark, sf_dir):
    """Both panels' haplotypes over all sites, and the first panel's under other numbers, so that some are equal."""
    one = founder_alleles(spark, sf_dir)
    both = one.unionByName(_truth(spark, sf_dir).withColumn("hap", F.col("hap") + 10)).unionByName(one.withColumn("hap", F.col("hap") + 20))
    return panels.packed(both, ["label"], "hap", "site", "allele").select("label", F.col("hap").cast("long").alias("hap"), "row")


@query(f'WITH {_ROWS} SELECT label, hap, w AS "row", CAST(dense_rank() OVER (PARTITION BY label ORDER BY w) - 1 AS INT) AS canonical FROM pk')
def q_canonical_panel(spark, sf_dir):
    """A label's distinct haplotypes, numbered in the order of their alleles."""
    return panels.canonical(_rows(spark, sf_dir), ["label"], "hap")


@query(f"""WITH {_ROWS}, c AS (SELECT label, hap, CAST(dense_rank() OVER (PARTITION BY label ORDER BY w) - 1 AS INT) AS k FROM pk), p AS (SELECT vec_id, label, vec_id % 3 + 10 AS a, (vec_id // 3) % 3 + 10 AS b FROM embeddings)
SELECT vec_id, p.label, least(x.k, y.k) AS a, greatest(x.k, y.k) AS b FROM p JOIN c x ON x.label = p.label AND x.hap = a JOIN c y ON y.label = p.label AND y.hap = b""")
def q_canonical_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3 + 10).alias("a"), (F.floor(F.col("vec_id") / 3) % 3 + 10).alias("b"))
    numbers = panels.canonical(_rows(spark, sf_dir), ["label"], "hap")
    return panels.canonical_pairs(p, numbers, ["label"], "a", "b", "hap").select("vec_id", "label", "a", "b")


@query(None)
def q_panel_duplicates(spark, sf_dir):
    """A label's haplotypes of both panels without near duplicates; of such the sharper one stays."""
    both = founder_alleles(spark, sf_dir).unionByName(_truth(spark, sf_dir).withColumn("hap", F.col("hap") + 10))
    rows = panels.packed(both, ["label"], "hap", "site", "allele").withColumn("sharpness", F.pmod(F.crc32("row"), F.lit(1000)) / 1000)
    return panels.without_duplicates(rows.withColumn("hap", F.col("hap").cast("long")), {"label": "int"}, "hap", 20.0)


_P = f"{FOUNDERS}, q AS (SELECT label, (CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END) + (CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END) AS hap, site, avg(p1 / 2 + p2) AS p FROM posts JOIN embeddings USING (vec_id, label) GROUP BY 1, 2, 3)"


def _chances(spark, sf_dir):
    e = cells(spark, sf_dir)
    first = table(spark, sf_dir, "embeddings").select("vec_id", (F.when(F.get("embedding", F.lit(0)) > 0, 2).otherwise(0) + F.when(F.get("embedding", F.lit(1)) > 0, 1).otherwise(0)).alias("hap"))
    return e.join(first, "vec_id").groupBy("label", "hap", "site").agg(F.avg(genotype.alt_fraction([F.col(f"p{i}") for i in range(3)])).alias("p"))


@query(f"""WITH {_P}, s AS (SELECT u.label, u.hap AS a, v.hap AS b, avg(u.p * v.p + (1 - u.p) * (1 - v.p)) AS s FROM q u JOIN q v USING (label, site) GROUP BY u.label, u.hap, v.hap)
SELECT s.label, s.a, s.b, round(s.s / sqrt(x.s * y.s), 7) AS similarity FROM s JOIN s x ON x.label = s.label AND x.a = s.a AND x.b = s.a JOIN s y ON y.label = s.label AND y.a = s.b AND y.b = s.b""")
def q_panel_similarity(spark, sf_dir):
    """The mean chance of equal alleles of two founders of a label, over that of each with itself."""
    return panels.similarity(_chances(spark, sf_dir), ["label"], "hap", "site", "p").withColumn("similarity", F.round("similarity", 7))


@query(f"""WITH {_P}, t AS (SELECT u.label, u.site, u.hap AS h1, v.hap AS h2, (1 - u.p) * (1 - v.p) AS p0, u.p * (1 - v.p) + v.p * (1 - u.p) AS p1, u.p * v.p AS p2 FROM q u JOIN q v ON u.label = v.label AND u.site = v.site AND u.hap <= v.hap)
SELECT label, h1, h2, round(sum(p1 + 2 * p2), 5) AS dosage, round(avg(p0), 7) AS none FROM t GROUP BY label, h1, h2""")
def q_pair_chances(spark, sf_dir):
    t = panels.pair_chances(_chances(spark, sf_dir), ["label"], "site", "p")
    return t.groupBy("label", "h1", "h2").agg(F.round(F.sum(F.col("p1") + 2 * F.col("p2")), 5).alias("dosage"), F.round(F.avg("p0"), 7).alias("none"))


_USED = "u AS (SELECT l_suppkey AS sample, CAST(l_orderkey % 6 AS INT) AS block, l_partkey % 4 AS h1, l_linenumber % 4 AS h2 FROM lineitem), e AS (SELECT sample, block, unnest(list_distinct([h1, h2])) AS hap FROM u), d AS (SELECT DISTINCT sample, block, hap FROM e), c AS (SELECT x.block, x.hap AS a, y.hap AS b, count(*) AS samples FROM d x JOIN d y ON x.sample = y.sample AND y.block = x.block + 1 GROUP BY 1, 2, 3)"


def _used(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_orderkey") % 6).cast("int").alias("block"), F.explode(F.array_distinct(F.array(F.col("l_partkey") % 4, (F.col("l_linenumber") % 4).cast("long")))).alias("hap"))
    return panels.successors(u.distinct().withColumn("other", F.col("hap")), "sample", "block", ["hap", "other"])


@query(f"WITH {_USED} SELECT block, a, b, samples FROM c")
def q_relative_usage(spark, sf_dir):
    """How many suppliers have one haplotype in a block and another in the next."""
    return _used(spark, sf_dir)


@query(f"""WITH {_USED}, s AS (SELECT block, a, b, coalesce(samples, 0) AS n FROM (SELECT DISTINCT block, a FROM c) JOIN (SELECT DISTINCT block, b FROM c) USING (block) LEFT JOIN c USING (block, a, b))
SELECT block, a, b, round(100 * pow(least(1.0, 2.0 * n / sum(n) OVER (PARTITION BY block, a)), 2), 6) AS forward, round(100 * pow(least(1.0, 2.0 * n / sum(n) OVER (PARTITION BY block, b)), 2), 6) AS backward FROM s""")
def q_usage_score(spark, sf_dir):
    """How far a block's haplotypes and the next one's belong together, by the samples that have both."""
    s = panels.usage_score(_used(spark, sf_dir), "block")
    return s.select("block", "a", "b", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"))


@query(f"""WITH {FOUNDERS}, b AS (SELECT k AS block, label * 10 + hap AS hap, site, allele FROM founders, range(0, 6) r(k) WHERE site >= 10 * k AND site < 10 * k + CASE WHEN k = 3 THEN 10 ELSE 14 END),
m AS (SELECT x.block, x.hap AS a, y.hap AS b, avg((x.allele = y.allele)::INT) AS score FROM b x JOIN b y ON y.block = x.block + 1 AND x.site = y.site GROUP BY 1, 2, 3)
SELECT block, a, b, round(coalesce(score, 1.0), 7) AS score FROM (SELECT DISTINCT block, hap AS a FROM b) JOIN (SELECT DISTINCT block - 1 AS block, hap AS b FROM b) USING (block) LEFT JOIN m USING (block, a, b)""")
def q_overlap_score(spark, sf_dir):
    """Founders of neighbouring blocks of sites by their alleles where the blocks overlap; the fourth block has no overlap with the fifth."""
    f = founder_alleles(spark, sf_dir).select((F.col("label") * 10 + F.col("hap")).alias("hap"), "site", "allele", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("block"))
    size = F.when(F.col("block") == 3, 10).otherwise(14)
    rows = f.filter((F.col("site") >= 10 * F.col("block")) & (F.col("site") < 10 * F.col("block") + size))
    return panels.overlap_score(rows, "block", "hap", "site", "allele").withColumn("score", F.round("score", 7))


@query("""WITH s AS (SELECT l_suppkey AS sample, l_partkey % 3 AS h1, l_linenumber % 3 AS h2, round(sum(l_discount), 6) AS x, round(sum(l_tax), 6) AS y FROM lineitem GROUP BY ALL),
a AS (SELECT sample, [least(h1, h2), greatest(h1, h2)] AS p FROM s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY x DESC, h1, h2) = 1), b AS (SELECT sample, [least(h1, h2), greatest(h1, h2)] AS p FROM s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY y DESC, h1, h2) = 1)
SELECT sample, a.p[1] * 10 + a.p[2] AS at_start, b.p[1] * 10 + b.p[2] AS at_end, a.p <> b.p AS switched FROM a JOIN b USING (sample)""")
def q_intra_block_switches(spark, sf_dir):
    """Suppliers whose best pair differs from a block's start to its end."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 3).alias("h1"), (F.col("l_linenumber") % 3).cast("long").alias("h2")).agg(F.round(F.sum("l_discount"), 6).alias("x"), F.round(F.sum("l_tax"), 6).alias("y"))
    found = panels.intra_block_switches(s, ["sample"], "x", "y", "h1", "h2")
    code = lambda c: F.get(c, F.lit(0)) * 10 + F.get(c, F.lit(1))
    return found.select("sample", code("at_start").alias("at_start"), code("at_end").alias("at_end"), "switched")


@query("""SELECT l_suppkey AS founder, l_linenumber AS site, count(*) AS votes, CASE WHEN count(*) >= 60 THEN round(avg((l_returnflag = 'R')::INT), 7) END AS confidence FROM lineitem GROUP BY 1, 2""")
def q_site_confidence(spark, sf_dir):
    """The share of a founder's carriers that agree at a site; none where too few vote."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("founder"), F.col("l_linenumber").alias("site"), (F.col("l_returnflag") == "R").alias("yes"))
    return panels.supported_share(v, ["founder", "site"], F.col("yes"), 60).withColumn("confidence", F.round("confidence", 7))


@query("SELECT hap, round(sum(w), 6) AS support FROM (SELECT l_partkey % 50 AS hap, l_suppkey, max(l_discount) AS w FROM lineitem GROUP BY 1, 2) GROUP BY hap")
def q_effective_support(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("hap"), "l_suppkey", "l_discount")
    return panels.effective_support(r, ["hap"], "l_suppkey", "l_discount").withColumn("support", F.round("support", 6))


@query("""WITH r AS (SELECT DISTINCT o_custkey % 200 AS s, o_orderkey % 500 AS m FROM orders), n AS (SELECT s, count(*) AS n FROM r GROUP BY s)
SELECT x.s AS a, y.s AS b, round(count(*) / min(least(p.n, q.n)), 7) AS overlap FROM r x JOIN r y ON x.m = y.m AND x.s < y.s JOIN n p ON p.s = x.s JOIN n q ON q.s = y.s GROUP BY x.s, y.s""")
def q_set_overlap(spark, sf_dir):
    """The members that two sets share, over the smaller."""
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("s"), (F.col("o_orderkey") % 500).alias("m"))
    return panels.set_overlap(r, [], "s", "m").withColumn("overlap", F.round("overlap", 7))


@query(f"""WITH {MARKS}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY user_id) / 10.0) AS BIGINT) AS s FROM marks) SELECT user_id, event_id FROM r WHERE i % s = 0""")
def q_strided_proxy(spark, sf_dir):
    """Every s-th event of a user, ten at most."""
    return panels.strided(marks(spark, sf_dir), ["user_id"], ["pos", "event_id"], 10).select("user_id", "event_id")


@query(None)
def q_diverse_beam(spark, sf_dir):
    """Eight vectors of each label that are far out and unlike each other."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))).alias("score"), F.transform("embedding", lambda x: (x > 0).cast("long")).alias("signs"))
    return panels.diverse_beam(v, {"label": "int"}, "vec_id", "score", "signs", 8, 0.7)
