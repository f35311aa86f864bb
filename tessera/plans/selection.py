"""Queries over triangles of founders' pairs, maximum cuts, and founders chosen from a pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts, density, graph, phase, subset, triangles
from .panels import _TRUE, _truth
from .paths import FOUNDERS, cells, founder_alleles
from .registry import query
from .tables import table

_POOL = f"{FOUNDERS}, {_TRUE}, pool AS (SELECT label, hap, site, allele FROM founders UNION ALL SELECT label, hap + 4, site, allele FROM truth)"


def _pool(spark, sf_dir):
    """(label, hap, site, allele): a label's founders of both panels, seven at most."""
    both = founder_alleles(spark, sf_dir).select("label", F.col("hap").cast("long").alias("hap"), "site", "allele")
    return both.unionByName(_truth(spark, sf_dir).select("label", (F.col("hap") + 4).cast("long").alias("hap"), "site", "allele"))


_PAIRS = f"""WITH {_POOL}, h AS (SELECT label, hap, list(allele ORDER BY site) AS w FROM pool GROUP BY label, hap),
g AS (SELECT x.label, x.hap * 10 + y.hap AS g, [CASE WHEN (i + x.hap * 7 + y.hap) % 40 = 0 THEN 2 ELSE x.w[i] + y.w[i] END FOR i IN range(1, len(x.w) + 1)] AS d FROM h x JOIN h y ON x.label = y.label AND x.hap < y.hap),
b AS (SELECT label, g, d, list_sum([CASE WHEN d[i] = 1 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END FOR i IN range(1, len(d) + 1)])::HUGEINT AS w FROM g),
t AS (SELECT a.label, a.g AS g1, b.g AS g2, c.g AS g3, bit_count(xor(xor(a.w, b.w), c.w))::INT AS differ, a.d AS d1, b.d AS d2, c.d AS d3 FROM b a JOIN b ON a.label = b.label AND a.g < b.g AND bit_count(xor(a.w, b.w)) > 3
  JOIN b c ON c.label = b.label AND b.g < c.g AND bit_count(xor(a.w, c.w)) > 3 AND bit_count(xor(b.w, c.w)) > 3 WHERE bit_count(xor(xor(a.w, b.w), c.w)) <= 6)"""


def _groups(spark, sf_dir):
    """(label, g, dosage, bits): pairs of a label's founders as groups, with a few wrong dosages, and where they are heterozygous."""
    h = _pool(spark, sf_dir).groupBy("label", "hap").agg(F.transform(F.array_sort(F.collect_list(F.struct("site", "allele"))), lambda c: c["allele"]).alias("w"))
    met = h.select("label", F.col("hap").alias("a"), F.col("w").alias("wa")).join(h.select("label", F.col("hap").alias("b"), F.col("w").alias("wb")), "label").filter("a < b")
    wrong = lambda i: F.pmod(i + 1 + F.col("a") * 7 + F.col("b"), F.lit(40)) == 0
    both = F.transform(F.zip_with("wa", "wb", lambda x, y: x + y), lambda d, i: F.when(wrong(i), 2).otherwise(d))
    return met.select("label", (F.col("a") * 10 + F.col("b")).alias("g"), both.alias("dosage")).withColumn("bits", F.transform("dosage", lambda d: (d == 1).cast("int")))


@query(f"{_PAIRS} SELECT label, g1, g2, g3, differ FROM t")
def q_xor_triangles(spark, sf_dir):
    """Three pairs of a label's founders, each of which is nearly what the other two don't share."""
    return triangles.xor_triangles(_groups(spark, sf_dir), ["label"], "g", "bits", 6, 3)


@query(f"""{_PAIRS}, s AS (SELECT label, unnest([d1, d2, d3]) AS d, [(d1[i] + d2[i] + d3[i]) // 2 FOR i IN range(1, len(d1) + 1)] AS half FROM t)
SELECT label, array_to_string([least(greatest(half[i] - d[i], 0), 1)::INT FOR i IN range(1, len(d) + 1)], '') AS hap, count(*) AS support FROM s GROUP BY 1, 2""")
def q_triangle_haplotypes(spark, sf_dir):
    """The haplotypes that triangles of pairs give back, and from how many triangles each comes."""
    g = graph.written(_groups(spark, sf_dir))
    found = triangles.shared(triangles.xor_triangles(g, ["label"], "g", "bits", 6, 3), g, ["label"], "g", "dosage")
    return found.select("label", F.concat_ws("", F.transform("hap", lambda x: x.cast("string"))).alias("hap"), "support")


_CUTS = """, u AS (SELECT g, a, b, count(*) AS weight FROM w WHERE a < b GROUP BY ALL), n AS (SELECT g, list(x ORDER BY x) AS nodes FROM (SELECT g, a AS x FROM u UNION SELECT g, b FROM u) GROUP BY g),
c AS (SELECT g, nodes, unnest(range(1, (1::BIGINT << (len(nodes) - 1)::INT)))::BIGINT * 2 AS s FROM n),
k AS (SELECT c.g, c.s, any_value(nodes) AS nodes, sum(CASE WHEN (s >> (list_position(nodes, a) - 1)::INT) & 1 <> (s >> (list_position(nodes, b) - 1)::INT) & 1 THEN weight ELSE 0 END)::BIGINT AS across, sum(weight)::BIGINT AS total FROM c JOIN u USING (g) GROUP BY c.g, c.s),
best AS (SELECT g, across, total - across AS within, [nodes[i] FOR i IN range(1, len(nodes) + 1) IF (s >> (i - 1)::INT) & 1 = 1] AS side FROM k QUALIFY across = max(across) OVER (PARTITION BY g))"""
_USED = "WITH w AS (SELECT l_returnflag || l_linestatus AS g, least(l_suppkey % 10, l_partkey % 10) AS a, greatest(l_suppkey % 10, l_partkey % 10) AS b FROM lineitem)"


@query(f"{_USED}{_CUTS} SELECT g AS kind, array_to_string(side, ',') AS side, across, within FROM best")
def q_maximum_cuts(spark, sf_dir):
    """Ten suppliers' and parts' classes that lines pair, cut in two so that most pairs lie across: for each kind of line."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.col("l_suppkey") % 10).alias("x"), (F.col("l_partkey") % 10).alias("y"))
    found = cuts.maximum_cuts(cuts.pair_weights(pairs, ["kind"], "x", "y"), ["kind"])
    return found.withColumn("side", F.concat_ws(",", F.transform("side", lambda x: x.cast("string"))))


@query(None)
def q_improved_cut(spark, sf_dir):
    """Suppliers and parts of returned lines in two sides, so that no change of one brings more pairs across."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return cuts.improved_cut(cuts.pair_weights(lines, [], "a", "b"), [], graph.written)


_GAUGE = f"""WITH {_POOL}, v AS (SELECT vec_id, label, vec_id % 4 AS a, (vec_id // 4) % 4 AS b FROM embeddings), w AS (SELECT label AS g, least(a, b) AS a, greatest(a, b) AS b FROM v){_CUTS},
o AS (SELECT label, side, site, min(allele) FILTER (NOT list_contains(side, hap)) AS n0, max(allele) FILTER (NOT list_contains(side, hap)) AS n1, min(allele) FILTER (list_contains(side, hap)) AS f0, max(allele) FILTER (list_contains(side, hap)) AS f1 FROM pool JOIN best ON g = label WHERE hap < 4 GROUP BY 1, 2, 3),
q AS (SELECT label, side, site, n0 AS own FROM o WHERE n0 = n1 AND f0 = f1 AND n0 <> f0),
i AS (SELECT q.label, q.side, q.site, x.allele + y.allele AS d, p0, p1, p2 FROM q JOIN v USING (label) JOIN pool x ON x.label = v.label AND x.hap = v.a AND x.site = q.site JOIN pool y ON y.label = v.label AND y.hap = v.b AND y.site = q.site JOIN posts p ON p.vec_id = v.vec_id AND p.site = q.site WHERE list_contains(side, v.a) = list_contains(side, v.b)),
l AS (SELECT label, side, site, sum(-ln(greatest(CASE d WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-12))) AS before, sum(-ln(greatest(CASE d WHEN 0 THEN p2 WHEN 1 THEN p1 ELSE p0 END, 1e-12))) AS after FROM i GROUP BY 1, 2, 3)"""


@query(f"{_GAUGE} SELECT q.label, array_to_string(q.side, ',') AS side, q.site, own, round(coalesce(before, 0), 4) AS before, round(coalesce(after, 0), 4) AS after, coalesce(after < before - 1e-9, false) AS turned FROM q LEFT JOIN l USING (label, side, site)")
def q_open_sites(spark, sf_dir):
    """Sites at which a label's founders differ by the sides of its maximum cut alone, and whether vectors with both founders on one side would have them exchanged."""
    x = graph.written(cells(spark, sf_dir))
    panel = graph.written(_pool(spark, sf_dir).filter("hap < 4"))
    pairs = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") % 4).alias("a"), F.expr("vec_id div 4 % 4").alias("b"))
    open_ = graph.written(cuts.open_sites(panel, cuts.maximum_cuts(cuts.pair_weights(pairs, ["label"], "a", "b"), ["label"]), ["label"], "hap", "site", "allele"))
    found = cuts.turned_sites(open_, panel, pairs, x.select("label", "vec_id", "site", "p0", "p1", "p2"), ["label"], "vec_id", "site")
    return found.withColumns({"side": F.concat_ws(",", F.transform("side", lambda x: x.cast("string"))), "before": F.round("before", 4), "after": F.round("after", 4)})


#: A haplotype's cost is SCALE * sites / 200 * samples: such that some of a label's seven pay for themselves and some don't.
SCALE = 40.0
_SUBSETS = f"""WITH {_POOL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
s AS (SELECT *, ln(greatest(p0, 1e-12)) AS l0, ln(greatest(p1, 1e-12)) AS l1, ln(greatest(p2, 1e-12)) AS l2 FROM posts),
r AS (SELECT s.vec_id, s.label, x.hap AS a, y.hap AS b, -sum(CASE x.allele + y.allele WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END) AS loss FROM s JOIN pool x USING (label, site) JOIN pool y USING (label, site) WHERE x.hap <= y.hap GROUP BY ALL
UNION ALL SELECT vec_id, label, x.hap, NULL, 0.5 * count(*) - sum(CASE x.allele WHEN 0 THEN greatest(l0, l1) ELSE greatest(l1, l2) END) FROM s JOIN pool x USING (label, site) GROUP BY ALL
UNION ALL SELECT vec_id, label, NULL, NULL, count(*) - sum(greatest(l0, l1, l2)) FROM s GROUP BY ALL),
c AS (SELECT r.label, k, r.vec_id, min(loss) AS loss FROM r, range(0, 128) z(k) WHERE (a IS NULL OR (k >> a::INT) & 1 = 1) AND (b IS NULL OR (k >> b::INT) & 1 = 1) GROUP BY ALL),
t AS (SELECT label, k, sum(loss) AS loss, bit_count(k) * {SCALE} * 64 / 200 * any_value(n) + 2 * sum(loss) AS bic FROM c JOIN n USING (label) WHERE NOT EXISTS (SELECT 1 FROM range(0, 7) q(h) WHERE (k >> h::INT) & 1 = 1 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.label = c.label AND p.hap = h)) GROUP BY label, k)
SELECT label, array_to_string([h FOR h IN range(0, 7) IF (k >> h::INT) & 1 = 1], ',') AS haps, round(loss, 1) AS loss, round(bic, 1) AS bic FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(bic, 6), bit_count(k), k) = 1"""


def _held(spark, sf_dir):
    return graph.written(subset.pool_losses(cells(spark, sf_dir).select("label", "vec_id", "site", "p0", "p1", "p2"), _pool(spark, sf_dir), "label", "int", "vec_id", "site"))


def _named(found):
    return found.select("label", F.concat_ws(",", F.transform(F.array_sort("haps"), lambda x: x.cast("string"))).alias("haps"), F.round("loss", 1).alias("loss"), F.round("bic", 1).alias("bic"))


@query(_SUBSETS)
def q_pool_choice(spark, sf_dir):
    """Of a label's seven founders those that pay for themselves, by additions, drops and exchanges; the SQL tries all subsets."""
    return _named(subset.chosen(_held(spark, sf_dir), "label", "int", graph.written, SCALE))


@query(_SUBSETS)
def q_pool_enumerated(spark, sf_dir):
    """The same choice, from the losses of all subsets."""
    return _named(subset.enumerated(_held(spark, sf_dir), "label", "int", SCALE))


def _signs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("signs"))


_REACH = """WITH RECURSIVE v AS (SELECT label, vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END FOR i IN range(1, 65)])::HUGEINT AS w FROM embeddings),
d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.w, b.w)) / 64.0::DOUBLE AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
c AS (SELECT label, a, max(d) AS core FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label, a ORDER BY d) <= 3) GROUP BY label, a),
e AS (SELECT d.label, d.a, d.b, greatest(d, x.core, y.core) AS weight FROM d JOIN c x ON x.label = d.label AND x.a = d.a JOIN c y ON y.label = d.label AND y.a = d.b)"""


@query(f"{_REACH} SELECT label, a AS vec_id, round(core, 7) AS core FROM c")
def q_core_distances(spark, sf_dir):
    """The share of signs in which a vector differs from the third nearest of its label."""
    return density.core_distances(_signs(spark, sf_dir), ["label"], "vec_id", "signs", 3).withColumn("core", F.round("core", 7))


@query(f"""{_REACH}, t(label, i, reached, weight) AS (SELECT label, 0, [min(vec_id)], 0::DOUBLE FROM v GROUP BY label
UNION ALL SELECT label, i + 1, list_append(reached, b), w FROM (SELECT t.label, t.i, t.reached, arg_min(e.b, (e.weight, e.b)) AS b, min(e.weight) AS w FROM t JOIN e ON e.label = t.label AND list_contains(t.reached, e.a) AND NOT list_contains(t.reached, e.b) GROUP BY t.label, t.i, t.reached))
SELECT label, round(weight, 7) AS weight, count(*) AS edges FROM t WHERE i > 0 GROUP BY 1, 2""")
def q_spanning_tree(spark, sf_dir):
    """How many edges of each weight the least tree over a label's vectors has, by mutual reachability: all such trees have as many."""
    edges = density.reachability_edges(_signs(spark, sf_dir), ["label"], "vec_id", "signs", 3, graph.written)
    return density.spanning_tree(edges, ["label"], graph.written).groupBy("label", F.round("weight", 7).alias("weight")).agg(F.count(F.lit(1)).alias("edges"))


@query(None)
def q_density_clusters(spark, sf_dir):
    """The density clusters of a label's vectors by their signs, of three vectors or more."""
    return density.clusters(_signs(spark, sf_dir), ["label"], "vec_id", "signs", 3, 3, graph.written).withColumn("stability", F.round("stability", 6))


@query(None)
def q_pedigree_phase(spark, sf_dir):
    """Vectors as samples of 32 bins, each the child of the two before it: the bins whose strands a round of phase correction exchanges."""
    v = _signs(spark, sf_dir).select(F.col("vec_id").alias("sample"), "signs")
    at = lambda k: F.get("signs", (F.col("bin") + k).cast("int")).cast("long")
    painted = v.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")))).select("sample", "bin", F.lit(1e4).alias("width"), at(0).alias("h1"), at(32).alias("h2"))
    known = v.select(F.col("sample").alias("child"), (F.col("sample") - 2).alias("father"), (F.col("sample") - 1).alias("mother"))
    return phase.phases(graph.written(painted), known, "long")
