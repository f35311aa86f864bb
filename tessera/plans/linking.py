"""Queries over posteriors of hidden states, expected steps, and transitions learnt between blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beam, graph, linking, matching, mixture, paths
from .paths import _SRC, _USER, FOUNDERS, _emission_table, _emissions, founder_alleles
from .registry import query
from .tables import table

_BOTH = f"""WITH RECURSIVE {_SRC},
f(user_id, i, a0, a1) AS (SELECT user_id, i, x0 / (x0 + x1), x1 / (x0 + x1) FROM (SELECT *, 0.5 * e0 AS x0, 0.5 * e1 AS x1 FROM src WHERE i = 1)
UNION ALL SELECT user_id, i, x0 / (x0 + x1), x1 / (x0 + x1) FROM (SELECT src.user_id, src.i, (a0 * (1 - t) + a1 * t) * e0 AS x0, (a0 * t + a1 * (1 - t)) * e1 AS x1 FROM f JOIN src ON src.user_id = f.user_id AND src.i = f.i + 1)),
b(user_id, i, b0, b1) AS (SELECT user_id, max(i), 0.5::DOUBLE, 0.5::DOUBLE FROM src GROUP BY user_id
UNION ALL SELECT user_id, i - 1, y0 / (y0 + y1), y1 / (y0 + y1) FROM (SELECT b.user_id, b.i, (1 - t) * e0 * b0 + t * e1 * b1 AS y0, t * e0 * b0 + (1 - t) * e1 * b1 AS y1 FROM b JOIN src ON src.user_id = b.user_id AND src.i = b.i WHERE b.i > 1))"""


@query(f"{_BOTH} SELECT user_id, i, round(a1 * b1 / (a0 * b0 + a1 * b1), 6) AS p1 FROM f JOIN b USING (user_id, i)")
def q_posteriors_2state(spark, sf_dir):
    """At each of a user's events, the chance of the second of two states, given all events."""
    found = paths.posteriors(_emissions(spark, sf_dir), _USER, "i", paths.strands(["e0", "e1"], "t"))
    return found.select("user_id", "i", F.round(F.get("posterior", F.lit(1)), 6).alias("p1"))


def _by_type(spark, sf_dir):
    """The emissions with the event's own type: whether it is one of the common ones."""
    return _emissions(spark, sf_dir).withColumn("common", F.col("e0") > 0.5)


@query(f"""{_BOTH}, s AS (SELECT e0 > 0.5 AS common, coalesce(a0, 0.5) * (1 - t) * e0 * b0 AS s00, coalesce(a0, 0.5) * t * e1 * b1 AS s01, coalesce(a1, 0.5) * t * e0 * b0 AS s10, coalesce(a1, 0.5) * (1 - t) * e1 * b1 AS s11
  FROM src JOIN b USING (user_id, i) LEFT JOIN f ON f.user_id = src.user_id AND f.i = src.i - 1),
u AS (SELECT common, unnest([0, 0, 1, 1]) AS h_from, unnest([0, 1, 0, 1]) AS h_to, unnest([s00, s01, s10, s11]) / (s00 + s01 + s10 + s11) AS x FROM s)
SELECT common, h_from::BIGINT AS h_from, h_to::BIGINT AS h_to, round(sum(x), 4) AS expected FROM u GROUP BY ALL HAVING sum(x) > 0""")
def q_expected_switches(spark, sf_dir):
    """How often the state is expected to change, or stay, on the way to common and to rare kinds of event."""
    found = paths.expected_moves(_by_type(spark, sf_dir), _USER, "i", paths.strands(["e0", "e1"], "t"), {"common": "boolean"})
    return found.withColumn("expected", F.round("expected", 4))


def _chains(spark, sf_dir):
    """(label, sample, layer, e): the vectors' bins as blocks, with log emissions of pairs of their label's founders."""
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label")
    e = _emission_table(spark, sf_dir).filter("h1 <= h2").select("sample", F.col("bin").alias("layer"), "h1", "h2", "log_emission").join(label, "sample")
    return linking.chains(e, ["label"], "sample", "layer", 4)


def _learnt(spark, sf_dir):
    rows = graph.written(_chains(spark, sf_dir))
    hap = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("h")
    nodes = rows.select("label", "layer").distinct().select("label", F.col("layer").cast("long").alias("layer"), hap)
    keys, sample = {"label": rows.schema["label"].dataType.simpleString()}, {"sample": "long"}
    return rows, linking.baum_welch(rows, nodes, keys, sample, "layer", 4, graph.written, rounds=3), keys, sample


@query(None)
def q_linked_transitions(spark, sf_dir):
    """How each label's founders go on from a block to the next, learnt from its vectors in three rounds."""
    return _learnt(spark, sf_dir)[1].withColumn("p", F.round("p", 6))


@query(None)
def q_linked_likelihood(spark, sf_dir):
    """The log-likelihood of each vector's chain of blocks under the transitions that were learnt."""
    rows, edges, keys, sample = _learnt(spark, sf_dir)
    return linking.log_likelihoods(rows, edges, keys, sample, "layer", 4).withColumn("score", F.round("score", 5))


_WEIGHTS = f"""WITH {FOUNDERS}, w AS (SELECT a.label, a.hap AS i, b.hap AS j, count(*) FILTER (a.allele = b.allele)::DOUBLE AS w FROM founders a JOIN founders b ON a.label = b.label AND b.site = a.site + 32 WHERE a.site < 32 GROUP BY ALL)"""


def _weights(spark, sf_dir):
    """(label, i, j, w): at how many sites founder i's first half has the alleles of founder j's second half."""
    f = graph.written(founder_alleles(spark, sf_dir))
    one = f.filter("site < 32").select("label", F.col("hap").cast("long").alias("i"), "site", F.col("allele").alias("a"))
    two = f.filter("site >= 32").select("label", F.col("hap").cast("long").alias("j"), (F.col("site") - 32).alias("site"), F.col("allele").alias("b"))
    return one.join(two, ["label", "site"]).groupBy("label", "i", "j").agg(F.count_if(F.col("a") == F.col("b")).cast("double").alias("w"))


@query(f"""{_WEIGHTS}, n AS (SELECT label, count(DISTINCT i) AS n FROM w GROUP BY label),
s AS (SELECT label, n, a.j AS ja, b.j AS jb, c.j AS jc, d.j AS jd, a.w + b.w + c.w + d.w AS total FROM w a JOIN w b USING (label) JOIN w c USING (label) JOIN w d USING (label) JOIN n USING (label)
  WHERE n = 4 AND a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3 AND len(list_distinct([a.j, b.j, c.j, d.j])) = 4),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, ja, jb, jc, jd) AS rank FROM s)
SELECT label, rank::BIGINT AS rank, unnest([0, 1, 2, 3])::BIGINT AS i, unnest([ja, jb, jc, jd])::BIGINT AS j, total FROM r WHERE rank <= 3""")
def q_best_assignments(spark, sf_dir):
    """The three best ways to match each label's founders' first halves with their second halves, for labels of four founders."""
    w = _weights(spark, sf_dir)
    four = w.groupBy("label").agg(F.count_distinct("i").alias("n")).filter("n = 4").select("label")
    return matching.best_assignments(w.join(four, "label"), {"label": w.schema["label"].dataType.simpleString()}, "i", "j", "w", 3)


def _knots(spark, sf_dir):
    """(child, parent): suppliers as a tree, in which every 25th has a child of its own as a parent too, and some a later supplier."""
    k = F.col("s_suppkey").cast("long")
    parents = F.array(F.when(k > 1, F.floor(k / 2)), F.when(k % 25 == 0, 2 * k), F.when(k % 40 == 7, k + 30))
    return table(spark, sf_dir, "supplier").select(k.alias("child"), F.explode(parents).alias("parent")).filter("parent is not null")


@query("""WITH RECURSIVE e AS (SELECT * FROM (SELECT s_suppkey::BIGINT AS child, unnest([CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END, CASE WHEN s_suppkey % 25 = 0 THEN 2 * s_suppkey END, CASE WHEN s_suppkey % 40 = 7 THEN s_suppkey + 30 END]) AS parent FROM supplier) WHERE parent IS NOT NULL),
r(a, b) AS (SELECT child, parent FROM e UNION SELECT r.a, e.parent FROM r JOIN e ON e.child = r.b)
SELECT x.a AS node, min(x.b)::BIGINT AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def q_strong_components(spark, sf_dir):
    """The suppliers that are their own ancestors, and the least one of each such knot."""
    return graph.strong_components(_knots(spark, sf_dir))


@query(None)
def q_acyclic_choice(spark, sf_dir):
    """For every supplier one pair of parents, made of the part and order numbers of its lines and scored by their discounts and taxes, so that no one is their own ancestor."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("child"), F.pmod(F.col("l_partkey"), F.lit(997)).alias("first"), F.pmod(F.col("l_orderkey"), F.lit(991)).alias("second"), (F.col("l_discount") + F.col("l_tax")).cast("double").alias("x"))
    trios = lines.groupBy("child", "first", "second").agg(F.round(F.sum("x"), 6).alias("score")).filter("first <> child and second <> child")
    return graph.acyclic_choice(trios, "child", "first", "second", "score")


@query(None)
def q_sign_mixture(spark, sf_dir):
    """For each label, the mixture of one or two patterns of signs that suits its vectors best, after eight rounds."""
    bits = F.transform("embedding", lambda x: (x > 0).cast("int"))
    rows = mixture.distinct_patterns(table(spark, sf_dir, "embeddings").select("label", bits.alias("bits")), ["label"], "bits")
    best = mixture.chosen(mixture.fitted(rows, ["label"], 2, graph.written, restarts=1, rounds=8), ["label"])
    return best.select("label", "k", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("bic", 4).alias("bic"))


_MESH = f"""WITH {FOUNDERS}, q AS (SELECT label, hap, site // 16 AS layer, site % 16 AS s, allele FROM founders),
m AS (SELECT a.label, a.layer AS past, b.layer, a.hap AS h_from, b.hap AS h_to, avg((a.allele = b.allele)::INT)::DOUBLE AS w FROM q a JOIN q b ON a.label = b.label AND a.s = b.s AND a.layer < b.layer GROUP BY ALL),
h AS (SELECT DISTINCT label, hap FROM founders)"""


def _mesh(spark, sf_dir):
    """(label, past, layer, h_from, h_to, score): founders in four stretches of 16 sites, and how alike their alleles are from one to a later."""
    q = founder_alleles(spark, sf_dir).select("label", F.col("hap").cast("long").alias("hap"), F.floor(F.col("site") / 16).cast("int").alias("layer"), (F.col("site") % 16).alias("s"), "allele")
    q = graph.written(q)
    one = q.select("label", "s", F.col("layer").alias("past"), F.col("hap").alias("h_from"), F.col("allele").alias("x"))
    met = one.join(q.select("label", "s", "layer", F.col("hap").alias("h_to"), F.col("allele").alias("y")), ["label", "s"]).filter("past < layer")
    return met.groupBy("label", "past", "layer", "h_from", "h_to").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("score")), q.select("label", "layer", F.col("hap").alias("h")).distinct()


@query(f"""{_MESH}, p AS (SELECT a.label, a.hap AS a, b.hap AS b, c.hap AS c, d.hap AS d, ab.w + (ac.w + bc.w) / 2 + (ad.w + bd.w + cd.w) / 3 AS score FROM h a JOIN h b USING (label) JOIN h c USING (label) JOIN h d USING (label)
  JOIN m ab ON ab.label = a.label AND ab.past = 0 AND ab.layer = 1 AND ab.h_from = a.hap AND ab.h_to = b.hap JOIN m ac ON ac.label = a.label AND ac.past = 0 AND ac.layer = 2 AND ac.h_from = a.hap AND ac.h_to = c.hap
  JOIN m bc ON bc.label = a.label AND bc.past = 1 AND bc.layer = 2 AND bc.h_from = b.hap AND bc.h_to = c.hap JOIN m ad ON ad.label = a.label AND ad.past = 0 AND ad.layer = 3 AND ad.h_from = a.hap AND ad.h_to = d.hap
  JOIN m bd ON bd.label = a.label AND bd.past = 1 AND bd.layer = 3 AND bd.h_from = b.hap AND bd.h_to = d.hap JOIN m cd ON cd.label = a.label AND cd.past = 2 AND cd.layer = 3 AND cd.h_from = c.hap AND cd.h_to = d.hap)
SELECT label, a || '-' || b || '-' || c || '-' || d AS path, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, a, b, c, d) = 1""")
def q_beam_best_path(spark, sf_dir):
    """The best way for each label through its founders' four stretches, by a beam that is wide enough for all."""
    mesh, nodes = _mesh(spark, sf_dir)
    found = beam.search(mesh, nodes, {"label": mesh.schema["label"].dataType.simpleString()}, 256, 0.7, graph.written)
    return found.filter("rank = 1").select("label", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.round("score", 6).alias("score"))


@query(None)
def q_beam_paths(spark, sf_dir):
    """Five good and different ways for each label through its founders' four stretches."""
    mesh, nodes = _mesh(spark, sf_dir)
    found = beam.search(mesh, nodes, {"label": mesh.schema["label"].dataType.simpleString()}, 5, 0.7, graph.written)
    return found.select("label", "rank", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.round("score", 6).alias("score"))
