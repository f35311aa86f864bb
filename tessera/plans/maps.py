"""Queries over recombination maps, trios along paintings, and flips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, maps, resample, trios
from .ranking import REPLICATES, SEED, _index_values
from .registry import query
from .tables import MARKS, SEGMENTS, marks, segments, table

LENGTH = 2592000.0

_EVENTS = f"{MARKS}, ev AS (SELECT event_type AS contig, user_id % 2 AS track, user_id, pos AS midpoint FROM marks), me AS (SELECT contig, track, count(DISTINCT user_id) AS meioses FROM ev GROUP BY contig, track)"


def _events(spark, sf_dir):
    """Events of a type as crossovers of a contig, in two tracks; a user is a meiosis."""
    ev = marks(spark, sf_dir).select(F.col("event_type").alias("contig"), (F.col("user_id") % 2).alias("track"), "user_id", F.col("pos").alias("midpoint"))
    return ev, ev.groupBy("contig", "track").agg(F.count_distinct("user_id").alias("meioses"))


_REGIONAL = f"""{_EVENTS}, w(region, a, b) AS (VALUES ('first', 0.0, 0.2), ('middle', 0.2, 0.8), ('last', 0.8, 1.0)),
c AS (SELECT track, region, count(*) AS events FROM ev, w WHERE midpoint >= a * {LENGTH} AND (midpoint < b * {LENGTH} OR (b = 1.0 AND midpoint <= {LENGTH})) GROUP BY track, region),
x AS (SELECT track, region, sum(meioses * (b - a) * {LENGTH}) AS exposure FROM me, w GROUP BY track, region),
r AS (SELECT track, region, coalesce(events, 0) AS events, exposure, coalesce(events, 0) / exposure AS rate FROM x LEFT JOIN c USING (track, region))"""


@query(f"WITH {_REGIONAL} SELECT track, region, events, round(exposure::DOUBLE, 3) AS exposure, round(rate * 1e6, 6)::DOUBLE AS rate FROM r")
def q_regional_rates(spark, sf_dir):
    """Events per meiosis and length in three regions of all contigs, by track."""
    r = maps.regional(*_events(spark, sf_dir), ["contig", "track"], "contig", LENGTH)
    return r.select("track", "region", "events", F.round("exposure", 3).alias("exposure"), F.round(F.col("rate") * 1e6, 6).alias("rate"))


@query(f"WITH {_REGIONAL} SELECT r.track, r.region, round((r.rate / m.rate)::DOUBLE, 6) AS ratio FROM r JOIN r m ON r.track = m.track AND m.region = 'middle' WHERE r.region <> 'middle'")
def q_regional_contrasts(spark, sf_dir):
    r = maps.regional(*_events(spark, sf_dir), ["contig", "track"], "contig", LENGTH)
    return maps.contrasts(r, ["track"]).select("track", "region", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_EVENTS}, g AS (SELECT DISTINCT track, bin FROM me, range(20) b(bin)), c AS (SELECT track, least(CAST(floor(midpoint / {LENGTH} * 20) AS INT), 19) AS bin, count(*) AS n FROM ev WHERE midpoint BETWEEN 0 AND {LENGTH} GROUP BY 1, 2),
m AS (SELECT track, bin, coalesce(n, 0) AS events FROM g LEFT JOIN c USING (track, bin)) SELECT track, bin::INT AS bin, events, round(events / avg(events) OVER (PARTITION BY track), 6) AS relative FROM m""")
def q_local_rates(spark, sf_dir):
    """Events in twenty equal shares of the contigs, over the mean."""
    m = maps.local(*_events(spark, sf_dir), ["contig", "track"], "contig", LENGTH)
    return m.withColumn("relative", F.round("relative", 6))


@query(f"""WITH {_EVENTS}, u AS (SELECT contig, dense_rank() OVER (ORDER BY contig) - 1 AS unit FROM (SELECT DISTINCT contig FROM ev)), g AS (SELECT unit, contig, part FROM u, (VALUES ('end'), ('middle')) p(part)),
c AS (SELECT contig, CASE WHEN midpoint < 0.2 * {LENGTH} OR midpoint >= 0.8 * {LENGTH} THEN 'end' ELSE 'middle' END AS part, count(*) AS events FROM ev GROUP BY 1, 2), m AS (SELECT contig, count(DISTINCT user_id) AS meioses FROM ev GROUP BY contig),
k AS (SELECT unit, part, coalesce(events, 0) AS events, meioses * CASE part WHEN 'end' THEN 0.4 ELSE 0.6 END AS exposure FROM g LEFT JOIN c USING (contig, part) JOIN m USING (contig)), i(replicate, unit, times) AS (VALUES {_index_values(5)}),
r AS (SELECT replicate, (sum(events * times) FILTER (part = 'end') / sum(exposure * times) FILTER (part = 'end')) / (sum(events * times) FILTER (part = 'middle') / sum(exposure * times) FILTER (part = 'middle')) AS ratio FROM k JOIN i USING (unit) GROUP BY replicate)
SELECT (SELECT round(((sum(events) FILTER (part = 'end') / sum(exposure) FILTER (part = 'end')) / (sum(events) FILTER (part = 'middle') / sum(exposure) FILTER (part = 'middle')))::DOUBLE, 6) FROM k) AS ratio,
round(quantile_cont(ratio::DOUBLE, 0.025), 6) AS low, round(quantile_cont(ratio::DOUBLE, 0.975), 6) AS high FROM r""")
def q_bootstrap_ratio_ci(spark, sf_dir):
    """The ratio of the rate at contigs' ends to that in their middles, with bounds from resampled contigs."""
    ev, _ = _events(spark, sf_dir)
    names = ev.select("contig").distinct().withColumn("unit", (F.dense_rank().over(Window.orderBy("contig")) - 1).cast("int"))  # event types: five
    ev, unit = ev.join(F.broadcast(names), "contig"), F.col("unit")
    part = F.when((F.col("midpoint") < 0.2 * LENGTH) | (F.col("midpoint") >= 0.8 * LENGTH), "end").otherwise("middle")
    count = ev.groupBy(unit.alias("unit"), part.alias("part")).agg(F.count(F.lit(1)).alias("events"))
    width = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(x).alias("width")) for p, x in (("end", 0.4), ("middle", 0.6))]))
    exposure = ev.groupBy(unit.alias("unit")).agg(F.count_distinct("user_id").alias("meioses")).select("unit", "meioses", width.alias("w"))
    k = exposure.select("unit", "w.part", (F.col("meioses") * F.col("w.width")).alias("exposure")).join(count, ["unit", "part"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    index = resample.index_table(spark, 5, REPLICATES, SEED)
    found = maps.ratio_interval(k, "unit", "part", "end", "middle", index)
    return found.select(*[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


@query(f"""WITH {_EVENTS}, l AS (SELECT contig, min(midpoint) AS low, max(midpoint) AS high FROM ev GROUP BY contig), b AS (SELECT contig, CAST(floor(avg(midpoint)) AS BIGINT) AS edge FROM ev GROUP BY contig)
SELECT contig, unnest(range(low, high + 1, 86400)) AS edge FROM l UNION SELECT contig, high FROM l UNION SELECT contig, edge FROM b JOIN l USING (contig) WHERE edge > low AND edge < high""")
def q_map_edges(spark, sf_dir):
    """Edges of a day's width from a contig's first event to its last, and its mean place."""
    ev, _ = _events(spark, sf_dir)
    span = ev.groupBy("contig").agg(F.min("midpoint").alias("low"), F.max("midpoint").alias("high"))
    bounds = ev.groupBy("contig").agg(F.floor(F.avg("midpoint")).alias("edge"))
    return maps.edges(span, "contig", "low", "high", 86400, bounds)


_CURVES = f"{_EVENTS}, cu AS (SELECT contig, track, bin * 86400 + track * 20000 AS x, sum(n) OVER (PARTITION BY contig, track ORDER BY bin)::DOUBLE AS y FROM (SELECT contig, track, midpoint // 86400 AS bin, count(*) AS n FROM ev GROUP BY ALL))"


@query(f"""WITH {_CURVES}, p AS (SELECT DISTINCT contig, x FROM cu), g AS (SELECT DISTINCT c.contig, c.track, p.x FROM cu c JOIN p USING (contig)),
s AS (SELECT g.contig, g.track, g.x, (SELECT max(x) FROM cu c WHERE c.contig = g.contig AND c.track = g.track AND c.x <= g.x) AS xa, (SELECT min(x) FROM cu c WHERE c.contig = g.contig AND c.track = g.track AND c.x >= g.x) AS xb FROM g)
SELECT s.contig, s.track, s.x, round(CASE WHEN xa IS NULL THEN b.y WHEN xb IS NULL OR xa = xb THEN a.y ELSE a.y + (s.x - xa) / (xb - xa)::DOUBLE * (b.y - a.y) END, 6) AS y
FROM s LEFT JOIN cu a ON a.contig = s.contig AND a.track = s.track AND a.x = xa LEFT JOIN cu b ON b.contig = s.contig AND b.track = s.track AND b.x = xb""")
def q_aligned_curves(spark, sf_dir):
    """Running counts of both tracks on the union of their days' edges, which are apart, by interpolation."""
    ev, _ = _events(spark, sf_dir)
    n = ev.groupBy("contig", "track", F.floor(F.col("midpoint") / 86400).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    y = F.sum("n").over(Window.partitionBy("contig", "track").orderBy("bin")).cast("double")
    curves = n.select("contig", "track", (F.col("bin") * 86400 + F.col("track") * 20000).alias("x"), y.alias("y"))
    return maps.aligned(curves, ["contig"], "track", "x", "y").withColumn("y", F.round("y", 6))


@query("""WITH r AS (SELECT o_custkey % 7 AS generation, o_orderkey, list(l_shipdate) FILTER (l_returnflag = 'R') AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)
SELECT generation, count(*) AS meioses, CAST(sum(coalesce(len(m), 0)) AS BIGINT) AS events FROM r GROUP BY generation""")
def q_gamete_events(spark, sf_dir):
    """Orders as gametes, their returned lines as crossovers; orders without any count as meioses."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_shipdate").alias("m"))
    records = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select((F.col("o_custkey") % 7).alias("generation"), "m")
    events, meioses = maps.gametes(records, ["generation"], "m")
    count = events.groupBy("generation").agg(F.count(F.lit(1)).alias("events"))
    return meioses.join(count, "generation", "left").select("generation", "meioses", F.coalesce("events", F.lit(0)).alias("events"))


_GRID = "g AS (SELECT l_suppkey AS sample, l_orderkey * 8 + l_linenumber AS bin, max(l_partkey) % 3 AS h1, l_orderkey % 3 AS h2, max(l_partkey) AS part, max(l_quantity) AS quantity, l_orderkey AS o, l_linenumber AS k FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber)"


def _grid(spark, sf_dir):
    """(sample, bin, part, quantity, o, k): a supplier's lines in order."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"))
    return l.agg(F.max("l_partkey").alias("part"), F.max("l_quantity").alias("quantity")).withColumn("bin", F.col("o") * 8 + F.col("k"))


@query(f"""WITH {_GRID}, l AS (SELECT *, lag(h1) OVER w AS p1, lag(h2) OVER w AS p2 FROM g WINDOW w AS (PARTITION BY sample ORDER BY bin))
SELECT sample, count(*) AS n, count_if(coalesce(p1 = p2 AND h1 <> h2, false))::BIGINT AS opens, count_if(coalesce(h1 <> p1 AND h2 <> p2, false))::BIGINT AS doubled, count_if(coalesce(p1 = p2 AND h1 <> h2, false) OR coalesce(h1 <> p1 AND h2 <> p2, false))::BIGINT AS boundary FROM l GROUP BY sample""")
def q_flip_boundaries(spark, sf_dir):
    """Where a supplier's two tracks may be exchanged: after a homozygous bin, or where both change."""
    g = _grid(spark, sf_dir).select("sample", "bin", (F.col("part") % 3).alias("h1"), (F.col("o") % 3).alias("h2"))
    f = g.withColumns(maps.flips(["sample"], "bin", F.col("h1"), F.col("h2")))
    return f.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("opens", "doubled", "boundary")])


@query(f"""WITH {_GRID}, r AS (SELECT sample, bin, h1, h2, k % 3 AS a1, part % 2 AS a2, sample % 3 AS b1, o % 2 AS b2, quantity * 1000 AS width FROM g),
f AS (SELECT *, CASE WHEN h1 = a1 THEN 0 WHEN h1 = a2 THEN 1 END AS x, CASE WHEN h2 = b1 THEN 0 WHEN h2 = b2 THEN 1 END AS y FROM r),
d AS (SELECT *, coalesce((x <> lag(x) OVER w)::INT, 0) + coalesce((y <> lag(y) OVER w)::INT, 0) AS moved FROM f WINDOW w AS (PARTITION BY sample ORDER BY bin))
SELECT sample, count(*) AS n, round(sum(CASE WHEN x IS NULL OR y IS NULL THEN -20.0 ELSE 0 END + 0.5 * ln(least(greatest(width * 1e-7, 1e-15), 0.5)) * moved), 5) AS score FROM d GROUP BY sample""")
def q_derivation_score(spark, sf_dir):
    """How well a supplier's two tracks follow from two parents' along its lines."""
    c = F.col
    rows = _grid(spark, sf_dir).select("sample", "bin", (c("part") % 3).alias("h1"), (c("o") % 3).alias("h2"), (c("k") % 3).alias("a1"), (c("part") % 2).alias("a2"), (c("sample") % 3).alias("b1"), (c("o") % 2).alias("b2"), (c("quantity") * 1000).alias("width"))
    return maps.derivation_score(rows, ["sample"], "bin", 1e-7).withColumn("score", F.round("score", 5))


_PAINTED = f"""{SEGMENTS}, pa AS (SELECT user_id AS sample, 'one' AS contig, "start", "end", length(owner) % 3 AS h1, (length(owner) + user_id) % 3 AS h2 FROM segments), tr AS (SELECT user_id AS child, user_id + 1 AS p1, user_id + 2 AS p2 FROM (SELECT DISTINCT user_id FROM segments))"""
_SUPPORT = f"""{_PAINTED}, sp AS (SELECT sample, min("start") AS a, max("end") AS b FROM pa GROUP BY sample), po AS (SELECT sample, unnest(range(a, b, 50000)) AS pos FROM sp),
j AS (SELECT child, pos, c.h1 AS c1, c.h2 AS c2, x.h1 AS x1, x.h2 AS x2, y.h1 AS y1, y.h2 AS y2 FROM tr JOIN po ON po.sample = child JOIN pa c ON c.sample = child AND pos >= c."start" AND pos < c."end" JOIN pa x ON x.sample = p1 AND pos >= x."start" AND pos < x."end" JOIN pa y ON y.sample = p2 AND pos >= y."start" AND pos < y."end"),
su AS (SELECT child, count(*) AS sampled, avg((((c1 = x1 OR c1 = x2) AND (c2 = y1 OR c2 = y2)) OR ((c2 = x1 OR c2 = x2) AND (c1 = y1 OR c1 = y2)))::INT) AS explained FROM j GROUP BY child)"""


def _support(spark, sf_dir):
    s = segments(spark, sf_dir)
    painted = s.select(F.col("user_id").alias("sample"), F.lit("one").alias("contig"), "start", "end", (F.length("owner") % 3).cast("long").alias("h1"), ((F.length("owner") + F.col("user_id")) % 3).alias("h2"))
    trio = s.select("user_id").distinct().select(F.col("user_id").alias("child"), (F.col("user_id") + 1).alias("p1"), (F.col("user_id") + 2).alias("p2"))
    return trio, trios.support(painted, trio, 50000)


@query(f"WITH {_SUPPORT} SELECT child, sampled, round(explained, 7) AS explained FROM su")
def q_trio_support(spark, sf_dir):
    """The share of a child's painting, every 50,000 places, whose two founders come one from each parent."""
    return _support(spark, sf_dir)[1].select("child", "sampled", F.round("explained", 7).alias("explained"))


@query(f"WITH {_SUPPORT} SELECT tr.child, CASE WHEN coalesce(explained, 1) >= 0.6 THEN p1 END AS p1, CASE WHEN coalesce(explained, 1) >= 0.6 THEN p2 END AS p2 FROM tr LEFT JOIN su USING (child)")
def q_consistency_cut(spark, sf_dir):
    """The pedigree without the parents of children that they explain too little of."""
    trio, support = _support(spark, sf_dir)
    return graph.unsupported(trio, "child", ["p1", "p2"], support, "explained", 0.6)


@query(None)
def q_acyclic_pedigree(spark, sf_dir):
    """Suppliers as a tree in which every 25th has a child of its own as a parent too: cut until there is no cycle."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("child"), F.col("s_acctbal").alias("score"))
    k = F.col("child")
    ped = c.select("child", F.when(k % 25 == 0, 2 * k).alias("p1"), F.when(k > 0, F.floor(k / 2)).alias("p2"), "score")
    return graph.resolve_cycles(ped, "child", ["p1", "p2"], "score").select("child", "p1", "p2")
