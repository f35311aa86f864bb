"""Queries over windows, segments, runs and coordinate joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, windows
from .registry import query
from .tables import MARKS, SEGMENTS, marks, segments, seconds, table

DAY = 86400


@query(f"""WITH {MARKS}, w AS (SELECT *, unnest(range(greatest(0, CAST(floor((pos - 7200) / 3600.0) AS BIGINT) + 1), pos // 3600 + 1)) AS block_id FROM marks)
SELECT block_id, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM w GROUP BY block_id""")
def q_block_windows(spark, sf_dir):
    """Windows of two hours, every hour."""
    w = windows.sliding(marks(spark, sf_dir), "pos", 7200, 3600)
    return w.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {MARKS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pos, event_id) - 1 AS i FROM marks), w AS (SELECT *, unnest(range(greatest(0, CAST(floor((i - 200) / 100.0) AS BIGINT) + 1), i // 100 + 1)) AS block_id FROM r)
SELECT event_type, block_id, count(*) AS n, min(pos) AS first_pos, max(pos) + 1 AS end_pos FROM w GROUP BY ALL""")
def q_count_windows(spark, sf_dir):
    """Windows of 200 events of a type, every 100."""
    w = windows.counted(marks(spark, sf_dir), ["event_type"], ["pos", "event_id"], 200, 100, width=DAY)
    return w.groupBy("event_type", "block_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), (F.max("pos") + 1).alias("end_pos"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1")
def q_first_occurrence(spark, sf_dir):
    return windows.first_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


_RUNS = f"""WITH {MARKS}, f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM marks WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos, event_id)::BIGINT AS run FROM f), r AS (SELECT user_id, run, event_type, count(*) AS n, min(pos) AS "start", max(pos) AS "end" FROM g GROUP BY ALL)"""


def _runs(spark, sf_dir):
    return windows.runs(marks(spark, sf_dir), ["user_id"], ["pos", "event_id"], "event_type", F.col("pos"), F.col("pos"))


@query(_RUNS + ' SELECT user_id, run, event_type, n, "start", "end" FROM r')
def q_segments_rle(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(_RUNS + " SELECT user_id, string_agg(event_type, '>' ORDER BY run) AS topology, count(*) AS n_runs FROM r GROUP BY user_id")
def q_topology_collapse(spark, sf_dir):
    """Each user's types in order, repeats collapsed."""
    rows = _runs(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("run", "event_type"))).alias("r"))
    return rows.select("user_id", F.array_join(F.transform("r", lambda x: x["event_type"]), ">").alias("topology"), F.size("r").cast("long").alias("n_runs"))


@query(_RUNS + """, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY run) AS before FROM r)
SELECT before, event_type AS after, count(*) AS n, count(DISTINCT user_id) AS users FROM p WHERE before IS NOT NULL GROUP BY ALL""")
def q_crossover_types(spark, sf_dir):
    """Changes of type along users' events."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("run"))
    rows = _runs(spark, sf_dir).withColumn("before", before).filter("before is not null")
    return rows.groupBy("before", F.col("event_type").alias("after")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {SEGMENTS} SELECT CASE WHEN "end" - "start" < 600 THEN 'a' WHEN "end" - "start" < 7200 THEN 'b' WHEN "end" - "start" < {DAY} THEN 'c' ELSE 'd' END AS width, count(*) AS n,
CAST(floor(median("end" - "start")) AS BIGINT) AS middle, min("end" - "start") AS least, max("end" - "start") AS most, CAST(sum("end" - "start") AS BIGINT) AS total FROM segments GROUP BY 1""")
def q_width_buckets(spark, sf_dir):
    w = F.col("end") - F.col("start")
    name = F.when(w < 600, "a").when(w < 7200, "b").when(w < DAY, "c").otherwise("d")
    # segments of equal length are counted first, so a bucket's median is over its lengths and not its segments
    lengths = segments(spark, sf_dir).groupBy(name.alias("width"), w.alias("length")).agg(F.count(F.lit(1)).alias("times"))
    middle = F.floor(F.percentile("length", F.lit(0.5), F.col("times"))).alias("middle")
    return lengths.groupBy("width").agg(F.sum("times").alias("n"), middle, F.min("length").alias("least"), F.max("length").alias("most"), F.sum(F.col("length") * F.col("times")).alias("total"))


_CENTRES = "centres AS (SELECT user_id, unnest(range(1800, 2592000, 21600))::BIGINT AS centre FROM (SELECT DISTINCT user_id FROM marks))"


def _centres(spark, sf_dir):
    users = marks(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", F.explode(F.sequence(F.lit(1800).cast("long"), F.lit(2591999).cast("long"), F.lit(21600).cast("long"))).alias("centre"))


@query(f"""WITH {SEGMENTS}, {_CENTRES} SELECT c.user_id, centre, owner FROM centres c LEFT JOIN segments s ON c.user_id = s.user_id AND centre >= s."start" AND centre < s."end" """)
def q_interval_halfopen(spark, sf_dir):
    """Bins by their centres against half-open segments; none where no segment is."""
    found = joins.containing(_centres(spark, sf_dir), segments(spark, sf_dir), ["user_id"], "centre", "start", "end", 21600, "left", "left")
    return found.select("user_id", "centre", "owner")


@query(f"""WITH {SEGMENTS}, {_CENTRES} SELECT c.user_id, centre, owner FROM centres c JOIN segments s ON c.user_id = s.user_id AND centre >= s."start" AND centre <= s."end" """)
def q_interval_closed(spark, sf_dir):
    """Bins by their centres against segments closed at both ends."""
    return joins.containing(_centres(spark, sf_dir), segments(spark, sf_dir), ["user_id"], "centre", "start", "end", 21600, "both").select("user_id", "centre", "owner")


@query(f"""WITH {SEGMENTS}, {_CENTRES}, l AS (SELECT user_id, max("end") AS last FROM segments GROUP BY user_id),
j AS (SELECT c.user_id, centre, (SELECT min("end") FROM segments s WHERE s.user_id = c.user_id AND s."end" >= centre) AS e FROM centres c)
SELECT j.user_id, centre, CASE WHEN centre >= s."start" THEN owner END AS owner FROM j JOIN l USING (user_id) JOIN segments s ON s.user_id = j.user_id AND s."end" = coalesce(e, last)""")
def q_interval_leftclip(spark, sf_dir):
    """Bins by the first segment that ends at or after their centre, else the last."""
    return joins.first_ending(_centres(spark, sf_dir), segments(spark, sf_dir), ["user_id"], "centre", "start", "end", ["owner"]).select("user_id", "centre", "owner")


_DATED = """o AS (SELECT o_orderkey, o_custkey % 50 AS k, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS d FROM orders), s AS (SELECT l_suppkey % 50 AS k, CAST(epoch_us(l_shipdate) // 86400000000 AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY ALL)"""


def _dated(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), F.floor(seconds("o_orderdate") / DAY).alias("d"))
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k"), F.floor(seconds("l_shipdate") / DAY).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return o, s


@query(f"WITH {_DATED} SELECT o_orderkey, o.d AS d, s.d AS at, n FROM o ASOF LEFT JOIN s ON o.k = s.k AND o.d <= s.d")
def q_asof_forward(spark, sf_dir):
    """Each order with the first shipping day of its key at or after it."""
    o, s = _dated(spark, sf_dir)
    return joins.asof(o, s, ["k"], "d", "at", ["n"], forward=True, width=180).select("o_orderkey", "d", "at", "n")


@query(f"WITH {_DATED} SELECT o_orderkey, o.d AS d, s.d AS at, n FROM o ASOF LEFT JOIN s ON o.k = s.k AND o.d >= s.d")
def q_asof_backward(spark, sf_dir):
    o, s = _dated(spark, sf_dir)
    return joins.asof(o, s, ["k"], "d", "at", ["n"], width=180).select("o_orderkey", "d", "at", "n")


@query(f"""WITH {_DATED}, j AS (SELECT o_orderkey, o.d AS d, s.d AS "at", n, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(s.d - o.d), s.d DESC) AS r FROM o LEFT JOIN s ON o.k = s.k)
SELECT o_orderkey, d, "at", n FROM j WHERE r = 1""")
def q_nearest_site(spark, sf_dir):
    """Each order with the nearest shipping day of its key; of two, the later."""
    o, s = _dated(spark, sf_dir)
    return joins.nearest(o, s, ["k"], "d", "at", ["n"], width=180).select("o_orderkey", "d", "at", "n")


_PAIRED = f"""WITH {SEGMENTS}, a AS (SELECT user_id // 2 AS k, "start" AS s, "end" AS e, owner FROM segments WHERE user_id % 2 = 0), b AS (SELECT user_id // 2 AS k, "start" AS s, "end" AS e, owner FROM segments WHERE user_id % 2 = 1)"""


def _paired(spark, sf_dir):
    s = segments(spark, sf_dir)
    return [s.filter(F.col("user_id") % 2 == i).select(F.floor(F.col("user_id") / 2).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), "owner") for i in (0, 1)]


@query(_PAIRED + """, x AS (SELECT k, s AS x FROM a UNION SELECT k, e FROM a UNION SELECT k, s FROM b UNION SELECT k, e FROM b), p AS (SELECT k, x AS "from", lead(x) OVER (PARTITION BY k ORDER BY x) AS "to" FROM x)
SELECT p.k, "from", "to", a.owner AS first, b.owner AS second FROM p LEFT JOIN a ON p.k = a.k AND "from" >= a.s AND "from" < a.e LEFT JOIN b ON p.k = b.k AND "from" >= b.s AND "from" < b.e WHERE "to" IS NOT NULL AND (a.owner IS NOT NULL OR b.owner IS NOT NULL)""")
def q_overlay(spark, sf_dir):
    """The elementary intervals of two users' segmentations, with both owners."""
    a, b = _paired(spark, sf_dir)
    return joins.overlay(a, b, ["k"], "s", "e", "owner", "owner", 21600)


@query(f"""WITH {SEGMENTS} SELECT user_id, greatest("start", 100000) AS "start", least("end", 900000) AS "end", owner FROM segments WHERE greatest("start", 100000) < least("end", 900000)""")
def q_clip_segments(spark, sf_dir):
    return joins.clip(segments(spark, sf_dir), "start", "end", F.lit(100000).cast("long"), F.lit(900000).cast("long"))


@query(f"""WITH {MARKS}, r AS (SELECT *, pos // 3600 AS hour, count(*) OVER (PARTITION BY pos // 3600) AS n, row_number() OVER (PARTITION BY pos // 3600 ORDER BY pos, event_id) - 1 AS i FROM marks)
SELECT hour, event_id, pos FROM r WHERE n <= 5 OR i IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)""")
def q_multisnp_sample(spark, sf_dir):
    """At most five events of each hour, evenly spread."""
    return windows.systematic(marks(spark, sf_dir).withColumn("hour", F.floor(F.col("pos") / 3600)), ["hour"], ["pos", "event_id"], 5).select("hour", "event_id", "pos")


@query(f"""WITH {MARKS}, c AS (SELECT user_id, event_id, pos, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS state FROM marks),
d AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS before, lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS since FROM c) SELECT user_id, event_id, before, state, (since + pos) / 2.0 AS midpoint FROM d WHERE before <> state""")
def q_decode_crossovers(spark, sf_dir):
    """Changes of state along a user's events, errors passed over, with their midpoints."""
    w = Window.partitionBy("user_id").orderBy("pos", "event_id")
    c = marks(spark, sf_dir).withColumn("state", windows.carried(F.when(F.col("event_type") != "error", F.col("event_type")), ["user_id"], ["pos", "event_id"]))
    d = c.withColumns({"before": F.lag("state").over(w), "since": F.lag("pos").over(w)}).filter("before <> state")
    return d.select("user_id", "event_id", "before", "state", ((F.col("since") + F.col("pos")) / 2.0).alias("midpoint"))
