"""Queries over hidden states along rows: likelihoods, best paths, pedigree scores, painting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import painting, paths, pedigree_hmm
from .registry import query
from .tables import MARKS, marks, table


def folded(source: str, key: str, states: int, start: list[str], move: dict[tuple[int, int], str], emit: list[str], out: str = "score", total: str | None = None) -> str:
    """SQL of a fold over rows (key, i, ...) of the CTE `src`: v_j = greatest over i of (v_i + move[i, j]) + emit[j]. `source` defines src."""
    before = [f"({x})::DOUBLE" for x in start]

    def step(values: list[str]) -> str:
        into = lambda j: [f"{values[i]} + {m}" for (i, k), m in move.items() if k == j]
        return ", ".join(f"({'greatest(' + ', '.join(into(j)) + ')' if len(into(j)) > 1 else into(j)[0]} + {emit[j]})::DOUBLE" for j in range(states))

    names = [f"v{j}" for j in range(states)]
    return f"""WITH RECURSIVE {source}, f({key}, i, {', '.join(names)}) AS (SELECT {key}, i, {step(before)} FROM src WHERE i = 1
UNION ALL SELECT src.{key}, src.i, {step([f'f.{n}' for n in names])} FROM f JOIN src ON src.{key} = f.{key} AND src.i = f.i + 1)
SELECT {key}, i AS n, round({total or f"greatest({', '.join(names)})"}, 6) AS {out} FROM f QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i DESC) = 1"""


def _emissions(spark, sf_dir):
    """(user_id, i, e0, e1, t): chances of two states at each event, and of a switch on the way to it."""
    w = Window.partitionBy("user_id").orderBy("pos", "event_id")
    rows = marks(spark, sf_dir).withColumns({"i": F.row_number().over(w), "gap": F.col("pos") - F.lag("pos").over(w)})
    good = F.when(F.col("event_type").isin("click", "view"), 0.8).otherwise(0.3)
    return rows.select("user_id", F.col("i").cast("long").alias("i"), good.alias("e0"), (1 - good).alias("e1"), F.coalesce(0.5 * (1 - F.exp(-2e-5 * F.col("gap"))), F.lit(0.5)).alias("t"))


_SRC = f"""{MARKS}, m AS (SELECT user_id, row_number() OVER w AS i, pos - lag(pos) OVER w AS gap, CASE WHEN event_type IN ('click', 'view') THEN 0.8 ELSE 0.3 END AS g FROM marks WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
src AS (SELECT user_id, i, g::DOUBLE AS e0, 1 - g::DOUBLE AS e1, coalesce(0.5 * (1 - exp(-2e-5 * gap)), 0.5) AS t FROM m)"""
_USER = {"user_id": "long"}


def _likelihood(bits: int) -> str:
    n = 1 << bits
    chance = lambda i, j: " * ".join("t" if (i ^ j) >> b & 1 else "(1 - t)" for b in range(bits))
    e = lambda j: " * ".join(f"e{j >> b & 1}" for b in range(bits))
    x = lambda p: [f"({' + '.join(f'{p[i]} * {chance(i, j)}' for i in range(n))}) * {e(j)}" for j in range(n)]
    names, sums = [f"p{j}" for j in range(n)], " + ".join(f"x{j}" for j in range(n))
    cols = ", ".join(f"x{j} / ({sums})" for j in range(n))
    first = ", ".join(f"{v} AS x{j}" for j, v in enumerate(x([str(1.0 / n)] * n)))
    after = ", ".join(f"{v} AS x{j}" for j, v in enumerate(x([f"f.{c}" for c in names])))
    return f"""WITH RECURSIVE {_SRC}, f(user_id, i, {', '.join(names)}, log) AS (SELECT user_id, i, {cols}, ln({sums}) FROM (SELECT *, {first} FROM src WHERE i = 1)
UNION ALL SELECT user_id, i, {cols}, log + ln({sums}) FROM (SELECT src.user_id, src.i, f.log, {after} FROM f JOIN src ON src.user_id = f.user_id AND src.i = f.i + 1))
SELECT user_id, i AS n, round(log, 6) AS log_likelihood FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


def _rounded(df, out="score"):
    return df.withColumnRenamed("score", out).withColumn(out, F.round(out, 6))


@query(_likelihood(1))
def q_forward_2state(spark, sf_dir):
    """The forward likelihood of a user's events under two states."""
    return _rounded(paths.scores(_emissions(spark, sf_dir), _USER, "i", paths.strands(["e0", "e1"], "t")), "log_likelihood")


@query(_likelihood(2))
def q_forward_4state(spark, sf_dir):
    """The forward likelihood under two strands of two states."""
    rows = _emissions(spark, sf_dir).withColumns({f"s{k}": F.col(f"e{k >> 1}") * F.col(f"e{k & 1}") for k in range(4)})
    return _rounded(paths.scores(rows, _USER, "i", paths.strands([f"s{k}" for k in range(4)], "t")), "log_likelihood")


_PAINT = f"""WITH RECURSIVE {_SRC}, f(user_id, i, a, b, pa, pb) AS (SELECT user_id, i, ln(e0), ln(e1), '0', '1' FROM src WHERE i = 1
UNION ALL SELECT src.user_id, src.i, greatest(a, b - 3) + ln(e0), greatest(a - 3, b) + ln(e1), CASE WHEN a >= b - 3 THEN pa ELSE pb END || '0', CASE WHEN a - 3 >= b THEN pa ELSE pb END || '1' FROM f JOIN src ON src.user_id = f.user_id AND src.i = f.i + 1),
best AS (SELECT user_id, i AS n, greatest(a, b) AS score, CASE WHEN a >= b THEN pa ELSE pb END AS path FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1),
s AS (SELECT user_id, score, unnest(range(1, n + 1)) AS i, path FROM best), t AS (SELECT user_id, score, i, CAST(substr(path, i, 1) AS BIGINT) AS state FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM t))
SELECT user_id, CAST(run AS BIGINT) AS run, state, min(i) AS "start", max(i) AS "end", count(*) AS n, round(any_value(score), 6) AS score FROM r GROUP BY user_id, run, state"""


@query(_PAINT)
def q_viterbi_paint(spark, sf_dir):
    """The best segmentation of a user's events into two states, a switch costing 3."""
    rows = _emissions(spark, sf_dir).withColumns({"l0": F.ln("e0"), "l1": F.ln("e1")})
    return _rounded(paths.best_paths(rows, _USER, "i", paths.flat(["l0", "l1"], 3.0)))


@query(folded(_SRC, "user_id", 2, ["0.0", "'-inf'::DOUBLE"], {(0, 0): "0", (1, 0): "0", (0, 1): "-3.0", (1, 1): "0"}, ["ln(e0)", "-0.8"]))
def q_burst_score(spark, sf_dir):
    """The score of a user's events where stretches may be left to a burst."""
    rows = _emissions(spark, sf_dir).withColumn("l0", F.ln("e0"))
    return _rounded(paths.scores(rows, _USER, "i", paths.burst("l0", -3.0, -0.1, -0.7)))


_SWITCHES = {(2 * r + s, 2 * q + u): "0" for r in range(4) for s in (0, 1) for q in range(4) for u in (0, 1) if (q == r and u == s) or (q == r + 1 and u != s)}


@query(folded(_SRC, "user_id", 8, ["0.0"] * 2 + ["'-inf'::DOUBLE"] * 6, _SWITCHES, ["ln(e0)", "ln(e1)"] * 4))
def q_bounded_switches(spark, sf_dir):
    """The best score of a user's events with at most three switches of state."""
    rows = _emissions(spark, sf_dir).withColumns({"l0": F.ln("e0"), "l1": F.ln("e1")})
    return _rounded(paths.scores(rows, _USER, "i", paths.bounded(["l0", "l1"], 3)))


def _families(spark, sf_dir):
    """(child, bits, f, m): each vector with the two before it as parents, by the signs of their components."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("long")).alias("bits"))
    one = lambda name, back: v.select((F.col("vec_id") + back).alias("child"), F.col("bits").alias(name))
    return one("bits", 0).join(one("f", 2), "child").join(one("m", 1), "child")


_FAMILY = "v AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding] AS w FROM embeddings), fam AS (SELECT c.vec_id AS child, c.w AS c, f.w AS f, m.w AS m FROM v c JOIN v f ON f.vec_id = c.vec_id - 2 JOIN v m ON m.vec_id = c.vec_id - 1)"
_STEP = {"switch": "-3.0", "stay": "-0.05"}


def _bins(spark, sf_dir):
    """A family's alleles in 32 bins, two strands of each, with the costs of a switch and of none."""
    rows = _families(spark, sf_dir).select("child", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"), "bits", "f", "m")
    one = lambda c, k: F.get(c, F.col("k") + k).alias
    cells = rows.select("child", (F.col("k") + 1).cast("long").alias("i"), one("bits", 0)("c1"), one("bits", 32)("c2"), one("f", 0)("p1"), one("f", 32)("p2"), one("m", 0)("q1"), one("m", 32)("q2"))
    return cells.withColumns({"hom": F.col("c1") == F.col("c2"), "switch": F.lit(-3.0), "stay": F.lit(-0.05)})


_BINS = f"{_FAMILY}, src AS (SELECT child, i, c[i] AS c1, c[i + 32] AS c2, f[i] AS p1, f[i + 32] AS p2, m[i] AS q1, m[i + 32] AS q2, CASE WHEN c[i] = c[i + 32] THEN 0.0 ELSE -50.0 END AS flip FROM fam, range(1, 33) r(i))"


def _sites(spark, sf_dir):
    """The same with 16 bins of two sites each; every ninth child's second site is missing."""
    rows = _families(spark, sf_dir).select("child", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"), "bits", "f", "m")
    two = lambda c, k: F.array(F.get(c, 2 * F.col("k") + k), F.get(c, 2 * F.col("k") + k + 1)).alias
    lost = lambda c, k: F.array(F.get(c, 2 * F.col("k") + k), F.when(F.col("child") % 9 > 0, F.get(c, 2 * F.col("k") + k + 1))).alias
    cells = rows.select("child", (F.col("k") + 1).cast("long").alias("i"), lost("bits", 0)("c1"), two("bits", 32)("c2"), two("f", 0)("p1"), two("f", 32)("p2"), two("m", 0)("q1"), two("m", 32)("q2"))
    return cells.withColumns({"hom": F.get("c1", F.lit(0)) == F.get("c2", F.lit(0)), "switch": F.lit(-3.0), "stay": F.lit(-0.05)})


_SITES = f"{_FAMILY}, src AS (SELECT child, i, {', '.join(f'{v}[2 * i - 1 + {k}] AS {n}a, {v}[2 * i + {k}] AS {n}b' for n, v, k in (('c1', 'c', 0), ('c2', 'c', 32), ('p1', 'f', 0), ('p2', 'f', 32), ('q1', 'm', 0), ('q2', 'm', 32)))}, child % 9 > 0 AS whole, CASE WHEN c[2 * i - 1] = c[2 * i + 31] THEN 0.0 ELSE -50.0 END AS flip FROM fam, range(1, 17) r(i))"
_MISS = -4.605170


def _differ(a: str, b: str, many: bool) -> str:
    one = lambda x, y: f"CASE WHEN {x} <> {y} THEN {_MISS} ELSE 0 END"
    return f"({one(a + 'a', b + 'a')} + CASE WHEN whole THEN {one(a + 'b', b + 'b')} ELSE 0 END)" if many else one(a, b)


def _pedigree_sql(source: str, normal: int, pairs: list[list[tuple[str, str]]], moves: dict[tuple[int, int], str], burst: float, many: bool) -> str:
    sites = "(CASE WHEN whole THEN 2 ELSE 1 END)" if many else "1"
    emit = ["(" + " + ".join(_differ(a, b, many) for a, b in p) + ")" for p in pairs] + [f"({burst} * {sites})"] * normal
    move = dict(moves)
    for s in range(normal):
        move |= {(normal + s, s): "0.0", (s, normal + s): "-8.0", (normal + s, normal + s): "0.0"}
    return folded(source, "child", 2 * normal, ["0.0"] * normal + ["-8.0"] * normal, move, emit)


_ONE = [[(f"c{1 + (s & 1)}", f"p{1 + (s >> 1)}")] for s in range(4)]
_ONE_MOVES = {(i, j): {0: "-0.05", 1: "(flip - 0.05)", 2: "-3.0"}[i ^ j] for i in range(4) for j in range(4) if i ^ j < 3}
_TWO = [[(f"c{1 + (s >> 2)}", f"p{1 + (s >> 1 & 1)}"), (f"c{2 - (s >> 2)}", f"q{1 + (s & 1)}")] for s in range(8)]
_TWO_MOVES = {(i, j): f"({'flip + ' if (i ^ j) >> 2 else ''}{-3.0 * t - 0.05 * (3 - t):.4f})" for i in range(8) for j in range(8) for t in [((i ^ j) & 1) + ((i ^ j) >> 1 & 1)]}
_CHILD = {"child": "long"}


@query(_pedigree_sql(_BINS, 4, _ONE, _ONE_MOVES, -0.693147, False))
def q_parent_child_score(spark, sf_dir):
    """Each vector against the one two before it as its parent."""
    return _rounded(paths.scores(_bins(spark, sf_dir), _CHILD, "i", pedigree_hmm.pair(8.0, 50.0)))


@query(_pedigree_sql(_BINS, 8, _TWO, _TWO_MOVES, -1.386, False))
def q_trio_score(spark, sf_dir):
    """Each vector against the two before it as its parents."""
    return _rounded(paths.scores(_bins(spark, sf_dir), _CHILD, "i", pedigree_hmm.trio(8.0, 50.0)))


@query(_pedigree_sql(_SITES, 4, _ONE, _ONE_MOVES, -0.693147, True))
def q_parent_child_score_sites(spark, sf_dir):
    """The same with two sites a bin."""
    return _rounded(paths.scores(_sites(spark, sf_dir), _CHILD, "i", pedigree_hmm.pair(8.0, 50.0)))


@query(_pedigree_sql(_SITES, 8, _TWO, _TWO_MOVES, -1.386, True))
def q_trio_score_sites(spark, sf_dir):
    return _rounded(paths.scores(_sites(spark, sf_dir), _CHILD, "i", pedigree_hmm.trio(8.0, 50.0)))


@query(None)
def q_trio_crossovers(spark, sf_dir):
    """Where a child's strand changes from one strand of a parent to the other, on the best path of its trio; bursts are passed over."""
    runs = paths.best_paths(_bins(spark, sf_dir), _CHILD, "i", pedigree_hmm.trio(8.0, 50.0))
    return painting.crossovers(runs, ["child"])


_FOUNDERS = """founders AS (SELECT label, hap, site, CASE WHEN avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1 ELSE 0 END AS allele FROM (SELECT e.*, (CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END) + (CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END) AS hap FROM cells e JOIN embeddings USING (vec_id, label)) GROUP BY label, hap, site)"""
CELLS = "cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS site, unnest(embedding)::DOUBLE AS x FROM embeddings), posts AS (SELECT *, (1-q)*(1-q) AS p0, 2*q*(1-q) AS p1, q*q AS p2 FROM (SELECT *, 1 / (1 + exp(-8 * x)) AS q FROM cells))"
FOUNDERS = f"{CELLS}, {_FOUNDERS}"


def cells(spark, sf_dir):
    """(vec_id, label, site, x, p0, p1, p2): the components of the vectors, and genotype chances made of them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("site", "x")).withColumn("x", F.col("x").cast("double"))
    q = 1 / (1 + F.exp(-8 * F.col("x")))
    return e.withColumns({"p0": (1 - q) * (1 - q), "p1": 2 * q * (1 - q), "p2": q * q})


def founder_alleles(spark, sf_dir):
    """(label, hap, site, allele): up to four founders of each label, the majority signs of its vectors with the same two first signs."""
    e = table(spark, sf_dir, "embeddings")
    hap = F.when(F.get("embedding", F.lit(0)) > 0, 2).otherwise(0) + F.when(F.get("embedding", F.lit(1)) > 0, 1).otherwise(0)
    x = e.select("label", hap.alias("hap"), F.posexplode("embedding").alias("site", "x"))
    return x.groupBy("label", "hap", "site").agg((F.avg((F.col("x") > 0).cast("double")) > 0.5).cast("int").alias("allele"))


_EMIT = f"""WITH {FOUNDERS}, bins AS (SELECT site, ntile(16) OVER (ORDER BY site) - 1 AS bin FROM (SELECT DISTINCT site FROM cells)),
g AS (SELECT u.label, u.site, u.hap AS h1, v.hap AS h2, u.allele + v.allele AS g FROM founders u JOIN founders v ON u.label = v.label AND u.site = v.site)
SELECT vec_id AS sample, bin, h1, h2, round(sum(greatest(ln(greatest((CASE g WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) * 0.99 + 0.01 / 3, 1e-300)), -50.0)), 6) AS log_emission
FROM posts p JOIN g USING (label, site) JOIN bins USING (site) GROUP BY vec_id, bin, h1, h2"""


def _emission_table(spark, sf_dir):
    return painting.binned_emissions(cells(spark, sf_dir).withColumnRenamed("vec_id", "sample"), founder_alleles(spark, sf_dir), ["label"], "sample", "site", 4)


@query(_EMIT)
def q_binned_emissions(spark, sf_dir):
    """The log emission of each ordered pair of founders in each bin of four sites."""
    return _emission_table(spark, sf_dir).select("sample", "bin", "h1", "h2", F.round("log_emission", 6).alias("log_emission"))


@query(None)
def q_diploid_painting(spark, sf_dir):
    """Each vector painted with pairs of its label's founders; a swap of the two is no new segment."""
    e = _emission_table(spark, sf_dir).withColumn("centre", F.col("bin") * 4e5)
    found = painting.painted(e, {"sample": "long"}, "bin", "centre", 4, 1e-8, 0.1 * 4)
    return found.withColumn("score", F.round("score", 5))
