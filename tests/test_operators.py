"""Operators on small cases: sources, paths, discovery, pairs, panels and graphs, against brute force."""

import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import genotype, maths, profiles
from tessera.operators import discovery, graph, joins, painting, pairs, panels, paths, pedigree_hmm, transitions, validation, windows
from tessera.sources import stages, variants

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t10\t.\tA\tG,T\t.\t.\tDP=9;AF=0.25,0.1\tGT:AD\t0/1:3,4,1\t0/0:5,0
chr1\t20\t.\tC\tT\t.\t.\tDP=2\tGT:DP:AD\t./.:.:.\t0/1:3:-1,2
chr2\t5\t.\tC\tT\t.\t.\tAF=.\tGT\t0/0\t0/1
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_vcf(spark, tmp_path, zipped):
    path = tmp_path / ("x.vcf.gz" if zipped else "x.vcf")
    (gzip.open if zipped else open)(path, "wt").write(VCF)
    found = variants.read_vcf(spark, str(path))
    rows = {(r["contig"], r["pos"], r["sample"]): (r["af"], r["ref"], r["alt"], r["alt_allele"]) for r in found.collect()}
    assert rows == {
        ("chr1", 10, "s1"): (0.25, 3, 4, "G"),
        ("chr1", 10, "s2"): (0.25, 5, 0, "G"),
        ("chr1", 20, "s1"): (0.0, 0, 0, "T"),
        ("chr1", 20, "s2"): (0.0, 0, 2, "T"),
        ("chr2", 5, "s1"): (0.0, 0, 0, "T"),
        ("chr2", 5, "s2"): (0.0, 0, 0, "T"),
    }
    assert variants.region(found, "chr1", 10, 20).count() == 2


def test_vcf_of_a_short_line_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.vcf"
    path.write_text(VCF + "chr2\t9\t.\n")
    with pytest.raises(Exception, match="too few"):
        variants.read_vcf(spark, str(path)).collect()


def test_tables_between_stages(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/raw")
    assert stages.first_existing(spark, [f"file://{tmp_path}/fine", f"file://{tmp_path}/raw/"]).count() == 3
    with pytest.raises(FileNotFoundError):
        stages.first_existing(spark, [f"file://{tmp_path}/fine"])
    assert stages.fingerprint({"b": 1, "a": [2]}) == stages.fingerprint({"a": [2], "b": 1})
    yes = spark.createDataFrame([("TRUE",), (" 0",)], "x string").select(stages.strict_boolean("x").alias("b")).collect()
    assert [r["b"] for r in yes] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(stages.strict_boolean("x")).collect()


def test_mendelian_chance(spark):
    p = lambda *x: [F.lit(float(v)) for v in x]
    chance = genotype.mendelian_probability(p(0, 1, 0), p(1, 0, 0), p(0, 0, 1))
    half = genotype.mendelian_probability(p(0, 1, 0), p(0, 1, 0), p(0, 1, 0))
    row = spark.range(1).select(chance.alias("a"), half.alias("b")).first()
    assert row["a"] == 1.0 and row["b"] == 0.5


def test_boundary_rules(spark):
    s = spark.createDataFrame([("k", 0, 10, "a"), ("k", 10, 20, "b")], "k string, start long, end long, owner string")
    p = spark.createDataFrame([("k", x) for x in (0, 9, 10, 19, 20, 25)], "k string, x long")
    got = lambda df: sorted((r["x"], r["owner"]) for r in df.collect())
    assert got(joins.containing(p, s, ["k"], "x", "start", "end", 7)) == [(0, "a"), (9, "a"), (10, "b"), (19, "b")]
    assert got(joins.containing(p, s, ["k"], "x", "start", "end", 7, "right")) == [(9, "a"), (10, "a"), (19, "b"), (20, "b")]
    assert got(joins.containing(p, s, ["k"], "x", "start", "end", 7, "both")) == [(0, "a"), (9, "a"), (10, "a"), (10, "b"), (19, "b"), (20, "b")]
    assert got(joins.first_ending(p, s, ["k"], "x", "start", "end", ["owner"])) == [(0, "a"), (9, "a"), (10, "a"), (19, "b"), (20, "b"), (25, "b")]


def test_likelihoods_without_reads_are_even(spark):
    row = spark.range(1).select(F.array(*genotype.genotype_likelihoods(F.lit(0), F.lit(0), 0.02)).alias("a"), F.array(*genotype.genotype_likelihoods(F.lit(20), F.lit(0), 0.02)).alias("b")).first()
    assert row["a"] == [1 / 3] * 3 and row["b"][0] > 0.999 and abs(sum(row["b"]) - 1) < 1e-12


def test_information_and_sums(spark):
    row = spark.range(1).select(
        maths.from_information(maths.information(F.lit(0.8))).alias("p"),
        maths.combine_probabilities(F.lit(0.7), F.lit(0.5), F.lit(0.5)).alias("c"),
        maths.log_sum_exp(F.array(F.lit(-1000.0), F.lit(-1000.0))).alias("s"),
        maths.log_factorial(F.lit(170)).alias("f"),
        maths.log_haplotype_sets(F.lit(5), F.lit(3)).alias("h"),
    ).first()
    assert abs(row["p"] - 0.8) < 1e-9 and abs(row["c"] - 0.7) < 1e-9 and abs(row["s"] + 1000 - math.log(2)) < 1e-9
    assert abs(row["f"] - math.lgamma(171)) < 1e-9 and abs(row["h"] - math.log(math.comb(32, 3))) < 1e-9


def brute_paths(scores, penalty):
    n, k = scores.shape
    return max(sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(k), repeat=n))


def frame(spark, columns, n, key="s"):
    names = list(columns)
    kinds = {n: "array<long>" if isinstance(c[0], list) else "double" if isinstance(c[0], float) else "boolean" if isinstance(c[0], bool) else "long" for n, c in columns.items()}
    return spark.createDataFrame([(key, i, *(columns[c][i] for c in names)) for i in range(n)], "k string, i long, " + ", ".join(f"{c} {kinds[c]}" for c in names))


@pytest.mark.parametrize("width", [1, 3, 100])
def test_best_paths_are_best_however_they_are_cut(spark, width):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 3))
    df = frame(spark, {f"e{s}": x[:, s].tolist() for s in range(3)}, 7)
    model = paths.flat(["e0", "e1", "e2"], 0.7)
    runs = sorted(paths.best_paths(df, {"k": "string"}, "i", model, width).collect(), key=lambda r: r["start"])
    path = [r["state"] for r in runs for _ in range(r["n"])]
    best = brute_paths(x, 0.7)
    assert abs(runs[0]["score"] - best) < 1e-9 and abs(sum(x[t, s] for t, s in enumerate(path)) - 0.7 * np.count_nonzero(np.diff(path)) - best) < 1e-9
    assert [r["run"] for r in runs] == list(range(1, len(runs) + 1)) and all(a["state"] != b["state"] for a, b in zip(runs, runs[1:]))
    assert abs(paths.scores(df, {"k": "string"}, "i", model, width).first()["score"] - best) < 1e-9
    most = max(sum(x[t, s] for t, s in enumerate(p)) for p in itertools.product(range(3), repeat=7) if sum(a != b for a, b in zip(p, p[1:])) <= 2)
    assert abs(paths.scores(df, {"k": "string"}, "i", paths.bounded(["e0", "e1", "e2"], 2), width).first()["score"] - most) < 1e-9


@pytest.mark.parametrize("width", [2, 100])
def test_the_likelihood_of_strands_sums_all_paths(spark, width):
    rng = np.random.default_rng(4)
    e, t = rng.uniform(0.1, 1, (4, 4)), rng.uniform(0.05, 0.4, 4)
    t[0] = 0.5
    total = 0.0
    for path in itertools.product(range(4), repeat=4):
        p = 0.25 * e[0, path[0]]
        for i in range(1, 4):
            d = bin(path[i - 1] ^ path[i]).count("1")
            p *= t[i] ** d * (1 - t[i]) ** (2 - d) * e[i, path[i]]
        total += p
    df = frame(spark, {f"e{s}": e[:, s].tolist() for s in range(4)} | {"t": t.tolist()}, 4)
    found = paths.scores(df, {"k": "string"}, "i", paths.strands([f"e{s}" for s in range(4)], "t"), width).first()["score"]
    assert abs(found - math.log(total)) < 1e-9


def test_burst_is_the_best_of_all_layouts(spark):
    x = [-0.2, -4.0, -5.0, -0.1]
    opening, extending, uniform = -1.0, -0.1, -0.7
    best = max(
        sum((uniform + extending) + (opening if b and not (i and layout[i - 1]) else 0) if b else x[i] for i, b in enumerate(layout)) for layout in itertools.product((0, 1), repeat=4)
    )
    found = paths.scores(frame(spark, {"e": x}, 4), {"k": "string"}, "i", paths.burst("e", opening, extending, uniform)).first()["score"]
    assert abs(found - best) < 1e-9


def pedigree_by_hand(rows, states, emit, move, burst, error):
    """The best sum over every path of normal states and their bursts; the costs of the first row count."""
    best = -math.inf
    for path in itertools.product(range(2 * states), repeat=len(rows) + 1):
        total = -error if path[0] >= states else 0.0
        for before, now, row in zip(path, path[1:], rows):
            a, b = before % states, now % states
            if now >= states:
                step = (-math.inf if a != b else 0.0 if before >= states else -error) + burst(row)
            else:
                step = (0.0 if a == b else -math.inf) if before >= states else move(row, a, b)
                step += emit(row, now)
            total += step
        best = max(best, total)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_pair_scores_are_the_best_of_all_paths(spark, seed):
    rng, n = np.random.default_rng(seed), 4
    rows = [{**{c: int(rng.integers(-1 if seed % 2 else 0, 2)) for c in ("c1", "c2", "p1", "p2")}, "hom": bool(rng.integers(0, 2)), "switch": -1.5, "stay": -0.1} for _ in range(n)]
    miss = lambda a, b: 0.0 if a < 0 or b < 0 or a == b else -4.605170

    def move(r, a, b):
        if a == b:
            return r["stay"]
        flip = 0.0 if r["hom"] else -3.0
        return {1: r["stay"] + flip, 2: r["switch"], 3: -math.inf}[a ^ b]

    expected = pedigree_by_hand(rows, 4, lambda r, s: miss(r[f"c{1 + (s & 1)}"], r[f"p{1 + (s >> 1)}"]), move, lambda r: -0.693147, 2.0)
    df = frame(spark, {c: [r[c] for r in rows] for c in rows[0]}, n)
    for width in (2, 100):
        assert abs(paths.scores(df, {"k": "string"}, "i", pedigree_hmm.pair(2.0, 3.0), width).first()["score"] - expected) < 1e-9


@pytest.mark.parametrize("many", [False, True])
def test_trio_scores_are_the_best_of_all_paths(spark, many):
    rng, n = np.random.default_rng(5), 3
    names = ("c1", "c2", "p1", "p2", "q1", "q2")
    cell = lambda: [int(x) for x in rng.integers(-1, 2, 2)] if many else int(rng.integers(-1, 2))
    rows = [{**{c: cell() for c in names}, "hom": bool(rng.integers(0, 2)), "switch": -1.5, "stay": -0.1} for _ in range(n)]

    def miss(r, a, b):
        if not many:
            return 0.0 if r[a] < 0 or r[b] < 0 or r[a] == r[b] else -4.605170
        return sum(-4.605170 for k in range(2) if min(r[c][k] for c in names) >= 0 and r[a][k] != r[b][k])

    def emit(r, s):
        phase, one, two = s >> 2, s >> 1 & 1, s & 1
        return miss(r, f"c{1 + phase}", f"p{1 + one}") + miss(r, f"c{2 - phase}", f"q{1 + two}")

    def move(r, a, b):
        turns = ((a ^ b) & 1) + ((a ^ b) >> 1 & 1)
        return turns * r["switch"] + (2 - turns) * r["stay"] + r["stay"] + (0.0 if not (a ^ b) >> 2 or r["hom"] else -3.0)

    burst = lambda r: -1.386 * (max(1, sum(min(r[c][k] for c in names) >= 0 for k in range(2))) if many else 1)
    expected = pedigree_by_hand(rows, 8, emit, move, burst, 2.0)
    df = frame(spark, {c: [r[c] for r in rows] for c in rows[0]}, n)
    assert abs(paths.scores(df, {"k": "string"}, "i", pedigree_hmm.trio(2.0, 3.0), 2).first()["score"] - expected) < 1e-9


def test_painting_is_the_best_of_all_paths_and_a_swap_is_no_segment(spark):
    rng, founders, bins = np.random.default_rng(7), 2, 5
    e = rng.normal(size=(bins, founders**2)) * 3
    centre = np.array([0.0, 1e5, 2e5, 9e5, 1e6])
    best = -math.inf
    for path in itertools.product(range(founders**2), repeat=bins):
        total = e[0, path[0]]
        for t in range(1, bins):
            theta = min(max((centre[t] - centre[t - 1]) * 1e-6, 1e-15), 0.5)
            switch, stay = math.log(theta) - 0.4, math.log(1 - theta)
            turns = sum(a != b for a, b in zip(divmod(path[t], founders), divmod(path[t - 1], founders)))
            total += (2 * stay, switch + stay, 1.5 * switch)[turns] + e[t, path[t]]
        best = max(best, total)
    rows = [("s", t, float(centre[t]), int(k // founders), int(k % founders), float(e[t, k])) for t in range(bins) for k in range(founders**2)]
    df = spark.createDataFrame(rows, "k string, bin long, centre double, h1 int, h2 int, log_emission double")
    found = painting.painted(df, {"k": "string"}, "bin", "centre", founders, 1e-6, 0.4).collect()
    assert abs(found[0]["score"] - best) < 1e-9 and sum(r["n"] for r in found) == bins
    found.sort(key=lambda r: r["seg"])
    assert all({a["h1"], a["h2"]} != {b["h1"], b["h2"]} or sorted((a["h1"], a["h2"])) != sorted((b["h1"], b["h2"])) for a, b in zip(found, found[1:]))


def test_crossovers_pass_over_bursts(spark):
    runs = spark.createDataFrame([("c", 1, 0, 0, 4), ("c", 2, 8, 5, 6), ("c", 3, 2, 7, 9), ("c", 4, 7, 10, 12)], "k string, run long, state long, start long, end long")
    found = sorted((r["parent"], r["midpoint"], r["before"], r["after"]) for r in painting.crossovers(runs, ["k"]).collect())
    assert found == [(1, 5.5, 0, 1), (2, 9.5, 0, 1)]


@pytest.mark.parametrize("side", [3, 1000])
def test_blocked_pairs_are_all_pairs(spark, side):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (20, 16)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i % 2, i, [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")

    def compare(a, b):
        known, differ = pairs.signs_apart(a, b)
        return {"known": known, "differ": differ, "kept": differ < 9}

    found = {(r["a"], r["b"]): (r["known"], r["differ"]) for r in pairs.blocked(df, ["g"], "id", "v", compare, "known long, differ long", side).collect()}
    expected = {}
    for a, b in itertools.combinations(range(20), 2):
        both = ~np.isnan(x[a]) & ~np.isnan(x[b])
        if a % 2 == b % 2 and (x[a] != x[b])[both].sum() < 9:
            expected[a, b] = (both.sum(), (x[a] != x[b])[both].sum())
    assert found == expected


def test_leaders_are_those_of_the_greedy_order(spark):
    rng = np.random.default_rng(9)
    near = {(a, b) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.1}
    kept = []
    for i in range(30):
        if not any((k, i) in near for k in kept):
            kept.append(i)
    found = pairs.first_of_near(spark.range(30).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(near), "a long, b long"), graph.written)
    assert sorted(r["node"] for r in found.collect()) == kept


def test_asof_and_counted_windows_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(10)
    left = spark.createDataFrame([(int(k), int(x)) for k, x in rng.integers(0, [2, 200], (80, 2))], "k long, x long")
    right = spark.createDataFrame(sorted({(int(k), int(y)) for k, y in rng.integers(0, [2, 200], (12, 2))}), "k long, y long").withColumn("v", F.col("y") * 10)
    for forward in (False, True):
        one, two = (sorted(map(str, joins.asof(left, right, ["k"], "x", "y", ["v"], forward, w).collect())) for w in (None, 7))
        assert one == two
    one, two = (sorted(map(str, joins.nearest(left, right, ["k"], "x", "y", ["v"], w).collect())) for w in (None, 7))
    assert one == two
    one, two = (sorted(map(str, windows.counted(left.distinct(), ["k"], ["x"], 5, 2, width=w).collect())) for w in (None, 7))
    assert one == two


def test_cycles_are_resolved_by_children_and_score(spark):
    rows = [(1, 3, None, 0.9), (2, 1, None, 0.8), (3, 2, None, 0.7), (4, 3, None, 0.1), (5, 3, 1, 0.1), (6, 7, None, None), (7, 6, None, 0.5), (8, None, None, 0.0), (9, 9, 8, 1.0)]
    found = graph.resolve_cycles(spark.createDataFrame(rows, "c long, p long, q long, s double"), "c", ["p", "q"], "s")
    parents = {r["c"]: (r["p"], r["q"]) for r in found.collect()}
    # 3 has three children, most on its cycle; 6 and 7 have one each and 6 scores lower (0); 9 is its own parent
    assert parents == {1: (3, None), 2: (1, None), 3: (None, None), 4: (3, None), 5: (3, 1), 6: (None, None), 7: (6, None), 8: (None, None), 9: (None, None)}


def test_bijections_beams_and_duplicates(spark):
    df = spark.createDataFrame([("g", 0, 0, 0.9), ("g", 0, 1, 0.9), ("g", 1, 0, 0.95), ("g", 2, 1, 0.2), ("g", 2, 0, 0.99)], "k string, a long, b long, s double")
    assert {r["a"]: r["b"] for r in validation.bijection(df, {"k": "string"}, "a", "b", "s").collect()} == {2: 0, 0: 1, 1: None}
    v = spark.createDataFrame([("g", 0, 1.0, [0, 0, 0, 0]), ("g", 1, 0.9, [0, 0, 0, 0]), ("g", 2, 0.1, [1, 1, 1, 1]), ("h", 5, 0.0, [1, 0, 0, 0])], "k string, id long, s double, v array<int>")
    found = sorted((r["k"], r["place"], r["id"]) for r in panels.diverse_beam(v, {"k": "string"}, "id", "s", "v", 2, 0.5).collect())
    assert found == [("g", 0, 0), ("g", 1, 2), ("h", 0, 5)]
    rows = spark.createDataFrame([("g", 0, "0000000000", 0.5), ("g", 1, "0000000001", 0.9), ("g", 2, "1111111111", 0.1)], "k string, hap long, row string, sharpness double")
    assert sorted((r["slot"], r["hap"]) for r in panels.without_duplicates(rows, {"k": "string"}, "hap", 20.0).collect()) == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="repeated key"):
        validation.one_to_one(df.select("a"), df.select("a", "s"), ["a"]).collect()
    assert abs(validation.t_quantile(2) - 12.706204736) < 1e-6 and abs(validation.t_quantile(31) - 2.042272456) < 1e-6


def test_discovery_finds_planted_haplotypes(spark):
    rng = np.random.default_rng(5)
    haps = rng.integers(0, 2, (3, 40))
    rows = []
    for s in range(30):
        g = haps[s % 3] + haps[(s // 3) % 3]
        for site, d in enumerate(g):
            p = np.full(3, 0.01)
            p[d] = 0.98
            rows.append(("b", s, site, *map(float, p)))
    df = spark.createDataFrame(rows, "block string, sample long, site long, p0 double, p1 double, p2 double")
    found = {}
    for r in discovery.discover(df, "block", "string", "sample", "site", graph.written).collect():
        found.setdefault(r["hap"], {})[r["site"]] = r["allele"]
    assert sorted([x[i] for i in range(40)] for x in found.values()) == sorted(haps.tolist())


def test_outliers(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([1, 1.1, 0.9, 1.05, 9])], "k string, i int, v double")
    assert [r["i"] for r in discovery.outliers(df, ["k"], "v").collect()] == [4]


def test_discovery_grows_as_far_as_the_cost_falls(spark):
    rng = np.random.default_rng(11)
    haps = rng.integers(0, 2, (11, 40))
    rows = []
    for sample in range(88):
        g = 2 * haps[sample % 11]
        rows += [(1, sample, site, *[0.98 if g[site] == a else 0.01 for a in range(3)]) for site in range(40)]
    df = spark.createDataFrame(rows, "block int, sample long, site long, p0 double, p1 double, p2 double")
    found: dict = {}
    for r in discovery.discover(df, "block", "int", "sample", "site", graph.written).collect():
        found.setdefault(r["hap"], {})[r["site"]] = r["allele"]
    assert {tuple(h[s] for s in range(40)) for h in found.values()} >= {tuple(h) for h in haps.tolist()}


def test_graphs(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (5, 6), (6, 5), (7, 5)], "child long, parent long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r["node"]: r["generation"] for r in graph.generations(edges, nodes).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: None, 6: None, 7: None}
    assert {r["node"] for r in graph.on_cycles(edges).collect()} == {5, 6}


def test_graphs_of_any_depth(spark):
    chain = [(i + 1, i) for i in range(1, 14)] + [(14, 1), (20, 14), (20, 21), (21, 20)]
    edges = spark.createDataFrame(chain, "child long, parent long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 15), 20, 21]], "node long")
    expected = {i: i for i in range(1, 15)} | {20: None, 21: None}
    assert {r["node"]: r["generation"] for r in graph.generations(edges, nodes).collect()} == expected
    assert {r["generation"] for r in graph.generations(edges.filter("child > 19 and parent > 19"), nodes.filter("node > 19")).collect()} == {None}
    assert {r["node"] for r in graph.on_cycles(edges.union(spark.createDataFrame([(100 + i, 99 + i) for i in range(45)], edges.schema))).collect()} == {20, 21}


def test_windows_and_profiles(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "x long")
    assert [r["x"] for r in windows.systematic(df.withColumn("k", F.lit(1)), ["k"], ["x"], 5).orderBy("x").collect()] == [i * 23 // 5 for i in range(5)]
    held = {(r["x"], r["block_id"]) for r in windows.sliding(df, "x", 10, 4).collect()}
    assert held == {(x, k) for x in range(23) for k in range(7) if 4 * k <= x < 4 * k + 10}
    p = spark.createDataFrame([("a", 0.0, 0.5, 1.0), ("a", 0.5, 1.0, 3.0), ("b", 0.0, 0.4, 1.0), ("b", 0.5, 1.0, 1.0)], "c string, s double, e double, m double")
    assert [r["c"] for r in profiles.faults(p, "c", "s", "e").collect()] == ["b"]
    rates = {r["s"]: r["rate"] for r in profiles.resolved(p.filter("c = 'a'"), "c", "s", "e", "m", 2.0).collect()}
    assert rates == {0.0: 1.0, 0.5: 3.0}


def test_smoothing_keeps_new_edges(spark):
    old = spark.createDataFrame([(1, 0.5)], "k int, p double")
    new = spark.createDataFrame([(1, 1.0), (2, 0.4)], "k int, p double")
    assert {r["k"]: r["p"] for r in transitions.smoothed(old, new, ["k"], 0.1).collect()} == {1: 0.55, 2: 0.4}


def test_phred_reader(spark, tmp_path):
    path = tmp_path / "pl.vcf"
    path.write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t1\t.\tA\tG\t.\t.\t.\tGT:PL\t0/1:10,0,30\t0/0:-1,2,3\nchr1\t1\t.\tA\tG\t.\t.\t.\tGT\t0/1\t0/0\n")
    found = variants.read_phred(spark, str(path))
    assert sorted((r["sample"], r["pl0"], r["pl1"], r["pl2"]) for r in found.collect()) == [("s1", 0, 0, 0), ("s1", 10, 0, 30), ("s2", 0, 0, 0), ("s2", 0, 0, 0)]
    assert [tuple(r) for r in variants.repeated_positions(found).collect()] == [("chr1", 1)]


def test_cohort_tables(spark, tmp_path):
    from tessera.sources import cohort

    m = spark.createDataFrame([("b", "F0", "M", None), ("a", "F0", "F", "x"), ("c", "F1", "F", "y"), (None, "F1", "M", "z"), ("c", "F1", "M", "w")], "name string, gen string, sex string, alias string")
    assert [(r["sample_index"], r["name"], r["alias"]) for r in cohort.ordered(m, "name", ["a", "b"]).orderBy("sample_index").collect()] == [(0, "a", "x"), (1, "b", "")]
    assert {(r["name"], r["rows"]) for r in cohort.unmatched(m, "name", ["a", "c", "d"]).collect()} == {("c", 2), ("d", 0)}
    assert [tuple(r) for r in cohort.candidates(m, "name", "gen", "sex", "F0").collect()] == [(0, "b", "a")]
    p = spark.createDataFrame([("k", "b", "a", "M"), ("a", None, None, "F"), ("b", "b", "z", "M"), ("l", "a", None, "F")], "child string, f string, m string, sex string")
    assert {(r["child"], r["slot"], r["fault"]) for r in cohort.invalid_references(p, "child", {"f": "M", "m": "F"}, "sex").collect()} == {("b", "f", "itself"), ("b", "m", "unknown"), ("l", "f", "sex")}
    row = spark.range(1).select(cohort.generation_of(F.lit("F2_007")).alias("g"), cohort.squeezed(F.lit(" a \t b ")).alias("s"), cohort.depth_label(F.lit(5.0)).alias("d"), cohort.depth_label(F.lit(0.5)).alias("e")).first()
    assert tuple(row) == ("F2", "a b", "5", "0.5")
    (tmp_path / "seeds.csv").write_text("child,father,mother,seed_basis,seed_status,report_parent_edges\nc,b,a,x,ok,true\nc,b,a,x,ok,true\n")
    with pytest.raises(Exception, match="a child twice"):
        cohort.read_seeds(spark, str(tmp_path / "seeds.csv")).collect()
