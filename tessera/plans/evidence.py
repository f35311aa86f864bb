"""Queries over reads, genotype evidence, maps and model costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genotype, maths
from ..operators import discovery, graph, pairs, windows
from ..sources.variants import keep_flags
from .paths import FOUNDERS, cells, founder_alleles
from .registry import query
from .tables import READS, marks, reads, table

ERROR = 0.02


def _raw(error: float = ERROR) -> str:
    """SQL of normalised read likelihoods from ref and alt."""
    logs = [f"(ref * ln({1 - p}) + alt * ln({p}))" for p in (error, 0.5, 1 - error)]
    top = f"greatest({', '.join(logs)})"
    parts = [f"exp({x} - {top})" for x in logs]
    return ", ".join(f"CASE WHEN ref + alt = 0 THEN 1.0/3 ELSE {p} / ({' + '.join(parts)}) END AS p{i}" for i, p in enumerate(parts))


@query(f"WITH {READS} SELECT site, sample, line, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2 FROM (SELECT *, {_raw()} FROM reads)")
def q_geno_likelihood(spark, sf_dir):
    """Normalised likelihoods of the three genotypes of each site and sample."""
    p = genotype.genotype_likelihoods("ref", "alt", ERROR)
    return reads(spark, sf_dir).select("site", "sample", "line", *[F.round(x, 9).alias(f"p{i}") for i, x in enumerate(p)])


#: Rows of a task.
ROWS = 1 << 20


def _by_rows(df, n, *by):
    """The rows dealt to tasks that are the more the more rows there are, so that what one of them sorts and sums stays as it is."""
    return df.repartition(max(pairs.tasks(df), -(-n // ROWS)), *by)


def _posteriors(spark, sf_dir):
    """Posteriors under a Hardy-Weinberg prior at each site's frequency, (1 + alt) / (2 + reads)."""
    rows = _by_rows(reads(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "site")
    site = rows.groupBy("site").agg(((1 + F.sum("alt")) / (2 + F.sum(F.col("ref") + F.col("alt")))).alias("frequency"))
    p = genotype.hardy_weinberg_posteriors("ref", "alt", "frequency", ERROR)
    return rows.join(site, "site").select("site", "sample", "line", *[x.alias(f"p{i}") for i, x in enumerate(p)])


def _hwe() -> str:
    logs = [f"(ref * ln({1 - p}) + alt * ln({p}) + ln({prior}))" for p, prior in ((ERROR, "(1-q)*(1-q)"), (0.5, "2*q*(1-q)"), (1 - ERROR, "q*q"))]
    top = f"greatest({', '.join(logs)})"
    parts = [f"exp({x} - {top})" for x in logs]
    return f"{READS}, sites AS (SELECT site, (1 + sum(alt)) / (2 + sum(ref + alt)) AS q FROM reads GROUP BY site), post AS (SELECT site, sample, line, {', '.join(f'{p} / ({" + ".join(parts)}) AS p{i}' for i, p in enumerate(parts))} FROM reads JOIN sites USING (site))"


@query(f"WITH {_hwe()} SELECT site, sample, line, round(p0, 8) AS p0, round(p1, 8) AS p1, round(p2, 8) AS p2 FROM post")
def q_hwe_posterior(spark, sf_dir):
    return _posteriors(spark, sf_dir).select("site", "sample", "line", *[F.round(f"p{i}", 8).alias(f"p{i}") for i in range(3)])


@query(f"""WITH {_hwe()}, w AS (SELECT *, unnest(range(greatest(0, CAST(floor((site - 100) / 50.0) AS BIGINT) + 1), site // 50 + 1)) AS block_id FROM post WHERE site >= 0)
SELECT block_id, sample, count(*) AS n, round(avg(greatest(p0, p1, p2)), 7) AS confidence,
  sum(CASE WHEN greatest(p0, p1, p2) >= 0.85 THEN 1 ELSE 0 END)::BIGINT AS n_confident FROM w GROUP BY block_id, sample""")
def q_block_confidence(spark, sf_dir):
    """Per block of sites (windows of 100, every 50) and sample, how sure the genotypes are."""
    p = [F.col(f"p{i}") for i in range(3)]
    best = _posteriors(spark, sf_dir).select("site", "sample", F.greatest(*p).alias("best"), genotype.confident_genotype(p).alias("confident"))
    blocks = _by_rows(windows.sliding(best, "site", 100, 50).drop("site"), 2 * table(spark, sf_dir, "lineitem").count(), "block_id", "sample")
    return blocks.groupBy("block_id", "sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("best"), 7).alias("confidence"), F.count("confident").alias("n_confident"))


@query(f"""WITH {READS}, t AS (SELECT site, max(af) AS af, sum(ref + alt) AS reads, count(DISTINCT sample) AS n FROM reads GROUP BY site)
SELECT site, round(af, 6) AS af, CAST(reads AS BIGINT) AS reads, (af BETWEEN 0.05 AND 0.95 AND reads >= greatest(5.0, 0.02 * n)) AS keep FROM t""")
def q_site_keep_flag(spark, sf_dir):
    flags = keep_flags(reads(spark, sf_dir), ["site"], "af", "ref", "alt", "sample", 0.05, ERROR, 5)
    return flags.select("site", F.round("frequency", 6).alias("af"), "reads", "keep")


@query(f"WITH {READS} SELECT site, sample, line, round(pow(10, -0.1 * (ref - l)), 9) AS p0, round(pow(10, -0.1 * (alt - l)), 9) AS p1, round(pow(10, -0.1 * (ref + alt - l)), 9) AS p2 FROM (SELECT *, least(ref, alt, ref + alt) AS l FROM reads)")
def q_phred_likelihood(spark, sf_dir):
    """Phred-scaled penalties to likelihoods."""
    ref, alt = F.col("ref"), F.col("alt")
    return reads(spark, sf_dir).select("site", "sample", "line", *[F.round(x, 9).alias(f"p{i}") for i, x in enumerate(genotype.phred_likelihoods([ref, alt, ref + alt]))])


@query(f"""WITH {_hwe()}, b AS (SELECT site, sample, line, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS g, p1 + 2 * p2 AS dosage, 0.5 * p1 + p2 AS f FROM post)
SELECT g AS genotype, count(*) AS n, round(avg(dosage), 7) AS mean_dosage, round(avg(f), 7) AS mean_fraction, sum(CASE WHEN f < 0.25 THEN 0 WHEN f > 0.75 THEN 2 ELSE 1 END)::BIGINT AS pooled FROM b GROUP BY g""")
def q_dosage(spark, sf_dir):
    p = [F.col(f"p{i}") for i in range(3)]
    fraction = genotype.alt_fraction(p)
    rows = _posteriors(spark, sf_dir).select(genotype.best_genotype(p).alias("genotype"), genotype.dosage(p).alias("d"), fraction.alias("f"), genotype.pooled_dosage(fraction).alias("pooled"))
    return rows.groupBy("genotype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 7).alias("mean_dosage"), F.round(F.avg("f"), 7).alias("mean_fraction"), F.sum("pooled").alias("pooled"))


@query(f"""WITH {_hwe()}, s AS (SELECT site, sample, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM post GROUP BY site, sample)
SELECT a.sample AS a, b.sample AS b, count(*) AS n, round(avg(a.p0*b.p0 + a.p1*b.p1 + a.p2*b.p2), 6) AS agreement,
  round(avg(a.p0*b.p1 + a.p1*b.p0 + a.p1*b.p2 + a.p2*b.p1 + 2*(a.p0*b.p2 + a.p2*b.p0)), 6) AS distance
FROM s a JOIN s b ON a.site = b.site AND a.sample < b.sample GROUP BY a.sample, b.sample""")
def q_sample_agreement(spark, sf_dir):
    """Soft agreement and expected distance of two samples over the sites of both."""

    def made(rows):
        at = Window.partitionBy("site")
        p = genotype.hardy_weinberg_posteriors("ref", "alt", "frequency", ERROR)
        post = rows.withColumn("frequency", (1 + F.sum("alt").over(at)) / (2 + F.sum(F.col("ref") + F.col("alt")).over(at)))
        return post.select("site", "sample", *[x.alias(f"p{i}") for i, x in enumerate(p)]).groupBy("site", "sample").agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in range(3)])

    apart = {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 2.0}
    forms = {"agreement": [(f"p{i}", f"p{i}", 1.0) for i in range(3)], "distance": [(f"p{i}", f"p{j}", w) for (x, y), w in apart.items() for i, j in ((x, y), (y, x))]}
    both = pairs.shared(reads(spark, sf_dir).select("site", "sample", "ref", "alt"), [], "site", "sample", forms, graph.written, made=made)
    return both.select("a", "b", "n", *[F.round(F.col(c) / F.col("n"), 6).alias(c) for c in forms])


@query(f"""WITH {READS}, l AS (SELECT *, {_raw()} FROM reads), f AS (SELECT site, sample, line, p0, p1, p2, 0.1 + 0.02 * alt AS a, 0.9 - 0.02 * alt AS b FROM l)
SELECT sample, count(*) AS n, round(sum(ln(greatest(p0*(1-a)*(1-b) + p1*(a*(1-b)+b*(1-a)) + p2*a*b, 2.2250738585072014e-308))), 4) AS log_score FROM f GROUP BY sample""")
def q_mendelian_score(spark, sf_dir):
    """The log-likelihood of each sample's genotypes, given two parents' transmission chances."""
    p = genotype.genotype_likelihoods("ref", "alt", ERROR)
    rows = reads(spark, sf_dir).withColumns({f"p{i}": x for i, x in enumerate(p)})
    e = genotype.emission([F.col(f"p{i}") for i in range(3)], 0.1 + 0.02 * F.col("alt"), 0.9 - 0.02 * F.col("alt"), 0.0)
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.ln(e)), 4).alias("log_score"))


@query("""WITH d AS (SELECT s_suppkey, abs(s_acctbal) * 1000 AS bp, s_acctbal FROM supplier)
SELECT s_suppkey, round(least(greatest(0.5 * (1 - exp(-2 * bp * 1e-7)), 1e-15), 0.5), 9) AS haldane, round(least(greatest(1 - exp(-bp * 1e-7), 1e-15), 0.5), 9) AS poisson,
  round(least(greatest(bp * 1e-7, 1e-15), 0.5), 9) AS linear FROM d""")
def q_map_functions(spark, sf_dir):
    """The three map functions of a distance, which are never to be mixed up."""
    d = F.abs("s_acctbal") * 1000
    fs = {"haldane": maths.haldane, "poisson": maths.poisson_switch, "linear": maths.linear_switch}
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(f(d, 1e-7), 9).alias(n) for n, f in fs.items()])


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 5 + 0.2 AS a, l_tax * 5 + 0.3 AS b FROM lineitem),
i AS (SELECT *, sign(a - 0.5) * (1 + a * log2(a) + (1 - a) * log2(1 - a)) AS ia, sign(b - 0.5) * (1 + b * log2(b) + (1 - b) * log2(1 - b)) AS ib FROM p)
SELECT l_orderkey, l_linenumber, round(ia, 8) + 0::DOUBLE AS ia, round(ib, 8) + 0::DOUBLE AS ib, round(CASE WHEN abs(ia * ib + 1) < 1e-9 THEN 0 ELSE (ia + ib) / (1 + ia * ib) END, 8) + 0::DOUBLE AS joint FROM i""")
def q_information(spark, sf_dir):
    a, b = maths.information(F.col("l_discount") * 5 + 0.2), maths.information(F.col("l_tax") * 5 + 0.3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(x, 8) + F.lit(0.0)).alias(n) for n, x in (("ia", a), ("ib", b), ("joint", maths.add_information(a, b)))])


@query("""SELECT p_partkey, round(lgamma(p_size + 100 + 1), 7) AS log_factorial, round(lgamma(p_size + 100 + 1) - lgamma(p_size + 1) - lgamma(101), 7) AS log_binomial,
  round(0.5 * (p_size / 200.0) * 320, 7) AS cost, round(3 * (0.5 * (p_size / 200.0) * 320) + 2 * p_retailprice, 6) AS bic, round(-2 * -p_retailprice + (3 * p_size + 2) * ln(320), 6) AS mixture FROM part""")
def q_model_costs(spark, sf_dir):
    n, one = F.col("p_size"), F.lit(1.0)
    cost = maths.complexity_cost(0.5, F.lit(320), n, one)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(maths.log_factorial(n + 100), 7).alias("log_factorial"),
        F.round(maths.log_binomial(n + 100, n), 7).alias("log_binomial"),
        F.round(cost, 7).alias("cost"),
        F.round(maths.outer_bic(F.lit(3), F.col("p_retailprice"), cost), 6).alias("bic"),
        F.round(maths.mixture_bic(-F.col("p_retailprice"), F.lit(3), n, F.lit(320.0)), 6).alias("mixture"),
    )


@query("""SELECT l_orderkey, round(max(l_tax * 10) + ln(sum(exp(l_tax * 10 - m))), 8) AS log_sum FROM (SELECT l_orderkey, l_tax, max(l_tax * 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY l_orderkey""")
def q_log_sum_exp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(maths.log_sum_exp(F.collect_list(F.col("l_tax") * 10)), 8).alias("log_sum"))


@query("""WITH m AS (SELECT event_type, median(value) AS md FROM events GROUP BY event_type), d AS (SELECT e.*, md, abs(value - md) AS apart FROM events e JOIN m USING (event_type)),
s AS (SELECT event_type, median(apart) AS mad FROM d GROUP BY event_type) SELECT event_id, event_type, value FROM d JOIN s USING (event_type) WHERE value > md + 3 * greatest(mad, 0.01)""")
def q_mad_outliers(spark, sf_dir):
    return discovery.outliers(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "event_type", "value")


def _bits(spark, sf_dir):
    """(vec_id, label, site, x): the components of the embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("site", "x"))


@query(None)
def q_block_discovery(spark, sf_dir):
    """Haplotypes of each label's vectors, their components' signs taken as uncertain alleles."""
    x = 1 / (1 + F.exp(-8 * F.col("x")))
    p = _bits(spark, sf_dir).select("label", F.col("vec_id").alias("sample"), F.col("site").cast("long").alias("site"), ((1 - x) * (1 - x)).alias("p0"), (2 * x * (1 - x)).alias("p1"), (x * x).alias("p2"))
    return discovery.discover(p, "label", "int", "sample", "site", graph.written)


@query(f"""WITH {FOUNDERS}, q AS (SELECT u.label, u.hap AS h1, v.hap AS h2, u.site, u.allele + v.allele AS g FROM founders u JOIN founders v ON u.label = v.label AND u.site = v.site AND u.hap <= v.hap),
t AS (SELECT p.label, vec_id AS sample, h1, h2, sum(ln(greatest(CASE g WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-10))) AS ll, avg(1 - CASE g WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS residual
FROM posts p JOIN q USING (label, site) GROUP BY p.label, vec_id, h1, h2)
SELECT label, sample, h1, h2, round(ll, 5) AS log_likelihood, round(residual, 7) AS residual FROM t QUALIFY row_number() OVER (PARTITION BY label, sample ORDER BY ll DESC, h1, h2) = 1""")
def q_best_pair_paint(spark, sf_dir):
    """The pair of its label's founders that explains each vector best, and its residual."""
    p = cells(spark, sf_dir).select("label", F.col("vec_id").alias("sample"), "site", "p0", "p1", "p2")
    found = discovery.best_pairs(p, founder_alleles(spark, sf_dir), "label", "sample", "site")
    return found.select("label", "sample", "h1", "h2", F.round("log_likelihood", 5).alias("log_likelihood"), F.round("residual", 7).alias("residual"))


@query("""WITH b AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS site, unnest(embedding)::DOUBLE AS x FROM embeddings), k AS (SELECT * FROM b WHERE abs(x) > 0.05)
SELECT u.vec_id AS a, v.vec_id AS b, count(*) AS known, sum(CASE WHEN (u.x > 0) <> (v.x > 0) THEN 1 ELSE 0 END)::BIGINT AS differ
FROM k u JOIN k v ON u.label = v.label AND u.site = v.site AND u.vec_id < v.vec_id GROUP BY u.vec_id, v.vec_id HAVING count(*) >= 35""")
def q_missing_hamming(spark, sf_dir):
    """Differing signs of two vectors of a label where both are clear."""
    sign = lambda x: F.when(F.abs(x.cast("double")) > 0.05, (x > 0).cast("double"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", sign).alias("signs"))

    def compare(x, y):
        known, differ = pairs.signs_apart(x, y)
        return {"known": known, "differ": differ, "kept": known >= 35}

    return pairs.blocked(v, ["label"], "vec_id", "signs", compare, "known long, differ long")


@query("""WITH s AS (SELECT vec_id, label, list_sum([CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END for i in range(1, 33)])::BIGINT AS low, list_sum([CASE WHEN embedding[i + 32] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END for i in range(1, 33)])::BIGINT AS high FROM embeddings),
p AS (SELECT u.vec_id AS a, v.vec_id AS b, (bit_count(xor(u.low, v.low)) + bit_count(xor(u.high, v.high)))::INT AS hamming FROM s u JOIN s v ON u.label = v.label AND u.vec_id < v.vec_id) SELECT * FROM p WHERE hamming <= 20""")
def q_hamming_bits(spark, sf_dir):
    """Pairs of a label whose signs, packed into words of 32, differ in at most 20 places."""
    one = lambda w, i: F.when(F.get("embedding", 32 * w + i) > 0, F.expr("1L")).otherwise(F.expr("0L"))
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s + one(w, i) * F.pow(F.lit(2.0), i).cast("long"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(word(0), word(1)).alias("words"))

    def compare(x, y):
        far = sum(np.bitwise_count(x[:, None, k].astype(np.uint64) ^ y[None, :, k].astype(np.uint64)).astype(np.int32) for k in range(x.shape[1]))
        return {"hamming": far, "kept": far <= 20}

    return pairs.blocked(v, ["label"], "vec_id", "words", compare, "hamming int")


@query(f"""WITH marks AS (SELECT event_type, CAST(epoch_us(ts) // 1000000 AS BIGINT) - 1704067200 AS pos FROM events), h AS (SELECT event_type, pos // 21600 AS bin, count(*) AS n FROM marks GROUP BY ALL)
SELECT event_type, bin, n, round(sum(100.0 * n / 150) OVER (PARTITION BY event_type ORDER BY bin), 6) AS cumulative FROM h""")
def q_cumulative_map(spark, sf_dir):
    """Events of each type in bins of six hours, and the running map of 100 per 150 meioses."""
    h = marks(spark, sf_dir).groupBy("event_type", F.floor(F.col("pos") / 21600).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("cumulative", F.round(windows.cumulative(100.0 * F.col("n") / 150, ["event_type"], ["bin"]), 6))
