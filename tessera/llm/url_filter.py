"""URL filtering by rules and by the ratio of two character language models.

A rule is a host and a path beginning, with a verdict; it fits its host and every subdomain of it, if the URL's path
begins with the rule's. Of the rules that fit, the longest (host, then path) wins.

A URL without a rule is judged by two variable-order Markov models of characters, of accepted and of rejected URLs:
the probability of a character after a context is smoothed by that after the context's end, with the weight of PRIOR
observations, from ORDER - 1 characters down to none and to even chances: so a long context counts as far as it was seen. The text of a model is the lower-cased URL from its host on, with a
mark at both ends. The score is the difference of log-likelihoods, rejected less accepted, over the number of
characters; a score above the threshold blocks. The threshold is calibrated: the one, of THRESHOLDS tried, that best
balances the two kinds of error over URLs that a rule decides and neither model learnt from.

Counts are gathered by Spark from all URLs that a rule decides, but for one in HOLD, kept for calibration. They are
exact: an n-gram of ORDER bytes is a number of its own (BITS bits a byte), and the table of them grows with the input.
Counts of shorter n-grams and of contexts are sums over it, as each character ends one n-gram of each order. The score
of a character depends on the n-gram of ORDER bytes that it ends, so a block of URLs asks for the score of each of its
distinct ones once. The rules' verdicts are all that is learnt from.

Host: after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the
end. Null, or no `://`: both are empty, and the models judge the whole URL (null: an empty one). Without URLs of both
verdicts there are no models, and what no rule decides is allowed, with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import over_arrow, plus, slices, staged
from .textbytes import FOLD, utf8

ORDER, PRIOR, HOLD = 6, 3.0, 8
#: Bits of a byte in an n-gram's number (256 values and the mark), rows of a block, and n-grams that a task holds before it sends them on.
BITS, BLOCK_ROWS, HELD = 9, 1 << 12, 1 << 19
THRESHOLDS = np.linspace(-3, 3, 1201)
#: (host, path beginning, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """Adds host, path, rule (as `net/`, null if none fits) and ruling."""
    df = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, begin, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(begin)
        rule, ruling = F.when(fits, name + begin).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return df.withColumns({"rule": rule, "ruling": ruling})


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the texts: the n-gram of ORDER bytes that it ends, its own byte lowest, and the text."""
    data, offsets = utf8(column)
    n = np.diff(offsets) + 1
    begin = np.concatenate(([0], np.cumsum(n)))
    x = np.zeros(begin[-1], np.int64)  # a mark ends each text
    place = np.arange(len(data)) + np.repeat(np.arange(len(n)), n - 1)
    x[place] = FOLD[data].astype(np.int64) + 1
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(x)) - begin[:-1][text]
    gram = x.copy()
    for k in range(1, ORDER):
        past = np.where(within >= k, np.concatenate((np.zeros(k, np.int64), x[:-k]))[: len(x)], 0)
        gram |= past << (BITS * k)
    return gram, text


_ASKED = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("allow", pa.int64()), ("deny", pa.int64())])


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows of (block, gram, allow, deny) with the counts of equal block and gram summed."""
    block, gram, allow, deny = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, block))
    block, gram = block[order], gram[order]
    first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (gram[1:] != gram[:-1]))))
    return block[first], gram[first], np.add.reduceat(allow[order], first), np.add.reduceat(deny[order], first)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each block, with their counts in accepted and in rejected URLs that are learnt from."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in slices(batches, "site"):
        gram, text = _grams(batch["site"])
        block = batch["block"].to_numpy()[text]
        learnt = np.array([{"allow": 1, "block": 2}.get(x, 0) for x in batch["learnt"].to_pylist()], np.int64)[text]
        held.append(_summed([(block, gram, (learnt == 1).astype(np.int64), (learnt == 2).astype(np.int64))]))
        n += len(held[-1][0])
        if n > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], schema=_ASKED)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], schema=_ASKED)


def model(asked: DataFrame) -> DataFrame | None:
    """(gram, weight): of each n-gram, the log-likelihood of its last character among rejected URLs less that among accepted; None unless there are URLs of both verdicts.

    From the shortest n-grams to the longest. A context has no more than 257 n-grams, and an n-gram no more than 257
    that are longer by one byte, so no key is hot."""
    counts = staged(asked.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("deny").alias("deny")), "grams")
    total = counts.agg(F.sum("allow"), F.sum("deny")).first()
    if not total[0] or not total[1]:
        return None
    shorter = None
    for k in range(ORDER):
        mask = (1 << (BITS * (k + 1))) - 1
        here = counts.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("deny").alias("deny")) if k < ORDER - 1 else counts
        context = Window.partitionBy(F.shiftright("gram", BITS))
        here = here.withColumns({"in_allow": F.sum("allow").over(context), "in_deny": F.sum("deny").over(context)})
        if shorter is None:
            here = here.withColumns({"p_allow": F.lit(1 / 257), "p_deny": F.lit(1 / 257)})
        else:
            here = here.withColumn("end", F.col("gram").bitwiseAND(F.lit(mask >> BITS))).join(shorter, "end")
        chance = {v: (F.col(v) + PRIOR * F.col(f"p_{v}")) / (F.col(f"in_{v}") + PRIOR) for v in ("allow", "deny")}
        shorter = here.select(F.col("gram").alias("end"), *[c.alias(f"p_{v}") for v, c in chance.items()])
    return shorter.select(F.col("end").alias("gram"), (F.ln("p_deny") - F.ln("p_allow")).alias("weight"))


def score(blocks: DataFrame, asked: DataFrame, weights: DataFrame | None, out: str = "score") -> DataFrame:
    """Adds the length-normalised difference of log-likelihoods, rejected less accepted; 0 without a model."""
    blocks, schema = plus(blocks, f"`{out}` double", out)
    if weights is None:
        return blocks.withColumn(out, F.lit(0.0))
    answers = asked.select("block", "gram").join(weights, "gram").select("block", "gram", "weight")

    def run(urls: pa.Table, table: pa.Table) -> pa.Table:
        known, weight = table["gram"].to_numpy(), table["weight"].to_numpy()
        order = np.argsort(known, kind="stable")
        known, weight = known[order], weight[order]
        found = [np.zeros(0)]
        for batch in slices(urls.to_batches(), "site"):
            gram, text = _grams(batch["site"])
            found.append(np.bincount(text, weight[np.searchsorted(known, gram)], batch.num_rows) / np.bincount(text, minlength=batch.num_rows))
        return urls.append_column(out, pa.array(np.concatenate(found)))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def calibrate(scored: DataFrame) -> float:
    """The threshold with the least sum of both error rates over rows (ruling, score); of equal ones that nearest to 0."""
    step = THRESHOLDS[1] - THRESHOLDS[0]
    at = F.greatest(F.lit(0), F.least(F.lit(len(THRESHOLDS)), F.ceil((F.col("score") - float(THRESHOLDS[0])) / float(step)))).cast("int")
    allow, block = np.zeros(len(THRESHOLDS) + 1), np.zeros(len(THRESHOLDS) + 1)
    for r in scored.groupBy("ruling", at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a threshold
        (block if r["ruling"] == "block" else allow)[r["at"]] = r["n"]
    # a row of bin i is above the thresholds before i
    wrong = (allow.sum() - np.cumsum(allow)[:-1]) / max(1, allow.sum()) + np.cumsum(block)[:-1] / max(1, block.sum())
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(THRESHOLDS[best[np.argmin(np.abs(THRESHOLDS[best]))]])


def judge(urls: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """The rows with host, path, rule, verdict and score; columns of these names, or of `ruling` and `site`, are replaced."""
    site = F.lower(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://", ""))
    urls = urls.drop(*{"host", "path", "rule", "ruling", "verdict", "score", "site", "block", "learnt"} - {url})
    df = ruled(urls, url, rules).withColumn("site", site)
    kept = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("site")), F.lit(HOLD)) == 0
    place = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)
    blocks = staged(df.withColumns({"block": place, "learnt": F.when(~kept, F.col("ruling"))}), "urls")
    asked = staged(over_arrow(blocks.select("block", "site", "learnt"), _ask, "block long, gram long, allow long, deny long"), "asked")
    weights = model(asked)
    scored = staged(score(blocks, asked, weights), "scored") if weights is not None else score(blocks, asked, None)
    threshold = calibrate(scored.filter("ruling is not null and learnt is null")) if weights is not None else 0.0
    verdict = F.coalesce("ruling", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("ruling", "site", "block", "learnt")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Per page: host, path, rule, verdict, and the score of the models."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
