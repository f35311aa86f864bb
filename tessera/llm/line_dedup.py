"""Line de-duplication by site-relative frequency, with DataFrame functions only.

A line of a page is what stands between line feeds, compared without the spaces around it. Its ratio is the
number of its site's pages that hold it, over all pages of the site. A line is boilerplate where that ratio
is above `max_ratio` and at least `min_pages` pages hold it (three by default, the least that can tell boilerplate
from a page and its copy, so that the ratio decides at sites of any size); such lines are dropped from every page of that
site, and only there. Lines of spaces alone, or none, are kept. Null text stays null and has no lines; a
page that only had boilerplate keeps an empty text. Pages of a null site are a site of their own. Repeated
rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, staged

MAX_RATIO, MIN_PAGES = 0.05, 3
#: Boilerplate rows up to which they are sent to every executor (about 50 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for a line, as text: sets of such keys are compared by hashing."""
    return F.md5(F.trim(line))


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The boilerplate of each site: (site, key, pages, ratio). Counts are summed before they are shuffled, so a large site is no hot key."""
    pages = pages.select(F.col(site).alias("site"), F.col(text).alias("page"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    held = (
        pages.select("site", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("page")), lambda x: F.trim(x) != ""), _key))).alias("key"))
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    joined = held.alias("h").join(totals.alias("t"), F.col("h.site").eqNullSafe(F.col("t.site")))
    return joined.select("h.site", "h.key", "h.pages", (F.col("pages") / F.col("total")).alias("ratio")).filter(F.col("ratio") > max_ratio)


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """The pages with their boilerplate lines dropped from `text`; the other columns stay. Counts go to the columns named.

    A site has at most (mean lines of a page) / max_ratio boilerplate lines, so one array a site holds them.
    The table of these arrays is broadcast if it has few rows, else joined by site; Spark splits a hot site.
    """
    found = staged(boilerplate(pages, site, text, max_ratio, min_pages), "boilerplate")
    small = found.count() <= BROADCAST_ROWS
    bad = found.groupBy("site").agg(F.collect_list("key").alias("keys")).select(F.col("site").alias("__site"), F.col("keys").alias("__keys"))
    joined = pages.join(F.broadcast(bad) if small else bad, F.col(site).eqNullSafe(F.col("__site")), "left")
    lines = _lines(F.col(text))
    # the page's keys that are its site's boilerplate, by one pass over both; then each line looks among these few
    met = joined.withColumn("__met", F.when(F.col("__keys").isNotNull(), F.array_intersect(F.transform(lines, _key), "__keys")))
    keep = lambda x: F.trim(x).eqNullSafe("") | ~F.array_contains(F.col("__met"), _key(x))
    out = met.withColumn("__kept", F.when(F.size("__met") > 0, F.filter(lines, keep)).otherwise(lines))
    columns = {text: F.array_join("__kept", "\n")}
    if n_lines:
        columns[n_lines] = F.greatest(F.size(lines), F.lit(0)).cast("long")
    if n_dropped:
        columns[n_dropped] = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long")
    return out.withColumns(columns).drop("__site", "__keys", "__met", "__kept")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped, and the SHA-256 of the text without its site's boilerplate (null text: of an empty one)."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    out = drop_boilerplate(docs, n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
d AS (SELECT source, unnest(list_distinct(list_transform(list_filter(lines, lambda x: trim(x) <> ''), lambda x: trim(x)))) AS line FROM l),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT d.source, line FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, line
      HAVING count(*) >= {MIN_PAGES} AND count(*) / any_value(total) > {MAX_RATIO}),
a AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))) AS kept
      FROM l LEFT JOIN a ON l.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
