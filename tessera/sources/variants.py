"""Variant files as DataFrames: VCF text (plain or gzip) read by Spark, region filters, and site flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _calls(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(contig, pos, ref_allele, alt_allele, af, sample, values): a row for each site and sample, with the parts of a FORMAT field (null if it isn't there).

    Sample names come from the header line, which one task reads; the body is split among all. A body line of too few
    or many fields raises an error: nothing is cut short silently."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"{path}: no #CHROM line")
    names = header["value"].split("\t")[9:]
    field = F.split("value", "\t")
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.when(F.size(field) == 9 + len(names), field).otherwise(F.raise_error(F.concat(F.lit("a line of too few or many fields: "), F.substring("value", 1, 80)))).alias("f"))
    af = F.coalesce(F.regexp_extract(F.col("f")[7], r"(?:^|;)AF=([-+0-9.eE]+)", 1).try_cast("double"), F.lit(0.0))
    sites = body.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref_allele"), F.split(F.col("f")[4], ",")[0].alias("alt_allele"), af.alias("af"), F.array_position(F.split(F.col("f")[8], ":"), F.lit(tag)).alias("at"), F.slice("f", 10, max(1, len(names))).alias("calls"))
    rows = sites.select("*", F.posexplode("calls").alias("i", "call"))
    values = F.when(F.col("at") > 0, F.split(F.get(F.split("call", ":"), (F.col("at") - 1).cast("int")), ","))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return rows.select("contig", "pos", "ref_allele", "alt_allele", "af", name.alias("sample"), values.alias("values"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, ref_allele, alt_allele, af, sample, ref, alt) of a VCF, plain or gzip.

    AD's first two depths; missing or negative ones are 0. AF is INFO's first value; a missing one is 0."""
    depth = lambda k: F.greatest(F.lit(0), F.coalesce(F.get("values", F.lit(k)).try_cast("int"), F.lit(0)))
    return _calls(spark, path, "AD").select("contig", "pos", "ref_allele", "alt_allele", "af", "sample", depth(0).alias("ref"), depth(1).alias("alt"))


def read_phred(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, af, sample, pl0, pl1, pl2) of a VCF: phred-scaled likelihoods; where one is missing or negative, all are 0."""
    value = [F.get("values", F.lit(k)).try_cast("int") for k in range(3)]
    good = F.coalesce((value[0] >= 0) & (value[1] >= 0) & (value[2] >= 0), F.lit(False))
    return _calls(spark, path, "PL").select("contig", "pos", "af", "sample", *[F.when(good, v).otherwise(0).alias(f"pl{k}") for k, v in enumerate(value)])


def repeated_positions(reads: DataFrame) -> DataFrame:
    """Positions with more than one row for a sample, which a strict reader must refuse."""
    return reads.groupBy("contig", "pos", "sample").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("contig", "pos").distinct()


def region(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Rows of [start, end)."""
    return reads.filter((F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))


def keep_flags(reads: DataFrame, site: list[str], frequency: str, ref: str, alt: str, sample: str, least_frequency: float, error: float, least_reads: int) -> DataFrame:
    """(site, frequency, reads, keep): frequency between bounds, and reads at least `least_reads` and error * samples."""
    total = reads.groupBy(*site).agg(F.max(frequency).alias("frequency"), F.sum(F.col(ref) + F.col(alt)).alias("reads"), F.count_distinct(sample).alias("samples"))
    keep = F.col("frequency").between(least_frequency, 1 - least_frequency) & (F.col("reads") >= F.greatest(F.lit(float(least_reads)), error * F.col("samples")))
    return total.select(*site, "frequency", "reads", keep.alias("keep"))
