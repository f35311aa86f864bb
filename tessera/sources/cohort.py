"""Cohort tables: sample metadata in a file's order, candidate parents, and checks of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordered(metadata: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The metadata of these samples with `sample_index`, their place in `names`; rows of others, or of no name, go."""
    spark = metadata.sparkSession
    order = spark.createDataFrame(list(enumerate(names)), f"sample_index int, `{key}` string")
    text = [c for c, kind in metadata.dtypes if kind == "string" and c != key]
    return F.broadcast(order).join(metadata, key).select("sample_index", *metadata.columns).fillna("", text)


def unmatched(metadata: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(name, rows): samples that the metadata have not, or more than once."""
    wanted = metadata.sparkSession.createDataFrame([(n,) for n in names], "name string")
    count = metadata.groupBy(F.col(key).alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return F.broadcast(wanted).join(count, "name", "left").select("name", F.coalesce("rows", F.lit(0)).alias("rows")).filter("rows <> 1")


def candidates(metadata: DataFrame, key: str, generation: str, sex: str, level: str) -> DataFrame:
    """(pair, father, mother): every male with every female of a generation, numbered in order of their names."""
    of = lambda s, name: metadata.filter((F.col(generation) == level) & (F.col(sex) == s)).select(F.col(key).alias(name), F.lit(1).alias("one"))
    pairs = of("M", "father").join(of("F", "mother"), "one").drop("one")
    return pairs.withColumn("pair", F.row_number().over(Window.orderBy("father", "mother")) - 1).select("pair", "father", "mother")


def generation_of(name: Column) -> Column:
    """F1, F2 or F3 by the beginning of a name; else F0."""
    return F.when(F.substring(name, 1, 2).isin("F1", "F2", "F3"), F.substring(name, 1, 2)).otherwise("F0")


def squeezed(text: Column) -> Column:
    """White space trimmed, and one space for each run of it."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def depth_label(depth: Column) -> Column:
    """5.0 as 5, 0.5 as 0.5."""
    return F.regexp_replace(depth.cast("double").cast("string"), r"\.0$", "")


def invalid_references(pedigree: DataFrame, child: str, parents: dict[str, str], sex: str) -> DataFrame:
    """(child, slot, parent, fault): parents who are no row, whose sex isn't the slot's, or who are the child. `parents` maps a column to the sex it takes."""
    slots = F.explode(F.array(*[F.struct(F.lit(c).alias("slot"), F.lit(s).alias("wanted"), F.col(c).alias("parent")) for c, s in parents.items()]))
    edges = pedigree.select(F.col(child).alias("child"), slots.alias("e")).select("child", "e.*").filter("parent is not null")
    known = pedigree.select(F.col(child).alias("parent"), F.col(sex).alias("sex"), F.lit(True).alias("there"))
    fault = F.when(F.col("there").isNull(), "unknown").when(F.col("child") == F.col("parent"), "itself").when(F.col("sex") != F.col("wanted"), "sex")
    return edges.join(known, "parent", "left").select("child", "slot", "parent", fault.alias("fault")).filter("fault is not null")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of seed assignments: child, father, mother, seed_basis, seed_status, report_parent_edges. Another header, or a child twice, is an error when read."""
    names = ["child", "father", "mother", "seed_basis", "seed_status", "report_parent_edges"]
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"{n} string" for n in names)).csv(path)
    twice = F.count(F.lit(1)).over(Window.partitionBy("child")) > 1
    return rows.withColumn("child", F.when(twice, F.raise_error(F.concat(F.lit("a child twice: "), F.col("child")))).otherwise(F.col("child")))
