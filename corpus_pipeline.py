"""The corpus pipeline: documents to token ids, in five stages, each an operator of tessera.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns all that its stage keeps. Each result
is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents; where a
text changes, n_chars is counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from tessera.llm.common import discard, held_out, staged


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score below the threshold, by a model of the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out())
    model = toxicity.learn(toxicity.sample(docs.select("doc_id", "text"), labels))
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the boilerplate lines of its source."""
    return _counted(line_dedup.drop_boilerplate(docs, site="source"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id; rows that share an id are one document, of which the least text stays."""
    groups = staged(ngram_join.ngram_components(docs), "groups")
    dropped = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    few = dropped.count() <= ngram_join.BROADCAST_IDS  # else texts and ids are joined by shuffle
    out = docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col("__dropped"), "left_anti")
    if groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return out
    first = Window.partitionBy("doc_id").orderBy("text")
    return out.withColumn("__row", F.row_number().over(first)).filter("doc_id is null or __row = 1").drop("__row")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words inside occurrences of benchmark windows."""
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with ids (little-endian unsigned 32-bit integers), n_tokens and ids_sha256; decoded_sha256 is that of the bytes decoded again. Columns of these names are replaced."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = docs.drop("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    coded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    return coded.withColumns({"n_tokens": F.expr("cast(octet_length(ids) div 4 as bigint)"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("byte_bpe", encode),
]

#: A trained model decides the first stage, which SQL can't express; tests hold each stage against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)  # no later stage reads it, and it is as large as the input
    return STAGES[-1][1](spark, docs, sf_dir)
