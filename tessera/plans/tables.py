"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp, with or without a zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, sample, line, ref, alt, af) of lineitem."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample"), F.col("l_orderkey").alias("line"), F.col("l_quantity").cast("int").alias("ref"), F.col("l_linenumber").alias("alt"), (F.col("l_discount") * 10).alias("af"))


READS = "reads AS (SELECT l_partkey AS site, l_suppkey AS sample, l_orderkey AS line, CAST(l_quantity AS INT) AS ref, l_linenumber AS alt, l_discount * 10 AS af FROM lineitem)"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, pos, event_type, value) of events; pos in seconds from 2024."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", (seconds("ts") - 1704067200).alias("pos"), "event_type", "value")


MARKS = "marks AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) - 1704067200 AS pos, event_type, value FROM events)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, start, end, owner): from each of a user's events to the next, half open; the last ends a day later."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("pos", "event_id")
    rows = marks(spark, sf_dir).withColumn("next", F.coalesce(F.lead("pos").over(w), F.col("pos") + 86400))
    return rows.filter("pos < next").select("user_id", F.col("pos").alias("start"), F.col("next").alias("end"), F.col("event_type").alias("owner"))


SEGMENTS = MARKS + """, segments AS (SELECT user_id, pos AS "start", nxt AS "end", event_type AS owner FROM
  (SELECT *, coalesce(lead(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id), pos + 86400) AS nxt FROM marks) WHERE pos < nxt)"""
