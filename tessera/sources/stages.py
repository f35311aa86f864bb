"""Tables between stages, and texts of values: the first that is there, CSV, canonical JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_existing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The table of the first folder that Spark has finished writing; an error if none is."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(folder)
    raise FileNotFoundError(f"none of {', '.join(folders)} is there")


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def strict_boolean(column: str) -> Column:
    """true, false, 1 or 0 in any case; anything else is an error."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit(f"{column}: not a boolean: "), F.coalesce(text, F.lit("null")))))
