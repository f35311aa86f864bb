"""What the operators of this subpackage share: Arrow batches of bounded size, the shared folder, range blocks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python, and bytes of text that one numpy step takes from it.
BATCH_ROWS, SLICE_BYTES = 512, 1 << 19
#: Range bounds up to which a block is found by an expression of that size.
TREE_BOUNDS = 512


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("doc_id", "text"))


def plus(df: DataFrame, columns: str, *names: str) -> tuple[DataFrame, str]:
    """The rows without columns of these names, which a result replaces, and the schema with the result's columns at the end."""
    df = df.drop(*names)
    return df, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), columns])


def over_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches: texts may be long, and a worker holds one batch."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _settle()

    return df.mapInArrow(run, schema)


def settled(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of groups that gives memory back after each."""

    def done(out: pa.Table) -> pa.Table:
        _settle()
        return out

    if function.__code__.co_argcount == 2:
        return lambda key, table: done(function(key, table))
    return lambda table: done(function(table))


def _settle() -> None:
    """Gives what the worker has freed back to the system: it may wait for its next task for long, beside others."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other libraries need not


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `limit` bytes of text at most; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        at = held = 0
        for row, n in enumerate(size.tolist()):
            if row > at and held + n > limit:
                yield batch.slice(at, row - at)
                at, held = row, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of our own; a cluster gets an error, as its machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


def staged(df: DataFrame, kind: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: later steps, and retries of lost tasks, begin there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables. Only for those that no result still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done, as it does once the driver's JVM has collected what refers to them.

    Executors' disks would otherwise hold every step's files until the driver's memory fills, which is late for a driver that does little.
    Python's side lets go of them in a thread of its own, once a second: hence the pause."""
    for _ in range(2):  # what ends a query may itself hold it for a moment
        gc.collect()
        time.sleep(1.2)
        spark._jvm.System.gc()


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def range_blocks(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds `block`, an int that rises with `key`: equal keys share one, and blocks have about as many rows each.

    The bounds are quantiles of the key column alone, so texts are neither sampled nor read twice by a
    range partitioner. Null keys are in block 0.
    """
    quantiles = df.stat.approxQuantile(key, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    bounds = sorted({int(q) for q in quantiles})
    if not bounds:
        return df.withColumn("block", F.lit(0))
    place = _bucket(key, bounds) if len(bounds) <= TREE_BOUNDS else _searched(bounds)(F.col(key))
    return df.withColumn("block", F.coalesce(place, F.lit(0)))


def _bucket(key: str, bounds: list[int], low: int = 0):
    """How many of the sorted bounds are at most the key, by a tree of comparisons as deep as the logarithm of their number."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(F.col(key) >= bounds[mid], _bucket(key, bounds[mid + 1 :], low + mid + 1)).otherwise(_bucket(key, bounds[:mid], low))


def _searched(bounds: list[int]):
    """The same for many bounds: a binary search over batches of keys, so that the expression doesn't grow with them."""
    edges = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        known = pc.fill_null(keys.cast(pa.int64()), int(edges[0]) - 1).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, known, "right").astype(np.int32))

    return place
