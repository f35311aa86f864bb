"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

encode() keeps ids as bytes (little-endian unsigned 32-bit), which pass between Python and the JVM as one
buffer; unpack() makes an array of them. Texts are split by the pattern before merging; a long text is
handed over in parts that begin at white space after a non-space, where no match of the pattern can lie
across, so parts give the ids of the whole. decode() gives raw bytes: ids need not end on a character.
Null text is an empty text, with no ids; null ids decode to empty bytes. Ids that the rank file lacks raise
an error in decode(). A column of the result's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, over_arrow, plus

PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file; one for each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of at least `size` characters, cut only between a non-space and a space or line feed."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _encoder(rank_file: str, pattern: str, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoding(rank_file, pattern)

        def ids(value: str | None) -> bytes:
            if not value:
                return b""
            return b"".join(known.encode_to_numpy(part, disallowed_special=()).astype("<u4").tobytes() for part in parts(value))

        for batch in batches:
            yield batch.append_column(out, pa.array([ids(x) for x in batch[text].to_pylist()], pa.binary()))

    return run


def _decoder(rank_file: str, pattern: str, ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoding(rank_file, pattern)
        for batch in batches:
            yield batch.append_column(out, pa.array([known.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch[ids].to_pylist()], pa.binary()))

    return run


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text, as little-endian unsigned 32-bit integers in a binary column."""
    df, schema = plus(df, f"`{out}` binary", out)
    return over_arrow(df, _encoder(rank_file, pattern, text, out), schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's ids."""
    df, schema = plus(df, f"`{out}` binary", out)
    return over_arrow(df, _decoder(rank_file, pattern, ids, out), schema)


def unpack(df: DataFrame, ids: str = "ids", out: str = "id_array") -> DataFrame:
    """Adds the ids of a binary column as an array of ints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(out, pa.array([np.frombuffer(x or b"", "<u4").astype(np.int32) for x in batch[ids].to_pylist()], pa.list_(pa.int32())))

    df, schema = plus(df, f"`{out}` array<int>", out)
    return over_arrow(df, run, schema)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; by the multilingual rank file."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode(encode(documents(spark, sf_dir), ranks, pattern).select("doc_id", "ids"), ranks, pattern)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
