"""Token ids in length-delimited binary record files, with offset indexes for reads in any order.

A file holds the documents of one block of ids, ascending (null ids first, as the smallest; rows of one id in the
order of their tokens), one record each. A file begins with MAGIC and a byte W, the bytes of an id (2 if the
vocabulary has at most 65,536 entries, else 4). A record is: the payload's length (u64), the masked checksum of
these 8 bytes (u32), the payload (ids of W bytes each), the masked checksum of the payload (u32); all little-endian.
The checksum is CRC-32, rotated right by 15 bits, plus a constant. The index file has, for each record, the document
id (i64), the record's offset (u64) and its number of ids (u64), so a reader may visit records in any order.

Encoding comes first, so blocks shuffle ids and not texts; blocks are ranges of the id column. A task writes files of
names of its own and returns them: only files in the returned table count, so a task that is run again does no harm.
Files go to a folder of the shared one, by pyarrow's file systems. Texts are encoded as Tokenizer.encode(text, add_special_tokens=False)
does with the file as it is: strings of its special tokens are those tokens. A null text is an empty one: its record holds the
end id alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, over_arrow, range_blocks, shared_dir, staged

MAGIC = b"TSRREC1"
_INDEX = np.dtype([("id", "<i8"), ("at", "<u8"), ("n", "<u8")])
_FILES = pa.schema([("block", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_NO_ID = -(1 << 63)
END_ID = 1
#: Bytes of text whose ids go to a file, and distinct words whose ids a Python worker keeps.
FILE_BYTES, CACHE_WORDS = 96 << 20, 1 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Words(dict):
    """The ids of words as bytes, kept: no token and no special token has white space in it, so a text's ids are its words' ids.

    The library encodes each new word whole. Only of a word of ASCII letters, with ASCII punctuation behind it or not, it
    gets both parts apart, as it cuts there itself; and as nothing normalises such letters but lower case, they go to its merges."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?")
        if not (core.isascii() and core.isalpha()):
            out = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif core != word:
            out = self[core] + self[word[len(core) :]]
        else:
            out = self.pack([t.id for t in self.tokenizer.model.tokenize(word.lower())])
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def words(file: str) -> Words:
    return Words(file)


def _encoder(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(file)
        end = known.pack([end_id])
        for batch in batches:
            ids = [known.encode(x or "") + end for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["block"], pa.array(ids, pa.binary())], ["doc_id", "block", "ids"])

    return run


def encode_words(df: DataFrame, file: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, block, ids): the end id appended, packed in as many bytes as `words(file).width`; df must have a column `block`."""
    return over_arrow(df.select(F.col(doc_id).cast("long").alias("doc_id"), "block", F.col(text).alias("text")), _encoder(file, end_id), "doc_id long, block int, ids binary")


def _writer(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        block, out, index, name, at = None, None, [], "", 0

        def close() -> pa.RecordBatch:
            out.close()
            table = np.array(index, _INDEX)
            with store.open_output_stream(f"{root}/{name}.idx") as to:
                to.write(table.tobytes())
            return pa.RecordBatch.from_pylist([{"block": block, "file": name, "records": len(table), "tokens": int(table["n"].sum()), "bytes": at}], _FILES)

        for batch in batches:
            for doc, number, ids in zip(batch["doc_id"].to_pylist(), batch["block"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if number != block:
                    if out is not None:
                        yield close()
                    block, name, index, at = number, f"part-{number:06d}-{uuid.uuid4().hex}", [], len(MAGIC) + 1
                    out = store.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20)
                    out.write(MAGIC + bytes([width]))
                head = struct.pack("<Q", len(ids))
                out.write(head + struct.pack("<I", masked(head)) + ids + struct.pack("<I", masked(ids)))
                index.append((_NO_ID if doc is None else doc, at, len(ids) // width))
                at += len(ids) + 16
        if out is not None:
            yield close()

    return run


def write_records(coded: DataFrame, folder: str, width: int, blocks: int) -> DataFrame:
    """Writes (doc_id, block, ids) to files, one a block, and returns their table: block, file, records, tokens, bytes."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    dealt = coded.repartition(blocks, "block").sortWithinPartitions("block", "doc_id", "ids")
    return staged(over_arrow(dealt, _writer(folder, width), "block int, file string, records long, tokens long, bytes long"), "files")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{file}.idx") as at:
                    index = np.frombuffer(at.read(), _INDEX)
                with store.open_input_stream(f"{root}/{file}.rec", buffer_size=1 << 20) as at:
                    if at.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{file}: not a record file")
                    width, rows = at.read(1)[0], []
                    for doc, _, n in index.tolist():
                        head = at.read(12)
                        size, check = struct.unpack("<QI", head)
                        ids = at.read(size)
                        if check != masked(head[:8]) or struct.unpack("<I", at.read(4))[0] != masked(ids) or size != n * width:
                            raise ValueError(f"{file}: a record of document {doc} is damaged")
                        rows.append((None if doc == _NO_ID else doc, start, n, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()))
                        start += n
                        if len(rows) == 512:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all records; ids as little-endian unsigned 32-bit integers, start is the number of ids before.

    There is a row a file in `files`, so its running total is over few rows, however many documents there are."""
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    return over_arrow(at.repartition(max(1, files.count()), "file"), _reader(folder), "doc_id long, start long, n_tokens long, ids binary")


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    """Per document, from the files read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, sf_dir)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    files = write_records(encode_words(range_blocks(docs, "doc_id", blocks), file), folder, words(file).width, blocks)
    back = read_records(files, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
