"""SpotSigs fingerprints of texts, and their likeness.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. An anchor is a word of ANCHORS, or a
word before which the text has none of these in the last REACH words: so stretches without common words, and texts of
a few words, have anchors too, and the rule looks no further than REACH words back. A signature is an anchor and the
CHAIN next content words (words that are not in ANCHORS) after it; fewer at the end of a text. A fingerprint is the
set of a text's signatures as hashes of 40 bits, in order, ten hexadecimal digits each. All words of a text count.

Equal texts have equal fingerprints. Null and wordless texts have an empty one. Likeness is the Jaccard index of
two sets: 1 for two empty ones, 0 for one.

The next document, in ascending id, is found without sorting texts in one place: documents are dealt to ranges of the
id column, and the first of each range goes, as a guest, to the range before as well. Rows of one id stand in the
order of their texts; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, documents, over_arrow, plus, range_blocks
from .textbytes import ALNUM, BASE, FOLD, U64, mix, utf8, word_hashes, word_spans

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and a in to is was it for with he be on by that as are this an at or from which have has not were been there "
    "le la les un une des du de et est en dans il elle que qui pour pas par sur au aux avec ne ce se sont plus "
    "der die das und ist ein eine einer eines dem den des zu mit von auf nicht sich auch als an im für wird "
    "el los las una y es del que en por con para no su al lo como más pero sus"
).split()
REACH, CHAIN = 8, 2
RANGE_BYTES = 64 << 20


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    data = FOLD[data]
    start, end, first = word_spans(data, offsets, ALNUM)
    return word_hashes(data, start, end), first


_COMMON = np.unique(_words_of([" ".join(ANCHORS)])[0])


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of 40-bit signatures of each text."""
    words, first = _words_of(texts)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    at = np.minimum(np.searchsorted(_COMMON, words), len(_COMMON) - 1)
    common = _COMMON[at] == words
    seen = np.concatenate(([0], np.cumsum(common)))
    place = np.arange(len(words))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    near = seen[place] - seen[np.maximum(place - (REACH - 1), first[text])]
    anchor = np.flatnonzero(common | (near == 0))
    content = np.flatnonzero(~common)
    after = np.searchsorted(content, anchor, "right")
    sig = mix(words[anchor] + U64(1))
    for k in range(CHAIN):
        there = after + k < len(content)
        link = content[np.minimum(after + k, max(0, len(content) - 1))] if len(content) else np.zeros(len(anchor), np.int64)
        there &= (link < first[text[anchor] + 1]) if len(content) else False
        sig = np.where(there, mix(sig * U64(BASE) + words[link]), sig)
    sig >>= U64(24)
    bounds = np.searchsorted(anchor, first)
    return [np.unique(sig[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def written(signs: np.ndarray) -> str:
    return signs.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _fingerprints(batches: Iterator[pa.RecordBatch], text: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column(out, pa.array([written(x) for x in signatures([t or "" for t in batch[text].to_pylist()])], pa.string()))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each text; a column of that name is replaced."""
    df, schema = plus(df, f"`{out}` string", out)
    return over_arrow(df, lambda batches: _fingerprints(batches, text, out), schema)


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, guest, doc_id, text), each block in order in one partition and followed by the first document of the next; the last by the first of all."""
    spark = docs.sparkSession
    placed = range_blocks(docs, "doc_id", blocks)
    firsts = placed.groupBy("block").agg(F.min("doc_id").alias("first"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).orderBy("block").collect()  # a row a block
    if not firsts:
        return placed.select("block", F.lit(False).alias("guest"), "doc_id", "text")
    ahead = [(firsts[i]["block"], None if (nxt := firsts[(i + 1) % len(firsts)])["nulls"] else nxt["first"]) for i in range(len(firsts))]
    bound = spark.createDataFrame(ahead, "target int, lead long")
    guests = docs.join(F.broadcast(bound), docs.doc_id.eqNullSafe(bound.lead)).select(F.col("target").alias("block"), F.lit(True).alias("guest"), "doc_id", "text")
    both = placed.select("block", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    return both.repartition(blocks, "block").sortWithinPartitions("block", "guest", "doc_id", "text")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _results(rows: list[tuple], after: str) -> pa.RecordBatch:
    """rows: (doc_id, text), in order; `after` is the text that follows the last."""
    texts = [t for _, t in rows]
    follow = [*texts[1:], after]
    edited = [t[: len(t) - (k := len(t) // 4)] + n[:k] for t, n in zip(texts, follow, strict=True)]
    signs = signatures([*texts, after])
    changed = signatures(edited)
    out = [
        (doc, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(c), likeness(a, c), likeness(a, b))
        for (doc, t), e, a, b, c in zip(rows, edited, signs, signs[1:], changed, strict=False)
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, rows, size, closed = None, [], 0, False
    for batch in batches:
        for number, guest, doc, text in zip(*(batch[c].to_pylist() for c in ("block", "guest", "doc_id", "text")), strict=True):
            text = text or ""
            if number != block:
                block, rows, size, closed = number, [], 0, False
            if guest:
                if not closed:
                    yield _results(rows, text)
                closed = True
                continue
            if size > SLICE_BYTES:
                yield _results(rows, text)
                rows, size = [], 0
            rows.append((doc, text))
            size += len(text)


def op4_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and its edited text, and the likeness to it and to the next document."""
    docs = documents(spark, sf_dir)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    return over_arrow(with_next(docs, blocks), _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
