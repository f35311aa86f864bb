"""Removal of repeated byte strings by prefix-free parsing, in corpus order.

A byte is removed if a string of `WINDOW` bytes that covers it also starts earlier: in a document of smaller id,
or earlier in the same one. Strings never cross documents and are judged on the input, not on what is left.

* Parsing. A rolling hash of each gram of `GRAM` bytes picks triggers: a place is the trigger of a window if its
  gram has the least hash in it (the last of equal ones). So equal windows have equal triggers at equal
  distances, and the consecutive windows that share a trigger make a phrase: their first to their last byte.
  A phrase reaches `WINDOW` - 1 bytes beyond the last start that it owns and so overlaps the next; therefore no
  window must be read across a phrase's end, and the order of corpus suffixes, to the depth of `WINDOW` bytes, is
  settled by the dictionary of phrases: the parse only adds where each phrase stands.
* Dictionary. Phrases are dealt by the hash of their trigger. A trigger that stands once has only windows that
  are unique. Of equal phrases the first in corpus order stays for the dictionary; all windows that the others
  own start earlier elsewhere.
* Suffixes. Where a trigger has several phrases, the suffixes of these, cut to `WINDOW` bytes, are sorted; a
  suffix is repeated if it isn't the first of its equals in corpus order. Each phrase of the dictionary is taken
  once, so highly repetitive text costs little more than one copy of it.

Hashes of 128 bits stand for the strings (two polynomials of different bases), so sorting places equals together
and needs no text. Records travel in blocks dealt by hash. A task sends a phrase or suffix on once, however often
it met it, so a string of very many occurrences is no hot key. Null text is empty. A null id counts as the
smallest. Equal rows are one document: what stands at the same place of it is no repeat, so each keeps the same bytes.
Rows that share an id but not the text are documents of their own, in the order of TAG_BITS bits of their texts' CRC-32,
their tag; a row whose id no other has needs none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free, over_arrow, settled, slices, staged
from .textbytes import BASE, BYTE_VALUES, U64, Rolling, mix, several, utf8

WINDOW, GRAM = 100, 32
#: A second polynomial, for hashes of 128 bits.
BASE_2, VALUES_2 = 0xD1342543DE82EF95, mix(BYTE_VALUES)
#: Bytes of text that are parsed at once; places in them take PLACE_BITS bits.
CHUNK, PLACE_BITS = 8 << 20, 24
#: A place in a document has the text's tag above it, so that rows of one id but different texts are told apart.
TAG_BITS, TAG_SHIFT = 23, 40
#: Repeated ids up to which they are broadcast (some 16 MB); beyond, texts are joined to them by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of records in a block, and records that a task holds before it deals them out.
BLOCK_BYTES, HELD = 8 << 20, 1 << 18
_NO_ID, _PLACE = -(1 << 63), (1 << TAG_SHIFT) - 1
#: Records: two hashes, document, first start, trigger's distance from it, number of starts.
_RECORD = np.dtype([("a", "<u8"), ("r", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("n", "<u2")])
_FIELDS = list(_RECORD.names)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of texts that stand in a row: text, first start, number of starts, hash of the trigger's gram, hash of the phrase."""
    none = np.zeros(0, np.int64)
    length = np.diff(offsets)
    if len(data) < WINDOW or not (length >= WINDOW).any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    mask = U64((1 << PLACE_BITS) - 1)
    gram = mix(Rolling(data).windows(GRAM))
    order = (gram & ~mask) | (mask - np.arange(len(gram), dtype=np.uint64))
    trigger = (mask - (_least(order, WINDOW - GRAM + 1) & mask)).astype(np.int64)
    del order
    inside = np.zeros(len(data) + 1, np.int8)
    whole = length >= WINDOW
    inside[offsets[:-1][whole]] = 1
    inside[offsets[1:][whole] - WINDOW + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(trigger)])
    at = trigger[start]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    low, high = start[new], start[np.concatenate((new[1:], [True]))]
    at = at[new]
    shape = ((at - low) * 256 + (high - at) + 1024).astype(np.uint64)
    phrase = mix(Rolling(data, BASE_2, VALUES_2).spans(low, high + WINDOW) + mix(shape))
    return np.searchsorted(offsets, low, "right") - 1, low, high - low + 1, gram[at], phrase


def _chunks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(ids, tags, bytes, offsets, place of the first byte in its document, other columns...); a long text comes in parts that overlap by WINDOW - 1 bytes."""
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch["text"])
        ids = np.array([_NO_ID if x is None else x for x in batch["doc_id"].to_pylist()], np.int64)
        rest = [batch[c] for c in columns]
        tag = batch["tag"].to_numpy() << TAG_SHIFT
        if len(data) <= CHUNK + WINDOW:
            yield ids, tag, data, offsets, 0, *rest
        else:
            for at in range(0, len(data), CHUNK):
                part = data[at : at + CHUNK + WINDOW - 1]
                yield ids, tag, part, np.array([0, len(part)]), at, *rest


def _dealer(records: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], blocks: int):
    """Deals records to blocks by their first hash. Of equal ones a task sends the first; what repeats it elsewhere goes, marked, to blocks in turn."""

    def deal(held: list[np.ndarray], turn: int) -> pa.RecordBatch:
        x = np.concatenate(held)
        x = x[np.lexsort((x["lo"], x["doc"], x["r"], x["a"]))]
        new, again = _behind(x)
        x, again = x[new | again], again[new | again]  # not those that stand where the first of their equals does
        # a trigger's hash is the least of many, so it is mixed anew: blocks of hashes as they are would be very uneven
        block = (((mix(x["a"]) >> U64(32)) * U64(blocks)) >> U64(32)).astype(np.int64)
        block[again] = (x["doc"][again] + turn) % blocks
        kind = block * 2 + again
        order = np.lexsort((x["lo"], x["doc"], kind))  # in the order of their places, which compresses well
        x, kind = x[order], kind[order]
        at = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
        pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        columns = [pa.array((kind[at[:-1]] // 2).astype(np.int32)), pa.array(kind[at[:-1]] % 2 == 1)]
        columns += [pa.array([np.ascontiguousarray(x[f][i:j]).tobytes() for i, j in pairs], pa.binary()) for f in _FIELDS]
        return pa.RecordBatch.from_arrays(columns, ["block", "again", *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, turn = [], 0, 0
        for x in records(batches):
            held.append(x)
            number += len(x)
            if number >= HELD:
                yield deal(held, turn)
                held, number, turn = [], 0, turn + 1
        if number:
            yield deal(held, turn)

    return run


_DEALT = "block int, again boolean, " + ", ".join(f"{f} binary" for f in _FIELDS)


def _records(**columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns["a"]), _RECORD)
    for f in _FIELDS:
        out[f] = columns[f]
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for ids, tag, data, offsets, place in _chunks(batches):
        text, low, n, gram, phrase = phrases(data, offsets)
        yield _records(a=gram, r=phrase, doc=ids[text], lo=tag[text] + low - offsets[text] + place, n=n)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The records of a block, and those that repeat another that their task met."""
    columns = {f: [np.frombuffer(x.as_buffer(), _RECORD[f]) for x in table[f]] for f in _FIELDS}
    again = np.repeat(table["again"].to_numpy(), [len(x) for x in columns["a"]])
    x = _records(**{f: np.concatenate(v) for f, v in columns.items()})
    return x[~again], x[again]


def _rows(x: np.ndarray, done: bool) -> pa.Table:
    return pa.table({"doc": x["doc"], "lo": x["lo"], "n": x["n"].astype(np.int32), "open": np.full(len(x), not done)})


def _behind(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records sorted by hashes and place: which begin a new string, and which stand behind an equal one in the corpus."""
    new = np.concatenate(([True], (x["a"][1:] != x["a"][:-1]) | (x["r"][1:] != x["r"][:-1])))
    first = x[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
    return new, (first["doc"] != x["doc"]) | (first["lo"] != x["lo"])


@settled
def _dictionary(table: pa.Table) -> pa.Table:
    """Of a block's phrases: those behind an equal one (their starts are repeats), and the firsts that share a trigger with another phrase."""
    x, again = _gathered(table)
    order = np.argsort(x["a"], kind="stable")
    x = x[order[several(x["a"][order])]]
    if not len(x):
        return _rows(again, True)
    x = x[np.lexsort((x["lo"], x["doc"], x["r"], x["a"]))]
    new, behind = _behind(x)
    firsts = x[new]
    return pa.concat_tables([_rows(again, True), _rows(x[behind], True), _rows(firsts[several(firsts["a"])], False)])


def _cut_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Each start of the open phrases of a document, with the hashes of the window there."""
    for ids, tag, data, offsets, place, spans in _chunks(batches, "spans"):
        count = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
        flat = spans.flatten()
        low, n = flat.field("lo").to_numpy() & _PLACE, flat.field("n").to_numpy()
        text = np.repeat(np.arange(len(count)), count)
        begin = np.repeat(low, n)
        start = begin + np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)
        text = np.repeat(text, n)
        at = start - place + offsets[text]
        here = (at >= offsets[text]) & (at + WINDOW <= offsets[text + 1])  # the windows of a part begin before CHUNK, as its bytes end
        at, text, start = at[here], text[here], start[here]
        one = mix(Rolling(data, BASE, BYTE_VALUES).spans(at, at + WINDOW))
        two = mix(Rolling(data, BASE_2, VALUES_2).spans(at, at + WINDOW))
        yield _records(a=one, r=two, doc=ids[text], lo=tag[text] + start, n=np.ones(len(at)))


@settled
def _suffixes(table: pa.Table) -> pa.Table:
    """Of a block's sorted suffixes: those that stand behind an equal one, as runs of starts."""
    x, again = _gathered(table)
    if len(x):
        x = x[np.lexsort((x["lo"], x["doc"], x["r"], x["a"]))]
        again = np.concatenate((again, x[_behind(x)[1]]))
    return _rows(again, True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = utf8(batch["text"])
        kept, spans = [], []
        for row, starts in enumerate(batch["starts"]):
            text = data[offsets[row] : offsets[row + 1]]
            if starts.is_valid and len(starts.values):
                low, n = starts.values.field("lo").to_numpy() & _PLACE, starts.values.field("n").to_numpy()
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, np.minimum(low, len(text)), 1)
                np.add.at(edge, np.minimum(low + n + WINDOW - 1, len(text)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
                kept.append(text[~gone].tobytes())
            else:
                spans.append([])
                kept.append(text.tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])


def _tagged(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with their tags, 0 where the id is that of no other row; and whether any id repeats."""
    repeated = staged(docs.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(True).alias("is"), "again"), "repeated")
    number = repeated.count()
    if not number:
        return docs.withColumn("tag", F.lit(0).cast("long")), False
    met = docs.join(F.broadcast(repeated) if number <= BROADCAST_IDS else repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left")
    tag = F.coalesce(F.crc32("text"), F.lit(0)).bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    return met.select("doc_id", "text", F.when(F.col("is"), tag).otherwise(0).cast("long").alias("tag")), True


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, kept (the bytes that stay) and spans (start and end of each maximal removed run). Other columns go."""
    docs, tagged = _tagged(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = "doc long, lo long, n int, open boolean"
    blocks = max(partitions, -(-size // BLOCK_BYTES))
    parsed = over_arrow(docs, _dealer(_parse, blocks), _DEALT).groupBy("block").applyInArrow(_dictionary, out)
    parsed = staged(parsed, "phrases")
    free(df.sparkSession)

    same, of_text = F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("doc"), ["doc"]
    if tagged:
        same, of_text = same & (F.col("tag") == F.col("of_tag")), ["doc", F.shiftright("lo", TAG_SHIFT).alias("of_tag")]
    still = parsed.filter("open").groupBy(*of_text).agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    with_open = docs.join(still, same).select("doc_id", "tag", "text", "spans")
    blocks = max(partitions, -(-(parsed.filter("open").agg(F.sum("n")).first()[0] or 0) * 34 // BLOCK_BYTES))
    sorted_out = staged(over_arrow(with_open, _dealer(_cut_suffixes, blocks), _DEALT).groupBy("block").applyInArrow(_suffixes, out), "suffixes")
    free(df.sparkSession)

    repeats = parsed.filter("not open").unionByName(sorted_out).groupBy(*of_text).agg(F.collect_list(F.struct("lo", "n")).alias("starts"))
    return over_arrow(docs.join(repeats, same, "left").select("doc_id", "text", "starts"), _cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256, at 100 bytes."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
