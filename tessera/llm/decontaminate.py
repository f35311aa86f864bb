"""Benchmark decontamination with an FM-index of each shard of training texts.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. An item's windows are its runs of
WINDOW consecutive words; an item of fewer words, but some, is one window; null or wordless items have none. A
document word inside any occurrence of a window is hit.

A shard is the documents of a task, up to SHARD_BYTES of text. Words that no item has cannot be in an occurrence,
so the index is built over the maximal runs of the items' words that are at least as long as the shortest
window: their suffixes are sorted, the Burrows-Wheeler transform is kept in a wavelet matrix, and suffix
positions are sampled at each run's start and every SAMPLE-th place. All windows are searched backwards at once;
occurrences are located by stepping back to a sampled position, and spans are merged. Shards need no shuffle, and
a lost task rebuilds its own.

The items are written to the shared folder in blocks of about ITEM_BYTES of text, dealt by the hash of their text, and
tasks read them there: neither the driver nor the plan holds any. The documents are scanned once; a task searches each
of its shards for the windows of one block after the other and keeps the last block that it read. Of a block's windows
only those whose words the shard has are searched for.
Null text has no words. Items without an id hit, but are not named; items of one id count once. Every row of the
documents, repeated or not, gets its own result. Columns of the documents named __text, __words, __hits, __bytes or
__items are replaced, or go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, over_arrow, plus, shared_dir, slices
from .textbytes import ALNUM, FOLD, utf8, word_hashes, word_spans

WINDOW, SAMPLE = 10, 16
#: Bytes of text in a shard where there is one block of items, and where there are more; bytes of items in a block.
SHARD_BYTES, LONG_SHARD_BYTES, ITEM_BYTES = 1 << 20, 4 << 20, 16 << 20


class FMIndex:
    """Backward search and location over sequences of symbols from 1 to `top`; 0 stands between sequences."""

    def __init__(self, text: np.ndarray, top: int):
        """`text` begins and ends with 0."""
        n = len(text)
        apart = text == 0
        rank = np.where(apart, np.cumsum(apart) - 1, text + int(apart.sum())).astype(np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        rank = self._ranks(rank[order], order)
        while rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank, step = self._ranks(key[order], order), step * 2
        before = np.where(order > 0, text[order - 1], 0)
        self.least = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.levels = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            one = (before >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate(([0], np.cumsum(~one)))))
            before = np.concatenate((before[~one], before[one]))
        self.symbols = np.where(order > 0, text[order - 1], 0)
        sampled = (order % SAMPLE == 0) | (self.symbols == 0)
        self.sampled, self.places = np.where(sampled, np.cumsum(sampled) - 1, -1), order[sampled]

    @staticmethod
    def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
        return out

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the rows' suffixes stand with the symbol put before them."""
        low = np.zeros(len(row), np.int64)
        for bit, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            row = np.where(one, zeros[-1] + row - zeros[row], zeros[row])
            low = np.where(one, zeros[-1] + low - zeros[low], zeros[low])
        return self.least[symbol] + row - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows (first, one past the last) of the suffixes that begin with each window; shorter windows end in zeros."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.symbols))
        for k in reversed(range(windows.shape[1])):
            on = np.flatnonzero((windows[:, k] > 0) & (low < high))
            symbol = windows[on, k]
            low[on], high[on] = self.step(symbol, low[on]), self.step(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, on, back = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(on):
            known = self.sampled[row] >= 0
            out[on[known]] = self.places[self.sampled[row[known]]] + back
            on, row, back = on[~known], row[~known], back + 1
            row = self.step(self.symbols[row], row)
        return out


class Windows:
    """The distinct windows of a block of items, as symbols, and which items have each."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        data, offsets = utf8(pa.array([text for _, text in items], pa.large_string()))
        data = FOLD[data]
        start, end, first = word_spans(data, offsets, ALNUM)
        words = word_hashes(data, start, end)
        self.vocabulary = np.unique(words)
        symbol = np.searchsorted(self.vocabulary, words) + 1
        seen: dict[tuple[int, ...], dict[str, None]] = {}
        for (name, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            for at in range(a, max(b - width + 1, min(a + 1, b))):
                names = seen.setdefault(tuple(symbol[at : min(at + width, b)].tolist()), {})
                if name is not None:
                    names[name] = None
        self.length = np.array([len(x) for x in seen], np.int64)
        self.symbols = np.zeros((len(seen), width), np.int64)
        for row, x in enumerate(seen):
            self.symbols[row, : len(x)] = x
        self.names = [list(x) for x in seen.values()]

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the window of each occurrence in texts whose words' hashes stand in a row."""
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.length):
            return none, none
        symbol = np.searchsorted(self.vocabulary, words)
        symbol[symbol == len(self.vocabulary)] = 0
        symbol = np.where(self.vocabulary[symbol] == words, symbol + 1, 0)
        inside = symbol > 0
        edge = np.zeros(len(words) + 1, bool)
        edge[first] = True
        begin = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1]))
        end = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])) + 1
        long = end - begin >= self.length.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return none, none
        size = end - begin
        at = np.cumsum(size + 1) - size  # of each run in the indexed text, which begins with 0
        text = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(at, size) + within] = symbol[np.repeat(begin, size) + within]
        index = FMIndex(text, len(self.vocabulary))
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[text] = True  # 0 is
        likely = np.flatnonzero(there[self.symbols].all(axis=1))
        low, high = index.search(self.symbols[likely])
        count = high - low
        window = np.repeat(likely, count)
        place = index.locate(np.repeat(low, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count))
        run = np.searchsorted(at, place, "right") - 1
        return begin[run] + place - at[run], window


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in slices(batches, "__text"):
        held.append(batch)
        size += batch["__text"].nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@lru_cache(maxsize=1)
def _block(folder: str, block: int, width: int) -> Windows:
    """The windows of a block of items, read from the shared folder."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    parts = [pq.read_table(x.path, columns=["name", "words"], filesystem=store, partitioning=None) for x in found if x.path.endswith(".parquet")]
    return Windows([r for t in parts for r in zip(t["name"].to_pylist(), t["words"].to_pylist(), strict=True)], width)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _without(text: str, spans: list[dict]) -> str:
    data, at, kept = text.encode(), 0, []
    for x in spans:
        kept.append(data[at : x["start"]])
        at = x["end"]
    return b"".join([*kept, data[at:]]).decode()


def _scanner(folder: str, blocks: int, width: int, cut: str | None):
    """Adds what the blocks of items have in the texts; with `cut`, the spans go from that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, SHARD_BYTES if blocks == 1 else LONG_SHARD_BYTES):
            data, offsets = utf8(shard["__text"])
            data = FOLD[data]
            start, end, first = word_spans(data, offsets, ALNUM)
            hashes = word_hashes(data, start, end)
            edge = np.zeros(len(start) + 1, np.int64)
            names: list[set[str]] = [set() for _ in range(len(first) - 1)]
            for block in range(blocks):
                windows = _block(folder, block, width)
                word, window = windows.find(hashes, first)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + windows.length[window], -1)
                doc = np.searchsorted(first, word, "right") - 1
                both = np.unique(doc * max(1, len(windows.length)) + window)
                for row, w in zip(*(x.tolist() for x in np.divmod(both, max(1, len(windows.length)))), strict=True):
                    names[row].update(windows.names[w])
            hit = np.cumsum(edge[:-1]) > 0
            hits: list[list[dict]] = [[] for _ in names]
            last = np.zeros(len(start) + 1, bool)
            last[first] = True
            begin = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & ~last[:-1])) if len(hit) else np.zeros(0, np.int64)
            stop = np.flatnonzero(hit & ~(np.concatenate((hit[1:], [False])) & ~last[1:])) + 1 if len(hit) else np.zeros(0, np.int64)
            rows = np.searchsorted(first, begin, "right") - 1
            bytes_: list[list[dict]] = [[] for _ in hits]
            for row, a, b in zip(rows.tolist(), begin.tolist(), stop.tolist(), strict=True):
                hits[row].append({"start": a - int(first[row]), "end": b - int(first[row])})
                bytes_[row].append({"start": int(start[a] - offsets[row]), "end": int(end[b - 1] - offsets[row])})
            found = {"__words": pa.array(np.diff(first)), "__hits": pa.array(hits, _SPANS), "__bytes": pa.array(bytes_, _SPANS), "__items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))}
            if cut:
                found[cut] = pa.array([_without(t, x) if x else t for t, x in zip(shard["__text"].to_pylist(), bytes_, strict=True)], pa.string())
            whole = shard.drop_columns([cut] if cut else [])
            order = [*shard.column_names, *_FOUND]
            columns = dict(zip(whole.column_names, whole.columns, strict=True)) | found
            yield from pa.table([columns[n] for n in order], names=order).combine_chunks().to_batches()

    return run


_FOUND = ("__words", "__hits", "__bytes", "__items")


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, width: int, cut: bool) -> DataFrame:
    spark, kind = docs.sparkSession, "array<struct<start:bigint,end:bigint>>"
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("words")).filter("words is not null")
    size = items.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    folder = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    items.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int")).repartition(min(blocks, 1000), "block").write.partitionBy("block").parquet(folder)
    df, schema = plus(docs.drop("__text").withColumn("__text", F.col(text)), f"__words bigint, __hits {kind}, __bytes {kind}, __items array<string>", *_FOUND)
    return over_arrow(df, _scanner(folder, blocks, width, text if cut else None), schema).drop("__text")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """The documents with all their columns, and four more: __words (their number), __hits and __bytes (merged spans
    of hit words, by word and by byte of the text), __items (ids of the items with occurring windows, sorted)."""
    return _scanned(docs, benchmark, text, item_id, item_text, width, False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """The documents with the spans of hit words cut out of their texts; the rest of each text and its other columns stay."""
    return _scanned(docs, benchmark, text, item_id, item_text, width, True).drop("__words", "__hits", "__bytes", "__items")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; for windows of ten words."""
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("text")
    hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN n),
h AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM p) JOIN g USING (g)),
x AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
