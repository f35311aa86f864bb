"""Jaccard self-join of word n-gram sets by PartEnum signatures, and the groups that its links make.

Two texts link when 100 * |A & B| >= 80 * |A | B| for their sets of distinct 5-word shingles (64-bit hashes).
Such sets differ in at most (|A| + |B|) / 9 elements, and the larger has at most 5/4 of the smaller.

* Sizes are cut into bands. A set signs for its own band and, where a partner may be in the next, for that.
* In a band with at most k differences the domain of hashes is cut into n1 groups of three parts, n1 > k / 2.
  A linked pair has a group with at most one unequal part: it agrees on one of the group's three pairs of
  parts. A signature is the hash of such a pair of parts of a set: so every linked pair shares a signature.
* Signatures of no element would be shared by unrelated texts. n1 has some slack, so that nearly every set
  must share signatures with elements; from the counts of its empty parts a set knows how many. It signs
  with the first groups only, up to the group from which on every partner must share ENOUGH signatures with it:
  of two partners the one with fewer groups has that assurance within them, and the other signs with them too.
  Sets that never get there sign with all groups. `need` is what a set is sure to share, ENOUGH at most.
  Only sets with no assurance at all sign with empty parts, in a space of their own: a pair needs them only if
  neither has one.
* A text that shares fewer signatures than it needs, with all others together, has no link and goes. So does a pair
  that shares fewer than either needs, or whose sizes are too far apart.

Equal sets are one node, the least id of them. Each node is compared with one lead: of the leads of its signatures' groups,
each the text that shares most, the one with which it shares most. Links make components, and only groups which still
hold several components have their members of
different components compared. So copies are not expanded into pairs and no link between different sets that matters to
the groups is lost. Every comparison is exact on the shingle hashes. Signatures travel in blocks of 11-byte
records, dealt by their hash; a signature that a task meets in several sets is known to be shared, and all but one of its
records go to blocks dealt by set, so a signature of very many sets fills no block. Nothing is collected to the driver.

Null text, empty text and text of white space have an empty set, which links with nothing. Rows that share an
id are one document, linked as any of its texts is. A null id gets a null component. The result has only the columns
doc_id, n_shingles and component_id, whatever others the rows have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, free, over_arrow, settled, slices, staged
from .components import components
from .textbytes import FOLD, NOT_SPACE, U64, mix, several, shingles, utf8, word_hashes, word_spans

WIDTH = 5
#: Highest over lowest size of a band; 5/4 is the least with which a partner is at most one band away.
RATIO = 1.6
#: Signatures that a pair must share where sets are large enough to have so many to spare.
ENOUGH = 6
#: Bytes of a signature and of a set's key in a record; a block's number makes up for the signature's other bytes.
SIG_BYTES, KEY_BYTES = 5, 6
#: Bytes of signature records in a block, and records that a task holds before it deals them out.
BLOCK_BYTES, HELD = 8 << 20, 1 << 19
#: Bytes of signature records beyond which the shuffle files of finished steps are let go before the next.
HEAVY = 1 << 28
#: Largest group of a signature whose pairs are joined; nodes and bytes of sets of a pack in larger ones, and columns of a product.
FEW, BLOCK_NODES, SIDE_BYTES, COLUMNS = 40, 1000, 16 << 20, 4096
#: Rows of ids up to which a table is broadcast to a scan (some 16 to 32 MB); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=1)
def _bands() -> tuple[np.ndarray, np.ndarray]:
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(max(low[-1], int(low[-1] * RATIO)))
        low.append(high[-1] + 1)
    return np.array(low[:-1]), np.array(high)


class Signing:
    """The bands in which sets sign, and their parts: sets stand in a row, sorted, `bounds` apart. An entry is a set and a band."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        low, high = _bands()
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        own, most = np.searchsorted(high, size[full]), size[full] * 5 // 4
        also = low[own + 1] <= most
        self.set = np.concatenate((full, full[also]))
        self.band = np.concatenate((own, own[also] + 1))
        top = high[self.band]
        k = 2 * top // 9
        self.groups = k // 2 + 1 + k // 24
        self.differ = (size[self.set] + np.minimum(np.concatenate((most, most[also])), top)) // 9
        length = size[self.set]
        entry = np.repeat(np.arange(len(self.set)), length)
        x = hashes[np.arange(len(entry)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(bounds[:-1][self.set], length)]
        parts = 3 * self.groups
        first = np.cumsum(parts) - parts
        place = first[entry] + (((x >> U64(32)) * parts[entry].astype(np.uint64)) >> U64(32)).astype(np.int64)
        count = np.bincount(place, minlength=int(parts.sum()))
        ends = np.cumsum(count)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x))))
        self.sums = (sums[ends] - sums[ends - count]).reshape(-1, 3)
        none = (count == 0).reshape(-1, 3)
        self.empty = np.stack([none[:, a] & none[:, b] for a, b in _PAIRS], 1)
        self.entry = np.repeat(np.arange(len(self.set)), self.groups)
        #: Groups of each entry are counted from 1; sure is what it must share within its groups up to each.
        begin = np.cumsum(self.groups) - self.groups
        self.number = np.arange(1, len(self.entry) + 1) - begin[self.entry]
        blank = np.cumsum(self.empty.sum(axis=1))
        before = np.concatenate(([0], blank))[begin]
        d = self.differ[self.entry]
        sure = np.where(d <= self.number, 3 * self.number - 2 * d, 2 * self.number - d) - (blank - before[self.entry])
        last = self.groups[self.entry]
        self.used = np.minimum.reduceat(np.where(sure >= ENOUGH, self.number, last), begin) if len(begin) else self.groups
        #: At least so many signatures with elements does an entry share with any linked set of its band.
        self.assured = np.minimum(ENOUGH, sure[begin + self.used - 1]) if len(begin) else self.groups

    def needed(self, sets: int) -> np.ndarray:
        """How many signatures each set must share, with all others together, to have a link."""
        out = np.full(sets, np.iinfo(np.int64).max)
        np.minimum.at(out, self.set, self.assured)
        return np.maximum(1, np.where(out == np.iinfo(np.int64).max, 0, out))

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """All signatures, and the set of each."""
        place = ((self.number - 1) * 8 + (self.band[self.entry] << 40)).astype(np.uint64)
        sig = np.stack([mix(mix(self.sums[:, a] + U64(1)) + U64(3) * mix(self.sums[:, b] + U64(2)) + mix(place + U64(c))) for c, (a, b) in enumerate(_PAIRS)], 1)
        alone = (self.assured < 1)[self.entry][:, None]
        sig = np.where(self.empty & alone, mix(sig + U64(77)), sig)
        kept = (~self.empty | alone) & (self.number <= self.used[self.entry])[:, None]
        return sig[kept], np.repeat(self.set[self.entry], kept.sum(axis=1))


_PAIRS = ((0, 1), (0, 2), (1, 2))


def signatures(hashes: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of one sorted set of distinct hashes."""
    return Signing(hashes, np.array([0, len(hashes)])).signatures()[0]


def needed(hashes: np.ndarray) -> int:
    return int(Signing(hashes, np.array([0, len(hashes)])).needed(1)[0])


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of shingle hashes of the texts, in a row, and their bounds."""
    data, offsets = utf8(batch["text"])
    start, end, first = word_spans(data, offsets, NOT_SPACE)
    found, at = shingles(word_hashes(FOLD[data], start, end), first, WIDTH)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[at[:-1][at[:-1] < len(found)]] = True
    return found[new], np.concatenate(([0], np.cumsum(new)))[at]


def _key(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that stand for each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + U64(salt)))))
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, bounds = _sets(batch)
        need = Signing(hashes, bounds).needed(batch.num_rows)
        columns = [np.diff(bounds), _key(hashes, bounds, 11), _key(hashes, bounds, 23), need]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", "n_shingles", "one", "two", "need"])


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    return values.view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64).ravel()


#: The part of a set's first key that records have, as an expression over it.
_KEY = f"one & {(1 << 8 * KEY_BYTES) - 1}L"


def _sign(blocks: int):
    """Records (signature, key of its set), dealt to blocks by signature; a set that this task has seen signs once.

    Signatures that the task finds in several sets are shared for sure: their records are dealt by set, and one of each
    goes to the signature's block as well, where other tasks' records of it may wait."""

    def dealt(block: np.ndarray, rows: np.ndarray, sure: bool) -> pa.RecordBatch:
        order = np.argsort(block, kind="stable")
        rows, block = rows[order], block[order]
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        parts = [rows[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[at[:-1]].astype(np.int32)), pa.array([sure] * len(parts)), pa.array(parts, pa.binary())], ["block", "sure", "records"])

    def deal(sigs: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, key = np.concatenate(sigs), np.concatenate(keys).view(np.uint64)
        order = np.argsort(sig, kind="stable")
        sig, key = sig[order], key[order]
        block = ((sig >> U64(32)) * U64(blocks)) >> U64(32)
        more = several(sig)
        first = np.concatenate(([True], sig[1:] != sig[:-1]))
        if more.any():
            whole = (block[more] << U64(8 * SIG_BYTES)) | (sig[more] & U64((1 << 8 * SIG_BYTES) - 1))
            by_set = ((mix(sig[more] + key[more]) >> U64(32)) * U64(blocks)) >> U64(32)
            yield dealt(by_set, np.hstack((_packed(whole, 8), _packed(key[more], KEY_BYTES))), True)
        sig, key, block = sig[first], key[first], block[first]
        yield dealt(block, np.hstack((_packed(sig, SIG_BYTES), _packed(key, KEY_BYTES))), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys, held, seen = [], [], 0, set()
        for batch in slices(batches, "text"):
            hashes, bounds = _sets(batch.filter(pc.is_valid(batch["doc_id"])))
            key = _key(hashes, bounds, 11)
            fresh = np.zeros(len(key), bool)
            for i, x in enumerate(zip(key.tolist(), _key(hashes, bounds, 23).tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            sig, of = Signing(hashes, bounds).signatures()
            sigs.append(sig[fresh[of]])
            keys.append(key[of[fresh[of]]])
            held += len(sigs[-1])
            if held >= HELD:
                yield from deal(sigs, keys)
                sigs.clear()
                keys.clear()
                held = 0
        if held:
            yield from deal(sigs, keys)

    return run


@settled
def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """(sig, key) of the signatures in a block that more than one set has, and of those known to be shared."""
    rows = {True: [], False: []}
    for sure, part in zip(table["sure"].to_pylist(), table["records"], strict=True):
        rows[sure].append(np.frombuffer(part.as_buffer(), np.uint8).reshape(-1, (8 if sure else SIG_BYTES) + KEY_BYTES))
    out = []
    for sure, parts in rows.items():
        if not parts:
            continue
        both = np.concatenate(parts)
        sig, of = _unpacked(both[:, :-KEY_BYTES]), _unpacked(both[:, -KEY_BYTES:])
        if not sure:
            sig |= U64(key[0].as_py() << 8 * SIG_BYTES)
            order = np.argsort(sig, kind="stable")
            order = order[several(sig[order])]
            sig, of = sig[order], of[order]
        order = np.lexsort((of, sig))
        sig, of = sig[order], of[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
        sig, of = sig[new], of[new]
        kept = slice(None) if sure else several(sig)
        out.append(pa.table({"sig": sig[kept].view(np.int64), "key": of[kept].view(np.int64)}))
    return pa.concat_tables(out)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, bounds = _sets(batch)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["node", "hashes"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _small(df: DataFrame) -> DataFrame:
    """A staged table of ids, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of staged pairs (a, b) those whose sets are similar enough. The sets of a travel to those of b, which had best be the fewer; Spark splits a hot b."""
    ends = staged(pairs.select("b").distinct(), "ends")
    one = sets.join(_small(pairs), sets.node == pairs.a).select("a", "b", F.col("hashes").alias("hashes_a"))
    two = sets.join(_small(ends), sets.node == ends.b).select("b", F.col("hashes").alias("hashes_b"))
    return over_arrow(one.join(two, "b").select("a", "b", "hashes_a", "hashes_b"), _compare, "a long, b long")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without the pairs whose sizes are too far apart, or (if they have a count of shared signatures, `c`) that share fewer than they need."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("need").alias(f"need_{end}")), end)
    out = pairs.filter("100 * least(size_a, size_b) >= 80 * greatest(size_a, size_b)")
    return (out.filter("c >= greatest(need_a, need_b)") if "c" in pairs.columns else out).select("a", "b")


def _ties(part: np.ndarray, node: np.ndarray, hashes: list[np.ndarray], one: np.ndarray) -> pa.Table:
    """Links that tie parts together, among all pairs of one node from either side (one, ~one): a spanning forest of them."""
    size = np.array([len(x) for x in hashes])
    word, place = np.unique(np.concatenate(hashes), return_inverse=True)
    row = np.repeat(np.arange(len(hashes)), size)
    first, second = np.flatnonzero(one), np.flatnonzero(~one)
    there = np.zeros((2, len(word)), bool)
    there[0, place[one[row]]] = there[1, place[~one[row]]] = True
    column = np.cumsum(there.all(axis=0)) - 1
    both = np.zeros((len(first), len(second)), np.int64)
    kept = there.all(axis=0)[place]
    row, column = row[kept], column[place[kept]]
    at = np.empty(len(hashes), np.int64)
    at[first], at[second] = np.arange(len(first)), np.arange(len(second))
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        r, c = row[here], column[here] - low
        left, right = np.zeros((len(first), COLUMNS), np.float32), np.zeros((len(second), COLUMNS), np.float32)
        left[at[r[one[r]]], c[one[r]]] = 1
        right[at[r[~one[r]]], c[~one[r]]] = 1
        both += (left @ right.T).astype(np.int64)
    near = 100 * both >= 80 * (size[first][:, None] + size[second][None, :] - both)
    root = {x: x for x in part.tolist()}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near & (part[first][:, None] != part[second][None, :]))), strict=True):
        x, y = top(int(part[first[i]])), top(int(part[second[j]]))
        if x != y:
            root[x] = y
            out.append((int(node[first[i]]), int(node[second[j]])))
    return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})


@settled
def _blocks(group: pa.Table) -> pa.Table:
    return _ties(np.array(group["part"]), np.array(group["node"]), [np.frombuffer(x.as_buffer(), np.uint64) for x in group["hashes"]], np.array(group["one"]))


#: The columns of a pack that are numbers, and then their sets; a pack is one row.
_PACK = ("part", "node", "size", "hashes")


@settled
def _pack(key: tuple, group: pa.Table) -> pa.Table:
    """A chunk of nodes and their sets as one row."""
    size = np.array([len(x.as_buffer()) // 8 for x in group["hashes"]], np.int64)
    columns = [np.array(group["part"]).astype(np.int64).tobytes(), np.array(group["node"]).astype(np.int64).tobytes(), size.tobytes(), b"".join(x.as_py() for x in group["hashes"])]
    return pa.table({"component": [key[0].as_py()], "out": [key[1].as_py()], "at": pa.array([key[2].as_py()], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in zip(_PACK, columns, strict=True)})


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each two packs; those of a pack with itself too."""
    for batch in batches:
        for r in range(batch.num_rows):
            sides = []
            for end in ("a", "b"):
                part, node, size, hashes = (np.frombuffer(batch[f"{c}_{end}"][r].as_buffer(), np.uint64 if c == "hashes" else np.int64) for c in _PACK)
                sides.append((part, node, np.split(hashes, np.cumsum(size)[:-1])))
            (part, node, one), (other, mate, two) = sides
            found = _ties(np.concatenate((part, other)), np.concatenate((node, mate)), one + two, np.arange(len(one) + len(two)) < len(one))
            yield from found.to_batches()


def _between(packs: DataFrame) -> DataFrame:
    """Links of the nodes outside a component's largest part with one another and with that part's. Tasks read the packs of two parts of the table each: none is shuffled again, however many there are."""
    side = lambda end: packs.select("component", *[F.col(c).alias(f"{c}_{end}") for c in ("out", "at", *_PACK)])
    met = side("a").filter("out_a").join(side("b").hint("shuffle_replicate_nl"), "component").filter("not out_b or at_a <= at_b")
    return over_arrow(met.drop("component", "out_a", "out_b", "at_a", "at_b"), _packs, "a long, b long")


def _across(placed: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between different parts of the groups of signatures that still hold several.

    In a group of at most FEW nodes each pair of different parts is counted, and compared if it shares as many signatures
    as it needs. Larger groups are joined where they share nodes; there, each node outside the largest part is compared
    with all, in packs of nodes that are written once: the pairs of two packs are counted by a product of matrices, and
    only links that tie parts together leave it. A pair that a large group holds is compared there, so the counts of others are whole.
    """
    several = placed.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).filter("low < high").select("sig", "size", "lead")
    placed = staged(placed.join(several, "sig"), "open")
    few = placed.filter(F.col("size") <= FEW)
    other = few.select("sig", F.col("node").alias("b"), F.col("part").alias("other"))
    near = few.join(other, "sig").filter("node < b and part <> other").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
    links = _linked(staged(_likely(near, nodes), "pairs"), sets)
    large = placed.filter(F.col("size") > FEW)
    if large.isEmpty():
        return links
    cluster = components(large.select("node", "lead"), "node", "lead")
    inside = large.select("node", "part").distinct().join(nodes.select("node", F.col("size").alias("bytes")), "node")
    inside = staged(cluster.join(inside, "node"), "clusters")
    count = inside.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("bytes")).alias("bytes"))
    largest = count.groupBy("component").agg(F.max(F.struct("n", "part", "bytes")).alias("most"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"))
    chunks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(size / SIDE_BYTES)).cast("int")
    main = F.col("most.part").alias("main")
    largest = largest.select("component", main, chunks(F.col("all") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("rows"), chunks(F.col("most.n"), F.col("most.bytes")).alias("columns"))
    inside = staged(inside.join(largest, "component").drop("bytes"), "clusters")
    sized = sets.join(_small(inside), "node").withColumn("out", F.col("part") != F.col("main"))
    whole = sized.filter("rows = 1 and columns = 1").select("component", "node", "part", "hashes", "out")
    each = whole.filter("out").withColumn("one", F.lit(True)).unionByName(whole.withColumn("one", F.lit(False)))
    links = links.unionByName(each.groupBy("component").applyInArrow(_blocks, "a long, b long"))
    cut = sized.filter("rows > 1 or columns > 1").withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("rows")).otherwise(F.col("columns"))).cast("int"))
    if inside.filter("rows > 1 or columns > 1").isEmpty():
        return links
    files = math.ceil(math.sqrt(4 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # each two of them are a task
    dealt = cut.select("component", "out", "at", "part", "node", "hashes").repartition(files, "component", "out", "at").groupBy("component", "out", "at")
    packs = staged(dealt.applyInArrow(_pack, "component long, out boolean, at int, part binary, node binary, size binary, hashes binary"), "packs")
    return links.unionByName(_between(packs))


def ngram_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_shingles (size of its set) and component_id (the least id that its links reach, its own included). Other columns go."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = staged(over_arrow(docs, _describe, "doc_id long, n_shingles long, one long, two long, need long"), "shingles")
    signing = described.filter("n_shingles > 0 and doc_id is not null")
    least = staged(signing.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("node"), F.min("need").alias("need")).withColumn("key", F.expr(_KEY)), "sets")
    nodes = signing.join(least, ["n_shingles", "one", "two"]).groupBy("doc_id").agg(F.min("node").alias("node"), F.collect_set("node").alias("own"))
    nodes = staged(nodes, "nodes")
    # rows of one id with several sets tie the nodes of these sets
    tied = nodes.filter(F.size("own") > 1).select(F.col("node").alias("a"), F.explode("own").alias("b")).filter("a <> b")

    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(partitions, -(-total * (SIG_BYTES + KEY_BYTES) // BLOCK_BYTES))
    dealt = over_arrow(docs, _sign(blocks), "block int, sure boolean, records binary").groupBy("block")
    shared = staged(dealt.applyInArrow(_shared, "sig long, key long"), "shared")

    known = least.select("key", "node", "need", F.col("n_shingles").alias("size"))
    enough = staged(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(known, "key").filter("n >= need"), "enough")
    members = staged(shared.join(_small(enough), "key").select("sig", "node", "n"), "members")
    discard(shared, least)
    heavy = total * (SIG_BYTES + KEY_BYTES) > HEAVY
    if heavy:
        free(df.sparkSession)
    # the text that shares most is the one least edited, so most others are near to it
    lead = members.groupBy("sig").agg(F.max(F.struct("n", (-F.col("node")).alias("node"))).alias("lead"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("sig", (-F.col("lead.node")).alias("lead"))
    met = staged(members.join(lead, "sig").filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c")), "met")

    wanted = staged(met.select(F.explode(F.array("node", "lead")).alias("node")).distinct(), "wanted")
    sets = staged(over_arrow(docs.join(_small(wanted), docs.doc_id == wanted.node, "left_semi"), _hashes, "node long, hashes binary"), "sets")

    best = met.groupBy(F.col("node").alias("a")).agg((-F.max(F.struct("c", (-F.col("lead")).alias("b")))["b"]).alias("b"))
    links = staged(_linked(staged(_likely(best, enough), "pairs"), sets).unionByName(tied), "linked")
    if heavy:
        free(df.sparkSession)
    found = staged(components(links, "a", "b"), "components")
    placed = members.join(_small(found), "node", "left").select("sig", "node", F.coalesce("component", "node").alias("part"))
    more = staged(_across(placed, sets, enough), "linked")
    discard(members, sets, met, wanted, enough)
    if heavy:
        free(df.sparkSession)
    if more.count():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    where = nodes.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return described.join(where, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Per document: n_shingles and component_id, at five words and a similarity of 0.8."""
    return ngram_components(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""
