"""The prefix trie of conversations: which of them share their first turns, and the words that sharing saves.

A turn (role, text) is a 16-byte id, its MD5 over lengths and values; a conversation is the row of its turns' ids, big-endian
bytes that sort as they stand. Equal conversations are one key with their members counted before any key travels, so a
conversation with very many copies is one row. Keys are dealt to tasks by ranges, so a very common first turn spans many tasks
and none holds it whole. A task puts some thousands of sorted keys at a time into an adaptive radix tree (`radix_tree`): its
compressed paths may hold many turns, and nodes are emitted where a turn ends.

A node that holds neither the first nor the last key of its keys is done there. Those that do are the spines: two paths a
piece, whose numbers are sums and minima of what lies on either side. Neighbouring pieces are merged in key order, in the task
and then across tasks, FAN pieces at a time; that closes what neither reaches the outer ends. What closes below a spine's
node names that node by the MD5 of its key, and a last join gives it the node's smallest member.

Memory is a piece of keys, two spines and the turns of the longest conversation. Conversations of a null id are left out. Turns
of equal place are ordered by role and text. An empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import over_arrow, staged
from .radix_tree import RadixTree

WIDTH = 16
#: Keys of a tree and their bytes; pieces merged by one task; bits of the ids whose list is one string; bytes of keys of a task.
TREE_KEYS, TREE_BYTES, FAN, CHUNK_BITS, TASK_BYTES = 4096, 4 << 20, 256, 12, 32 << 20
_NOBODY = hashlib.sha256(b"").hexdigest()
_WORDS = r"[^\x20\x09-\x0D]+"


def turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, words): each conversation's turns in order, as hex ids and numbers of words."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = table.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), value(role).alias("role"), value(text).alias("text"))
    rows = rows.withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")))
    id = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.select("conv_id", F.struct("p", id.alias("id"), F.regexp_count("text", F.lit(_WORDS)).cast("int").alias("w")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.w").alias("words"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c, begun with the first h turns of c - c % every in place of its own; h = crc32(c as text) % most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    donor = conversations.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.slice("ids", 1, most).alias("di"), F.slice("words", 1, most).alias("dw"))
    met = conversations.withColumns({"h": h, "donor": F.col("conv_id") - F.col("conv_id") % every}).join(donor, "donor", "left")

    def one(first: str, own: str) -> Column:
        begin = F.when(F.col("h") > 0, F.slice(F.col(first), F.lit(1), F.col("h")))
        rest = F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own), F.lit(1)))
        return F.concat(F.coalesce(begin, F.slice(F.col(own), 1, 0)), rest)

    return met.select("conv_id", one("di", "ids").alias("ids"), one("dw", "words").alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(key, words, conv, n, ends): distinct conversations, their least member, number, and the SHA-256 of their members' ids.

    A list of ids is made in strings of a range of ids each, side by side; a task then streams the strings of its keys through the hash."""
    keyed = conversations.select(F.unhex(F.array_join("ids", "")).alias("key"), "words", "conv_id")
    parts = keyed.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("list"), F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return over_arrow(parts.repartition(n, "key").sortWithinPartitions("key", "chunk"), _ends, "key binary, words array<int>, conv long, n long, ends string")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())), ("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    now, out = None, []

    def row() -> dict:
        return {"key": now[0], "words": now[1], "conv": now[2], "n": now[3], "ends": now[4].hexdigest()}

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now[0] != r["key"]:
                if now is not None:
                    out.append(row())
                now = [r["key"], r["words"], r["conv"], r["n"], hashlib.sha256(r["list"].encode())]
            else:
                now[2], now[3] = min(now[2], r["conv"]), now[3] + r["n"]
                now[4].update(b"," + r["list"].encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


class _Open:
    """A node that a neighbour may still reach: its members so far, and what its closed children came to."""

    __slots__ = ("digest", "conv", "n", "words", "kids", "leaves", "saved", "ends")

    def __init__(self, digest: bytes, conv: int, n: int, words: int, kids: int, leaves: int, saved: int, ends: str | None):
        self.digest, self.conv, self.n, self.words = digest, conv, n, words
        self.kids, self.leaves, self.saved, self.ends = kids, leaves, saved, ends

    def add(self, other: _Open) -> None:
        """The same node from the piece behind."""
        self.conv, self.n, self.kids = min(self.conv, other.conv), self.n + other.n, self.kids + other.kids
        self.leaves, self.saved, self.ends = self.leaves + other.leaves, self.saved + other.saved, self.ends or other.ends

    def state(self) -> list:
        return [self.digest.hex(), self.conv, self.n, self.words, self.kids, self.leaves, self.saved, self.ends]


class _Piece:
    """Keys in a row, by their first and last: the open nodes along both, root first. What they share is the same object."""

    __slots__ = ("first", "last", "left", "right")

    def __init__(self, first: bytes, last: bytes, left: list[_Open], right: list[_Open]):
        self.first, self.last, self.left, self.right = first, last, left, right


class _Rows:
    """The closed nodes, in Arrow batches. A row's parent is known by its member, or by its digest where it is still open."""

    schema = pa.schema([("digest", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.string()), ("parent_conv_id", pa.int64()), *((c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("piece", pa.binary())])

    def __init__(self):
        self.rows: list[tuple] = []

    def close(self, node: _Open, depth: int, parent: _Open | None) -> None:
        """The node gets no more members; its numbers go to its parent."""
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
        self.rows.append((node.digest.hex(), node.conv, depth, parent and parent.digest.hex(), None, node.n, node.kids, leaves, saved, node.ends or _NOBODY, None))
        if parent is not None:
            parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved

    def batches(self, all: bool = False) -> Iterator[pa.RecordBatch]:
        while len(self.rows) >= 4096 or all and self.rows:
            some, self.rows = self.rows[:4096], self.rows[4096:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), self.schema, strict=True)], schema=self.schema)


def _shared(a: bytes, b: bytes) -> int:
    """How many ids two keys begin with in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


class _Sum:
    """Below an end of a turn: what the keys there came to."""

    __slots__ = ("conv", "n", "kids", "leaves", "saved", "first", "last", "words", "ends", "pending")

    def __init__(self):
        self.conv, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.first, self.last, self.words, self.ends, self.pending = None, None, None, None, []

    def key(self, at: int, conv: int, n: int, words: list[int]) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.last, self.words = self.n + n, at, words
        self.first = at if self.first is None else self.first

    def below(self, x: _Sum) -> None:
        """A part of the same id, or of ids below, that is summed."""
        self.key(x.first, x.conv, x.n, x.words)
        self.last = x.last
        self.kids, self.leaves, self.saved = self.kids + x.kids, self.leaves + x.leaves, self.saved + x.saved
        self.pending += x.pending


def _grown(rows: list[dict], out: _Rows) -> _Piece:
    """The tree of sorted distinct keys: nodes that hold neither the first nor the last are closed, the others are the piece's spines."""
    tree, end = RadixTree(), len(rows) - 1
    for at, r in enumerate(rows):
        tree.insert(r["key"], (at, r))
    first, last = rows[0]["key"], rows[end]["key"]
    left, right = [None] * (len(first) // WIDTH + 1), [None] * (len(last) // WIDTH + 1)
    digests = {id(left): _digests(first), id(right): _digests(last)}
    sums: list[_Sum] = []
    for node, depth, done in tree.walk():
        if not done:
            sums.append(_Sum())
            continue
        now = sums.pop()
        if node.value is not None:
            at, r = node.value
            inner, now = now, _Sum()
            now.key(at, r["conv"], r["n"], r["words"])
            if inner.n:
                now.below(inner)
            now.ends = r["ends"]
        # the ends of turns on this node's path, the deepest first
        at = depth // WIDTH
        low = depth - len(node.path)
        while at * WIDTH > low or node is tree.root:
            now = _turn(now, at, end, left, right, digests, out)
            at -= 1
            if node is tree.root:
                break
        if sums:
            sums[-1].below(now)
    for path in (left, right):
        for depth, x in enumerate(path):
            if x is None:  # shared by both
                path[depth] = (right if path is left else left)[depth]
    return _Piece(first, last, left, right)


def _turn(now: _Sum, depth: int, end: int, left: list, right: list, digests: dict, out: _Rows) -> _Sum:
    """The node where a turn ends: emitted, or kept on a spine; and what its parent gets of it."""
    up = _Sum()
    up.key(now.first, now.conv, now.n, now.words)
    up.last = now.last
    words = now.words[depth - 1] if depth else 0
    if now.first == 0 or now.last == end:
        spine = left if now.first == 0 else right
        node = _Open(digests[id(spine)][depth], now.conv, now.n, words, now.kids, now.leaves, now.saved, now.ends)
        spine[depth] = node
        for row in now.pending:
            row[3] = node.digest.hex()
        return up
    leaves, saved = now.leaves or 1, now.saved + (now.n - 1) * words
    for row in now.pending:
        row[4] = now.conv
    row = [None, now.conv, depth, None, None, now.n, now.kids, leaves, saved, now.ends or _NOBODY, None]
    out.rows.append(row)
    up.kids, up.leaves, up.saved, up.pending = 1, leaves, saved, [row]
    return up


def _digests(key: bytes) -> list[bytes]:
    """Of each beginning of the key that is a row of ids."""
    running, out = hashlib.md5(usedforsecurity=False), []
    for at in range(0, len(key) + 1, WIDTH):
        out.append(running.digest())
        running.update(key[at : at + WIDTH])
    return out


def _merged(a: _Piece, b: _Piece, out: _Rows) -> _Piece:
    """Two pieces, one behind the other: what reaches neither outer end is closed."""
    c, in_a, in_b = _shared(a.last, b.first), _shared(a.first, a.last), _shared(b.first, b.last)
    for d in range(len(a.right) - 1, max(c, in_a), -1):
        out.close(a.right[d], d, a.right[d - 1])
    for d in range(len(b.left) - 1, max(c, in_b), -1):
        out.close(b.left[d], d, b.left[d - 1])
    both = a.right[: c + 1]
    for d in range(c + 1):
        both[d].add(b.left[d])
    for d in range(c, max(in_a, in_b), -1):
        out.close(both[d], d, both[d - 1])
    left = [both[d] if d <= min(c, in_a) else x for d, x in enumerate(a.left)]
    right = [both[d] if d <= min(c, in_b) else x for d, x in enumerate(b.right)]
    return _Piece(a.first, b.last, left, right)


def _closed(piece: _Piece, out: _Rows) -> None:
    """All that is left open, up to the root."""
    same = _shared(piece.first, piece.last)
    for path in (piece.left, piece.right):
        for d in range(len(path) - 1, same, -1):
            out.close(path[d], d, path[d - 1])
    for d in range(same, -1, -1):
        out.close(piece.left[d], d, piece.left[d - 1] if d else None)


def _packed(piece: _Piece) -> bytes:
    return json.dumps([piece.first.hex(), piece.last.hex(), [x.state() for x in piece.left], [x.state() for x in piece.right]]).encode()


def _unpacked(data: bytes) -> _Piece:
    first, last, left, right = json.loads(data)
    first, last = bytes.fromhex(first), bytes.fromhex(last)
    spines = [[_Open(bytes.fromhex(x[0]), *x[1:]) for x in path] for path in (left, right)]
    for d in range(_shared(first, last) + 1):
        spines[1][d] = spines[0][d]
    return _Piece(first, last, *spines)


def _grow(tree_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, size, piece = _Rows(), [], 0, None

        def grown() -> _Piece:
            made = _grown(rows, out)
            return made if piece is None else _merged(piece, made, out)

        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                size += len(r["key"]) + 64
                if len(rows) >= tree_keys or size >= TREE_BYTES:
                    piece = grown()
                    rows, size = [], 0
                    yield from out.batches()
        if rows:
            piece = grown()
        yield from _with_piece(out, piece)

    return run


def _with_piece(out: _Rows, piece: _Piece | None) -> Iterator[pa.RecordBatch]:
    if piece is not None:
        out.rows.append((None, None, None, None, None, None, None, None, None, piece.first.hex(), _packed(piece)))
    yield from out.batches(all=True)


def _merge(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, piece = _Rows(), None
        for batch in batches:
            for data in batch["piece"].to_pylist():
                now = _unpacked(data)
                piece = now if piece is None else _merged(piece, now, out)
                yield from out.batches()
        if last and piece is not None:
            _closed(piece, out)
            piece = None
        yield from _with_piece(out, piece)

    return run


_SCHEMA = "digest string, conv_id long, depth long, parent string, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece binary"


def prefix_trie(conversations: DataFrame, tree_keys: int = TREE_KEYS, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of `turns()` or `rebuilt()` rows.

    A tree takes `tree_keys` keys, a merging task `fan` pieces; the result doesn't depend on either."""
    spark = conversations.sparkSession
    keys = staged(sequences(conversations), "sequences")
    size = keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    made = staged(over_arrow(keys.repartitionByRange(tasks, "key").sortWithinPartitions("key"), _grow(tree_keys), _SCHEMA), "trie")
    nodes, pieces = [made.filter("piece is null")], made.filter("piece is not null")
    while True:
        groups = -(-pieces.count() // fan)
        few = pieces.select(F.col("ends_sha256").alias("first"), "piece")  # first keys as hex, which sorts as they do
        dealt = few.repartition(1) if groups <= 1 else few.repartitionByRange(groups, "first")
        made = staged(over_arrow(dealt.sortWithinPartitions("first"), _merge(groups <= 1), _SCHEMA), "trie")
        nodes.append(made.filter("piece is null"))
        pieces = made.filter("piece is not null")
        if groups <= 1:
            break
    rows = nodes[0]
    for x in nodes[1:]:
        rows = rows.unionByName(x)
    spine = rows.filter("digest is not null").select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    met = rows.join(spine, "parent", "left")
    return met.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each begun with the first turns of another."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(staged(turns(table), "turns")))


OP12_SQL = r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list(id ORDER BY p) AS ids, list(w ORDER BY p) AS ws FROM o GROUP BY conv_id),
tab AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM tab),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1]::BIGINT)), 4294967295::BIGINT) % 4 AS h FROM t, crc),
b AS (SELECT t.conv_id, list_concat(coalesce(d.ids[1:h], []), t.ids[h + 1:]) AS ids, list_concat(coalesce(d.ws[1:h], []), t.ws[h + 1:]) AS ws
  FROM t JOIN h USING (conv_id) LEFT JOIN t d ON d.conv_id = t.conv_id - t.conv_id % 20),
m AS (SELECT conv_id, d, array_to_string(ids[1:d], '') AS k, CASE WHEN d = len(ids) THEN conv_id END AS ender, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(ender::VARCHAR, ',' ORDER BY ender), '')) AS ends FROM m GROUP BY k, d),
c AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND left(x.k, 32 * n.d) = n.k) AS kids FROM n),
a AS (SELECT k, d, unnest(range(d + 1)) AS up, kids, n, w FROM c),
s AS (SELECT left(k, 32 * up) AS k, up AS d, sum((kids = 0)::BIGINT) AS leaves, sum((n - 1) * w) AS saved FROM a GROUP BY ALL)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n::BIGINT AS n_convs, c.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM c JOIN s ON s.k = c.k AND s.d = c.d LEFT JOIN n p ON p.d = c.d - 1 AND p.k = left(c.k, 32 * p.d)
"""
