"""WARC archives of pages: written by tasks, and read back in pieces by a verified chain of record boundaries.

Writing: each task writes its rows to archives of its own, one WARC/1.1 record a page after a warcinfo record: a `response`
with the HTTP header and the payload, or, where an earlier page has an equal payload of at least `least` bytes, a `revisit` with
the header alone that refers to it. Payloads are told apart by their SHA-1 and length. Of pages with equal payloads those of the
smallest id are responses; a null id is the greatest. Only ids and digests travel to find them. A task that is run again
writes names of its own; only archives in the returned table count.

Reading: an archive is cut into pieces of bytes. The tasks look for `WARC/1.` in their pieces; where a well-formed header follows,
that is a candidate, and its length gives its successor. Payloads may hold whole records, so candidates prove nothing. Each piece
leads its candidates to the first successor beyond it; these leaps from piece to piece, from byte 0 on, are joined with themselves
(pointer jumping), so that after about log2(pieces) joins it is known which candidates the chain from the file's start
reaches. A chain that doesn't end where its file does is an error. Then each reached piece is parsed from its first record on.

Ids and URLs are written with bytes outside printable ASCII, spaces and `%<>` percent-encoded, so no value can break a header. Null
html is an empty payload, a null url has no header line, a null id is `urn:page:`. An empty table writes no archive. Other
columns are not read. A record is held in memory while it is written or read, nothing longer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_arrow, shared_dir, staged

#: Bytes of an archive, of a piece of one, and of one read; revisits up to which they are sent to every task (16 bytes each).
FILE_BYTES, PIECE_BYTES, READ_BYTES, BROADCAST_ROWS = 256 << 20, 16 << 20, 1 << 20, 200_000
MAGIC, DATE = b"WARC/1.", "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = re.compile(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+:[^\r\n]*")
_BEGUN = re.compile(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]*(:[^\r\n]*)?\r?")
_KINDS = frozenset((b"warcinfo", b"response", b"resource", b"request", b"metadata", b"revisit", b"conversion", b"continuation"))


def _escaped(value: str) -> str:
    return quote(value, safe="!#$&'()*+,/:;=?@[]-._~")


def record(kind: str, id: str, headers: list[tuple[str, str]], block: bytes, content: str) -> bytes:
    """The bytes of one record."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{id}>"), *headers, ("Content-Type", content), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _sha1(html: str) -> Column:
    return F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8"))


def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of pages whose payload, of at least `least` bytes, a page of a smaller id has too."""
    digests = pages.select(F.col(page_id).cast("long").alias("page_id"), _sha1(html).alias("sha1"), F.octet_length(F.coalesce(html, F.lit(""))).alias("size"))
    digests = staged(digests.filter(F.col("size") >= least), "digests")
    first = digests.groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return digests.join(first, ["sha1", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, name, at, n = None, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": [at], "records": [n]})

        for batch in batches:
            for page, url, html, refers, again in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None:
                    name, n = f"pages-{uuid.uuid4().hex}.warc", 0
                    out = store.open_output_stream(f"{root}/{name}", buffer_size=READ_BYTES)
                    info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Date", date), ("WARC-Filename", name)], b"format: WARC File Format 1.1\r\n", "application/warc-fields")
                    out.write(info)
                    at = len(info)
                payload = (html or "").encode()
                digest = "sha1:" + base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = [("WARC-Date", date), *([("WARC-Target-URI", _escaped(url))] if url is not None else []), ("WARC-Payload-Digest", digest)]
                if again:
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{page_urn(refers)}>")]
                data = record("revisit" if again else "response", page_urn(page), fields, head if again else head + payload, "application/http; msgtype=response")
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages to archives in `folder`, and returns their table: file, bytes, records. html doesn't travel where revisits are few, else once, by its id."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    again = staged(revisits(pages, page_id, html, least), "revisits").withColumnRenamed("page_id", "__again")
    few = again.count() <= BROADCAST_ROWS
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    same = F.col("page_id").eqNullSafe(F.col("__again")) & (_sha1("html") == F.col("sha1"))  # rows of one id may differ
    met = rows.join(F.broadcast(again) if few else again, same, "left")
    out = met.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return staged(over_arrow(out, _writer(folder, date, file_bytes), "file string, bytes long, records long"), "archives")


def _head(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """The fields of the header at `at` and where its block begins; None if that is no header. Raises IndexError where the data end first."""
    end = data.find(b"\r\n", at)
    if end < 0:
        if len(data) - at > 16:
            return None
        raise IndexError
    if not re.fullmatch(rb"WARC/1\.[01]", data[at:end]):
        return None
    fields: dict[bytes, bytes] = {}
    while True:
        at = end + 2
        end = data.find(b"\r\n", at)
        line = data[at:] if end < 0 else data[at:end]
        if end >= 0 and not line:
            break
        if not (_LINE if end >= 0 else _BEGUN).fullmatch(line):
            return None
        if end < 0:
            raise IndexError
        name, _, value = line.partition(b":")
        fields[name.lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit() or fields.get(b"warc-type") not in _KINDS or b"warc-record-id" not in fields:
        return None
    return fields, end + 2


def _candidates(source, size: int, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, successor) of each well-formed header that begins within [start, end)."""
    out, base, data = [], start, b""
    while base < end:
        source.seek(base)
        data = source.read(min(READ_BYTES, size - base))
        at = data.find(MAGIC)
        while at >= 0 and base + at < end:
            try:
                found = _head(data, at)
            except IndexError:
                if base + len(data) < size:  # the header goes on beyond what is read
                    data += source.read(max(READ_BYTES, len(data)))
                    continue
                found = None
            if found:
                follow = base + found[1] + int(found[0][b"content-length"]) + 4
                if follow <= size:
                    out.append((base + at, follow))
            at = data.find(MAGIC, at + 1)
        if base + len(data) >= size:
            break
        base += len(data) - len(MAGIC) + 1
    return sorted(set(out))


def _scan(folder: str, piece_bytes: int):
    schema = pa.schema([("file", pa.string()), ("piece", pa.int64()), ("at", pa.int64()), ("leap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                end = min(r["bytes"], r["piece"] + piece_bytes)
                with store.open_input_file(f"{root}/{r['file']}") as source:
                    found = _candidates(source, r["bytes"], r["piece"], end)
                leap: dict[int, int | None] = {}
                for at, follow in reversed(found):  # the first place beyond the piece that the chain from here comes to
                    leap[at] = follow if follow >= end else leap.get(follow)
                rows = [(r["file"], r["piece"], at, leap[at]) for at, _ in found if leap[at] is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def verified(files: DataFrame, folder: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(file, piece, at): of each piece that the chain from its file's start reaches, the first record. An error where a chain breaks."""
    pieces = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(piece_bytes).cast("long"))).alias("piece"))
    most = files.agg(F.max(F.ceil(F.col("bytes") / piece_bytes))).first()[0] or 1
    found = staged(over_arrow(pieces.repartition(max(1, pieces.count()), "file", "piece"), _scan(folder, piece_bytes), "file string, piece long, at long, leap long"), "candidates")
    # only candidates that some leap comes to, or the first, can be a piece's entry
    entries = found.select("file", F.col("leap").alias("at")).distinct()
    jump = staged(found.filter("at > 0").join(entries, ["file", "at"], "left_semi").unionByName(found.filter("at = 0")).select("file", "at", "leap"), "jump")
    reached, step = files.select("file", F.lit(0).cast("long").alias("at")), 1
    while True:
        further = reached.join(jump, ["file", "at"]).select("file", F.col("leap").alias("at"))
        reached = staged(reached.unionByName(further).distinct(), "reached")
        step *= 2
        if step > most:  # jumps of 1, 2, 4 ... pieces: any number of up to step - 1 is a sum of them
            break
        two = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.leap") == F.col("b.at")))
        jump = staged(two.select("a.file", "a.at", "b.leap"), "jump")
    broken = files.select("file", F.col("bytes").alias("at")).join(reached, ["file", "at"], "left_anti")
    if names := [r["file"] for r in broken.limit(3).collect()]:
        raise ValueError(f"the chain of records doesn't end with its file: {names}")
    return found.join(reached, ["file", "at"], "left_semi").select("file", "piece", "at")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _number(urn: bytes | None) -> int | None:
    text = (urn or b"").strip(b"<>").rpartition(b":")[2]
    return int(text) if text else None


class _Stream:
    """Bytes of a file from a place on, read some at a time."""

    def __init__(self, source, at: int):
        self.source, self.at, self.data = source, at, b""
        source.seek(at)

    def head(self) -> dict[bytes, bytes]:
        while True:
            try:
                found = _head(self.data, 0) if self.data else None
                if found:
                    fields, end = found
                    self.data, self.at = self.data[end:], self.at + end
                    return fields
                if self.data:
                    raise ValueError(f"no record at byte {self.at}")
            except IndexError:
                pass
            more = self.source.read(max(READ_BYTES, len(self.data)))
            if not more:
                raise ValueError(f"the archive ends within the header at byte {self.at}")
            self.data += more

    def take(self, n: int) -> bytes:
        if len(self.data) < n:
            self.data += self.source.read(max(READ_BYTES, n - len(self.data)))
        out, self.data, self.at = self.data[:n], self.data[n:], self.at + n
        if len(out) < n:
            raise ValueError(f"the archive ends within the record before byte {self.at}")
        return out


def _parse(folder: str, payloads: bool, piece_bytes: int):
    def rows(stream: _Stream, end: int) -> Iterator[tuple]:
        while stream.at < end:
            fields = stream.head()
            block = stream.take(int(fields[b"content-length"]))
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError(f"no end of record before byte {stream.at}")
            kind = fields[b"warc-type"].decode()
            if kind not in ("response", "revisit"):
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            length = int(re.search(rb"(?mi)^Content-Length: *(\d+)", head)[1])
            digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
            if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != digest):
                raise ValueError(f"the payload before byte {stream.at} is damaged")
            url = fields.get(b"warc-target-uri")
            yield _number(fields[b"warc-record-id"]), kind, _number(fields.get(b"warc-refers-to")), url and unquote(url.decode()), length, digest, payload if payloads and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, piece, at in zip(*(batch[c].to_pylist() for c in ("file", "piece", "at")), strict=True):
                with store.open_input_file(f"{root}/{file}") as source:
                    held, size = [], 0
                    for row in rows(_Stream(source, at), min(source.size(), piece + piece_bytes)):
                        held.append(row)
                        size += len(row[-1] or b"")
                        if len(held) == 512 or size >= READ_BYTES:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_warc(files: DataFrame, folder: str, payloads: bool = True, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload) of the responses and revisits of archives (file, bytes).

    A revisit's length and digest are those of the payload that it refers to; its own payload is null. Payloads are checked against their digests."""
    found = staged(verified(files, folder, piece_bytes), "entries")
    return over_arrow(found.repartition(max(1, found.count()), "file", "piece"), _parse(folder, payloads, piece_bytes), "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary")


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Per page, from the archives read back: payload_bytes, payload_digest, record_type, refers_to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(pages, folder), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS s, array_to_string(list_transform(range(1, 41), lambda k: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(sha1(html), k, 1)) - 1) + 1, 4)), '') AS b FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s, n) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
