"""Words, hashes and shingles of UTF-8 texts, computed with numpy on whole Arrow batches.

Every function here works on the bytes of one batch; Spark decides which rows are in it. Hashes are
deterministic 64-bit values (fixed seed), equal on every executor and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_CHUNK_BITS = 18
_CHUNK = 1 << _CHUNK_BITS
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads the bits of each value over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _M64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any span of a byte string, modulo 2**64.

    The hash of bytes[i:j] is a function of those bytes alone, wherever they stand. Prefix sums are
    made _CHUNK bytes at a time, so that the tables of powers stay small however long a text is.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASE, values: np.ndarray = BYTE_VALUES):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        if base not in self._tables:
            self._tables[base] = (_powers(base, _CHUNK), _powers(self.inverse, _CHUNK))
        power, self._back = self._tables[base]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for at in range(0, len(data), _CHUNK):
            part = values[data[at : at + _CHUNK]]
            part *= power[: len(part)]
            if at:
                part *= U64(pow(base, at, 1 << 64))
            np.cumsum(part, out=self.sums[at + 1 : at + 1 + len(part)])
            self.sums[at + 1 : at + 1 + len(part)] += self.sums[at]
        blocks = len(data) // _CHUNK + 1
        self._far = np.array([pow(self.inverse, at * _CHUNK, 1 << 64) for at in range(blocks)], np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= self._back[start & (_CHUNK - 1)]
        if len(self._far) > 1:
            out *= self._far[start >> _CHUNK_BITS]
        return out

    def windows(self, width: int) -> np.ndarray:
        """The hash of each span of `width` bytes, by its start."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.sums[width:] - self.sums[:-width]
        for at in range(0, n, _CHUNK):
            out[at : at + _CHUNK] *= self._back[: min(_CHUNK, n - at)]
            if at:
                out[at : at + _CHUNK] *= self._far[at >> _CHUNK_BITS]
        return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and where each begins (one more offset ends the last). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for bytes in none of the inclusive ranges."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: A-Z to a-z, all else as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Word bytes of benchmark matching: digits, letters after folding, and all non-ASCII.
ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Word bytes of shingles: all but ASCII white space.
NOT_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes within a text, and the first word of each text (one more ends the last)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Rolling(data).spans(start, end) + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each `width` consecutive words of a text; fewer words, but some, make one shingle of all. With the first of each text."""
    number = np.diff(first)
    many = np.where(number >= width, number - width + 1, np.minimum(number, 1))
    at = np.concatenate(([0], np.cumsum(many)))
    text = np.repeat(np.arange(len(number)), many)
    start = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    length = np.minimum(number, width)[text]
    out = np.zeros(at[-1], np.uint64)
    for k in range(width):
        inside = length > k
        if inside.all():
            out = mix(out * U64(BASE) + words[start + k])
        else:
            out[inside] = mix(out[inside] * U64(BASE) + words[start[inside] + k])
    return out + length.astype(np.uint64), at


def several(values: np.ndarray) -> np.ndarray:
    """Of sorted values: which have an equal one beside them."""
    same = values[1:] == values[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(values) else np.zeros(0, bool)
