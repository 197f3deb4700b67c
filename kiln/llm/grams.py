"""Word and window hashing over Arrow text batches, vectorised with numpy.

A batch's texts are one byte buffer with row offsets.  Words are byte runs
between separators (all separators of the word contracts are ASCII, so UTF-8
sequences stay whole).  A word's hash multiplies each byte's code by a number
drawn for its place, a long word's is xxh3.  A span's hash is a difference of
prefix sums, so any span costs O(1).  ``Spans.hash``, which stands for the
span's content, is a polynomial modulo the prime 2^61 - 1: modulo 2^64 every
base gives equal values on some structured sequences (Thue-Morse).
``Spans.rolling`` and ``hash64`` are modulo 2^64, for grams of a few symbols
and for second opinions.  Everything here is bounded by one chunk of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

U = np.uint64
CHUNK_BYTES = 1 << 20
_ODD = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_ODD_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * _ODD)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# separators of the benchmark contract: everything in ASCII but 0-9 and a-z
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps, dtype=U)
    return have[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if not pa.types.is_binary(column.type) else b"", column.type))
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pack_texts(batches):
    """``mapInArrow`` function: the last column, a text, compressed row by
    row, so that texts that shuffle take less than half the space."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offs = text_buffer(batch.column(batch.num_columns - 1))
        raw = memoryview(data)
        body = pa.array([squeeze(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], body], names=batch.schema.names)


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, plain or packed."""
    if not pa.types.is_binary(column.type):
        return text_buffer(column)
    expand = zstandard.ZstdDecompressor().decompress
    texts = [expand(x) for x in column.to_pylist()]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offs


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (a longer text is one range)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray):
    """(starts, ends, word offsets per row) of the words of a chunk."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    first = offs[:-1]
    prev[first[first < n]] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    last = offs[1:]
    nxt[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


LONG_WORD = 512
# a number for each place in a word: no algebra connects the places
_PLACE = mix(np.arange(1, LONG_WORD + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; long texts go through in slices."""
    out = np.empty(len(starts), U)
    lens = ends - starts
    upto = np.concatenate([[0], np.cumsum(np.minimum(lens, LONG_WORD))])
    for lo, hi in chunks(upto):
        ln = np.diff(upto[lo:hi + 1])
        first = upto[lo:hi] - upto[lo]
        pos = np.arange(upto[hi] - upto[lo]) - np.repeat(first, ln)
        v = BYTE_CODE[data[pos + np.repeat(starts[lo:hi], ln)]] * _PLACE[pos]
        out[lo:hi] = np.add.reduceat(v, first) + ln.astype(U)
    for i in np.flatnonzero(lens > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]])
    return mix(out)


P61 = U((1 << 61) - 1)
_BASE = 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_M30, _M31 = U((1 << 30) - 1), U((1 << 31) - 1)


def reduce61(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo 2^61 - 1."""
    x = (x & P61) + (x >> U(61))
    return np.where(x >= P61, x - P61, x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reduced numbers modulo 2^61 - 1, from 31-bit halves."""
    a1, a0, b1, b0 = a >> U(31), a & _M31, b >> U(31), b & _M31
    mid = a1 * b0 + a0 * b1
    return reduce61((a1 * b1 << U(1)) + (mid >> U(30)) + ((mid & _M30) << U(31)) + a0 * b0)


def _powers61(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.ones(1, U)
        while len(have) < max(n, 1 << 12):
            step = np.array([pow(base, len(have), int(P61))], U)
            have = np.concatenate([have, mul61(have, step)])
        _POWERS[name] = have
    return have[:n]


class Spans:
    """Hashes of spans of a symbol sequence (prefix sums, made when asked for)."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self._sums = self._prime = None

    def _wrapping(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.symbols)
        if self._sums is None:
            self._sums = np.zeros(n + 1, U)
            np.cumsum(self.symbols * _powers("inv", _ODD_INV, n + 1)[:n], dtype=U, out=self._sums[1:])
        return self._sums, _powers("odd", _ODD, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Stands for the content of each span."""
        n = len(self.symbols)
        if self._prime is None:
            inverse = _powers61("inv61", pow(_BASE, -1, int(P61)), n + 1)
            value = mul61(reduce61(self.symbols), inverse[:n])
            self._prime = [np.concatenate([np.zeros(1, U), np.cumsum(part, dtype=U)])
                           for part in (value & _M31, value >> U(31))]
        low, high = (reduce61(part[end] - part[start]) for part in self._prime)
        total = reduce61(low + (((high << U(31)) & P61) | (high >> U(30))))
        return mix(mul61(total, _powers61("pow61", _BASE, n + 1)[start]) + (end - start).astype(U) * _ODD)

    def hash64(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second hash, of another kind: not to be trusted alone."""
        sums, power = self._wrapping()
        return mix((sums[end] - sums[start]) * power[start] + (end - start).astype(U))

    def rolling(self, k: int) -> np.ndarray:
        """Hash of every k consecutive symbols (none when there are fewer)."""
        n = len(self.symbols)
        if n < k:
            return np.zeros(0, U)
        sums, power = self._wrapping()
        return mix((sums[k:] - sums[:n - k + 1]) * power[:n - k + 1] + U(k))


def content_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxh3 of the bytes of each slice of an array."""
    raw, size = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in
                     zip((start * size).tolist(), (end * size).tolist())], U)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For every window of ``w`` consecutive values the position of its
    smallest (the rightmost of equal ones), from block prefix and suffix
    minima.  Values are compared by their upper 32 bits."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    last = U(0xFFFFFFFF)
    keyed = np.full(-(-n // w) * w, ~U(0), U)
    keyed[:n] = (values & ~last) | (last - np.arange(n, dtype=U))
    blocks = keyed.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(after[:n - w + 1], before[w - 1:n])
    return (last - (best & last)).astype(np.int64)


def row_lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list column from per-row counts and the flat values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U else x.astype(np.int64)
