"""Vectorised text primitives over Arrow buffers, shared by the operators.

All work is done on slices of a batch of at most ``SLICE_ROWS`` rows whose text
is at most ``SLICE_BYTES`` (one longer text makes a slice of its own), so memory
follows the longest text and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SLICE_ROWS = 512

#: Bytes of words that white space (space, tab to carriage return) parts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
WORD_CHARS = np.zeros(256, bool)
WORD_CHARS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True

#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 11)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            ones = np.full(size, b, np.uint64)
            ones[0] = 1
            pair.append(np.cumprod(ones))
        have = (pair[0], pair[1])
        if size <= (4 << 20):
            _powers[base] = have
    return have


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of byte spans, and of its inverse, up to n."""
    return _power(_BASE, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + SLICE_ROWS)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte spans, the row of each, and each row's first word."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(rows) + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> Words:
    """Maximal runs of ``chars`` bytes that lie within one row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    inside = chars[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = offsets[(offsets > 0) & (offsets < n)]  # where another row begins
    opens[at] = inside[at]
    closes[at - 1] = inside[at - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes in any slice."""
    up, down = _power(_BASE, len(data))
    table = _BYTE if not seed else mix(_BYTE, seed)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64), seed)


def window_hashes(word: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each word on; fewer by length - 1."""
    n = len(word)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _power(_STEP, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word * up[:n], out=total[1:])
    return mix((total[length:] - total[: n - length + 1]) * down[: n - length + 1], seed + length)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """True for each word at which a window of its own row starts."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int64)
    count = np.diff(first)
    long = count >= length
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - length + 1, -1)
    return np.cumsum(ok)[:n] > 0


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """True for each of n words that a window at ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int | None = 0x20) -> np.ndarray:
    """Bytes of the spans one after another, parted by ``gap`` where one is given."""
    extra = 0 if gap is None else 1
    size = end - start + extra
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint8)
    ends = np.cumsum(size)
    index = np.arange(total) + np.repeat(start - (ends - size), size)
    if gap is None:
        return data[index]
    last = ends - 1
    index[last] = 0
    out = data[index]
    out[last] = gap
    return out


def cut(text: bytes, start: np.ndarray, removed: np.ndarray) -> bytes:
    """``text`` without its removed words and the white space up to the next kept one."""
    edge = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
    opens, closes = start[np.flatnonzero(edge == 1)], np.append(start, len(text))[np.flatnonzero(edge == -1)]
    out, at = [], 0
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    k = batch.schema.get_field_index(name)
    return batch.set_column(k, name, values)
