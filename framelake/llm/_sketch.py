"""Parity sketches: bitmaps that bound how far apart two sets are.

A set of n hashes has a bitmap of the power of two of bits next above n (64 at
least, ``MOST_BITS`` at most); a bit tells whether an odd number of its hashes
end in the bit's number. The exclusive or of two bitmaps is the bitmap of the
sets' symmetric difference, so its ones are no more than the elements in it.
Halves of a bitmap combine by exclusive or to the bitmap of half the size,
which is how sets of unlike sizes are compared. The bound never loses a pair.
"""

from __future__ import annotations

import numpy as np

LEAST_BITS, MOST_BITS = 64, 1 << 16
_STEP = 1 << 18


def sketches(found: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bitmap of each row's distinct hashes."""
    size = np.diff(bounds)
    bits = np.full(len(size), LEAST_BITS, np.int64)
    while (short := (bits < size) & (bits < MOST_BITS)).any():
        bits[short] *= 2
    base = np.concatenate(([0], np.cumsum(bits)))
    at = np.repeat(base[:-1], size) + (found & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(base[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def apart(first: list[bytes], second: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference of the pairs first[left], second[right]."""
    out = np.zeros(len(left), np.int64)
    size = [np.fromiter(map(len, x), np.int64, len(x)) // 8 for x in (first, second)]
    flat = [np.frombuffer(b"".join(x), np.uint64) for x in (first, second)]
    start = [np.concatenate(([0], np.cumsum(x)))[:-1] for x in size]
    pair = size[0][left] * (MOST_BITS + 1) + size[1][right]
    order = np.argsort(pair, kind="stable")
    cuts = np.flatnonzero(np.diff(pair[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        widths = [int(size[0][left[own[0]]]), int(size[1][right[own[0]]])]
        step = max(1, _STEP // max(widths))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            maps = []
            for k, index in ((0, left[part]), (1, right[part])):
                one = flat[k][start[k][index][:, None] + np.arange(widths[k])]
                while one.shape[1] > min(widths):
                    half = one.shape[1] // 2
                    one = one[:, :half] ^ one[:, half:]
                maps.append(one)
            out[part] = np.bitwise_count(maps[0] ^ maps[1]).sum(axis=1)
    return out
