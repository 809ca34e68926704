"""Counting quotient filters over packed n-grams, as sorted blocks of bytes.

An n-gram of word ids is packed into one integer of ``n * width`` bits and sent
through an invertible permutation, so that its bits are spread evenly.  The
first bits of the result are the quotient, all others the remainder: nothing is
hashed away, so counts are exact and the n-grams can be read back.  A filter
holds, in the order of quotient and remainder,

* the runs: for each quotient a 0 bit for each of its entries, then a 1 bit;
* the remainders, in as few whole bytes as they need;
* the counts less one, a byte each, and those above 254 in a list of their own.

A filter covers a range of quotients.  Filters of one range, from different
shards, are merged by their order; adding up equal entries loses nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64


class Layout(NamedTuple):
    """How n-grams of ``n`` words with ids of ``width`` bits (at most 32) are split."""
    n: int
    width: int
    quotient: int

    @property
    def remainder(self) -> int:
        return self.n * self.width - self.quotient


def layout(n: int, vocabulary: int, ranges: int) -> Layout:
    """Ids 1 to ``vocabulary``; quotients of at least 16 bits (or all) and enough for
    ``ranges`` ranges.  N-grams of more than 64 bits have remainders of 64."""
    width = max(8, int(vocabulary).bit_length())
    if width > 32:
        raise ValueError("word ids of more than 32 bits")
    wanted = max(16, (ranges - 1).bit_length())
    if n * width > 64:
        width = max(width, -(-(64 + wanted) // n))
        return Layout(n, width, n * width - 64)
    return Layout(n, width, min(n * width, wanted))


def _mask(bits: int) -> U:
    return U((1 << bits) - 1)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function (not inverted, so any will do)."""
    x = (x + U(key)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def split(ids: list[np.ndarray], to: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(quotients, remainders) of n-grams given by one array of ids for each place."""
    low = np.zeros(len(ids[0]), U)
    for part in ids:  # modulo 2^64
        low = (low << U(to.width)) | part.astype(U)
    if to.n * to.width <= 64:
        x, y = (low >> U(to.remainder)) if to.remainder < 64 else np.zeros_like(low), low & _mask(to.remainder)
    else:
        # The remainder has 64 bits, so the quotient is the head of the first id.
        x, y = ids[0].astype(U) >> U(64 - (to.n - 1) * to.width), low
    x ^= _mix(y, 1) & _mask(to.quotient)
    y = (y + _mix(x, 2)) & _mask(to.remainder)
    x ^= _mix(y, 3) & _mask(to.quotient)
    return x, y


def join(x: np.ndarray, y: np.ndarray, to: Layout) -> list[np.ndarray]:
    """The ids again: the steps of ``split`` backwards."""
    x = x ^ (_mix(y, 3) & _mask(to.quotient))
    y = (y - _mix(x, 2)) & _mask(to.remainder)
    x = x ^ (_mix(y, 1) & _mask(to.quotient))
    ids = []
    if to.n * to.width <= 64:
        low = ((x << U(to.remainder)) if to.remainder < 64 else np.zeros_like(x)) | y
        for _ in range(to.n):
            ids.append(low & _mask(to.width))
            low = low >> U(to.width) if to.width < 64 else np.zeros_like(low)
    else:
        low = y
        for _ in range(to.n - 1):
            ids.append(low & _mask(to.width))
            low = low >> U(to.width)
        used = 64 - (to.n - 1) * to.width  # bits of the first id within the remainder
        ids.append((x << U(used)) | (low & _mask(used)))
    return ids[::-1]


def count(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (quotient, remainder), equal entries added up."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(first, append=len(x))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return x[first], y[first], total.astype(np.int64)


def write(x: np.ndarray, y: np.ndarray, counts: np.ndarray, start: int, end: int, to: Layout) -> bytes:
    """A filter of sorted entries whose quotients are in [start, end)."""
    runs = np.bincount((x - U(start)).astype(np.int64), minlength=end - start)
    bits = np.zeros(len(x) + end - start, np.uint8)
    bits[np.cumsum(runs) + np.arange(end - start)] = 1
    each = (to.remainder + 7) // 8
    remainders = np.ascontiguousarray(y.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :each]
    large = np.flatnonzero(counts > 255)
    small = np.minimum(counts - 1, 255).astype(np.uint8)
    head = np.array([len(x), start, end, len(large)], "<i8")
    return b"".join((head.tobytes(), np.packbits(bits).tobytes(), remainders.tobytes(), small.tobytes(),
                     large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes()))


def read(data: bytes, to: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quotients, remainders, counts) of a filter, sorted."""
    size, start, end, n_large = np.frombuffer(data, "<i8", 4).tolist()
    at = 32

    def take(n, kind="u1"):
        nonlocal at
        part = np.frombuffer(data, kind, n, at)
        at += part.nbytes
        return part
    n_bits = size + end - start
    bits = np.unpackbits(take((n_bits + 7) // 8), count=n_bits)
    x = np.cumsum(bits, dtype=np.int64)[bits == 0].astype(U) + U(start)
    each = (to.remainder + 7) // 8
    wide = np.zeros((size, 8), np.uint8)
    wide[:, :each] = take(size * each).reshape(size, each)
    y = wide.view("<u8").reshape(size).astype(U)
    counts = take(size).astype(np.int64) + 1
    large = take(n_large, "<i8")
    counts[large] = take(n_large, "<i8")
    return x, y, counts


def write_ranges(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ranges: int, to: Layout):
    """(range, filter) for each non-empty one of ``ranges`` equal ranges of quotients (a power of two)."""
    width = (1 << to.quotient) // ranges
    cuts = np.searchsorted(x // U(width), np.arange(ranges + 1, dtype=U)) if ranges > 1 else np.array([0, len(x)])
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[r], cuts[r + 1]
        yield r, write(x[a:b], y[a:b], counts[a:b], r * width, (r + 1) * width, to)


def merge(filters: list[bytes], to: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of filters of one range, added up."""
    parts = [read(f, to) for f in filters]
    return count(*(np.concatenate(c) for c in zip(*parts)))
