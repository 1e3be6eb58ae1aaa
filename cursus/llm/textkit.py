"""Vectorised words, lines and hashes over the UTF-8 bytes of a batch of texts.

A batch is one byte array and the offsets of its texts (a null text is empty).
Words are maximal runs of bytes outside a separator set; by default the set is
blank, tab, line feed, vertical tab, form feed and carriage return, so words
are the matches of ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit and depend on
content alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import process_cache

U = np.uint64
_M1, _M2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE, _JOIN = 0x5851F42D4C957F2D, U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def _bytes_table(of: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(of)] = True
    return t


SPACE = _bytes_table(b" \t\n\x0b\x0c\r")
#: Everything but ASCII letters, digits and the bytes of other characters.
PUNCTUATION = ~_bytes_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
CONTINUATION = _bytes_table(bytes(range(0x80, 0xC0)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, cut at the texts' offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Words:
    """Words of a batch: byte starts and ends, and ``first``, the number of words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = runs(~separators[data], offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return PrefixHash(self.data)(self.starts, self.ends)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial base and of its inverse, n at least."""
    cache = process_cache("powers")
    if len(cache.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.empty(size, U)
            p[0], have = 1, 1
            while have < size:
                more = min(have, size - have)
                p[have:have + more] = p[:more] * U(pow(base, have, 1 << 64))
                have += more
            cache[name] = p
    return cache["up"], cache["down"]


class PrefixHash:
    """Hashes of any byte ranges of one array, from the prefix sums of a polynomial modulo 2**64 over random byte codes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        terms = _BYTE[data]
        terms *= up[:len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends]
        h -= self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(U) * _STEP
        return mix(h)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, and the number of windows before each text."""
    counts = np.diff(first)
    windows = np.maximum(counts - n + 1, 0)
    before = np.zeros(len(first), np.int64)
    np.cumsum(windows, out=before[1:])
    total = len(hashes) - n + 1
    if total <= 0 or not before[-1]:
        return np.zeros(0, U), before
    h = hashes[:total].copy()
    for k in range(1, n):
        h *= _JOIN
        h += hashes[k:total + k]
    valid = np.ones(total, bool)
    # windows that start in the last n - 1 words of a text would reach into the next
    for k in range(1, n):
        at = first[1:] - k
        at = at[(at >= first[:-1]) & (at < total)]
        valid[at] = False
    return mix(h[valid]), before


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it stand twice or more in its group; and does it stand earlier there."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    mixed = mix(keys + group.astype(U) * _STEP)
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] = same
    twice = again.copy()
    twice[:-1] |= same
    out_twice, out_again = np.empty(len(s), bool), np.empty(len(s), bool)
    out_twice[order], out_again[order] = twice, again
    return out_twice, out_again


class Lines:
    """Lines between line feeds: byte starts and ends, and ``first``, the number of lines before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        feeds = np.flatnonzero(data == 10)
        n = len(offsets) - 1
        of = np.searchsorted(offsets, feeds, side="right") - 1
        self.counts = np.bincount(of, minlength=n) + 1
        self.first = np.zeros(n + 1, np.int64)
        np.cumsum(self.counts, out=self.first[1:])
        self.starts = np.empty(self.first[-1], np.int64)
        self.ends = np.empty(self.first[-1], np.int64)
        begins = self.first[:-1]
        is_first = np.zeros(self.first[-1], bool)
        is_first[begins] = True
        is_last = np.zeros(self.first[-1], bool)
        is_last[self.first[1:] - 1] = True
        self.starts[is_first], self.starts[~is_first] = offsets[:-1], feeds + 1
        self.ends[is_last], self.ends[~is_last] = offsets[1:], feeds
        self.text = np.repeat(np.arange(n), self.counts)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each size, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(before - starts, sizes)


def lists(column: np.ndarray, first: np.ndarray, value: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(column).cast(value))
