"""Runs: maximal stretches of words that repeat with a period, and texts collapsed to one period of each.

A run is a stretch with smallest period q and at least max(LEAST, 2 * q) words
that no neighbouring word extends. Where it starts at s, the suffixes at s and
at s + q share length - q words, no more, and the words before them differ: a
maximal pair whose distance q is at most its length. So runs are read off
maximal pairs, and nothing is extended.

The pairs come from the tree of LCP intervals, bottom up: suffixes of a text are
sorted (by doubling), and neighbouring intervals merge in falling order of the
words they share. An interval holds the positions of its suffixes in order,
each classed by its left word; the smaller list goes into the larger one. A
pair across the two, of different left words and at a distance of at most the
shared length, is a run, or a run at a multiple of its period; of pairs with the
same start and end the least distance counts. Only neighbours in the merged list
need be paired: were there another occurrence between s and s + q, the stretch
would have a smaller period (Fine and Wilf). As half of a run lies within a
pair, only suffixes that share LEAST / 2 words are merged at all, and a text
that repeats no such passage has no run.

Cases: null and empty texts have no words and no runs; a text without runs
collapses to its words; repeated rows and null ids are rows of their own; very
long texts are a step of their own; other columns are ignored; an empty table
gives no rows. Of the runs of a text the longest is reported, then the first,
then that of the smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkit
from .shared import map_chunks

LEAST = 12  # words of a run

#: (doc_id, number of words) -> the word that stands at each place, or None for the text as it is.
Order = Callable[[int | None, int], np.ndarray | None]


def _ranks(ids: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4 ... words within their text, until all differ."""
    n = len(ids)
    end = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    last = end[np.searchsorted(end, np.arange(n))]
    # equal words of two texts are different words
    _, rank = np.unique(text.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True)
    ranks, k = [rank.astype(np.int32)], 1
    while True:
        now = ranks[-1].astype(np.int64)
        onward = np.zeros(n, np.int64)
        at = np.arange(n) + k
        inside = at <= last
        onward[inside] = now[at[inside]] + 1
        _, rank = np.unique(now * (n + 1) + onward, return_inverse=True)
        if rank.max() == now.max():
            return ranks
        ranks.append(rank.astype(np.int32))
        k *= 2


def _shared(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share."""
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()
    for level in range(len(ranks) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[fits] = ranks[level][a[fits]] == ranks[level][b[fits]]
        # ranks tell suffixes apart by their ends, too: equal ones share all 2**level words
        step = same * (1 << level)
        a, b, length = a + step, b + step, length + step
    return length


def maximal_pairs(ids: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, distance and shared length of the maximal pairs that are runs or runs at a multiple of their period.

    ``ids`` are words, ``text`` the text that each stands in, without gaps in between.
    """
    ranks = _ranks(ids, text)
    order = np.argsort(ranks[-1], kind="stable").astype(np.int64)
    lcp = _shared(ranks, order[:-1], order[1:])
    del ranks
    # a pair of length q + shared >= least and q <= shared shares half of it
    joins = np.flatnonzero(lcp >= (least + 1) // 2)
    joins = joins[np.argsort(-lcp[joins], kind="stable")]
    left = np.full(len(ids), -1, np.int64)
    left[1:] = np.where(text[1:] == text[:-1], ids[:-1], -1 - np.arange(1, len(ids)))
    left = left.tolist()
    # an interval of suffixes is known at its two ends
    lists: dict[int, list[int]] = {}
    other_end = {}
    start, distance, length = [], [], []
    order, lcp = order.tolist(), lcp.tolist()
    for k in joins.tolist():
        shared = lcp[k]
        lo, hi = other_end.pop(k, k), other_end.pop(k + 1, k + 1)
        a = lists.pop(lo, None) or [order[k]]
        b = lists.pop(k + 1, None) or [order[k + 1]]
        if len(a) < len(b):
            a, b = b, a
        for i in b:
            at = bisect_left(a, i)
            if at < len(a):
                q = a[at] - i
                if q <= shared and left[i] != left[a[at]]:
                    start.append(i)
                    distance.append(q)
                    length.append(shared)
            if at:
                j = a[at - 1]
                q = i - j
                if q <= shared and left[i] != left[j]:
                    start.append(j)
                    distance.append(q)
                    length.append(shared)
        if len(b) == 1:
            a.insert(bisect_left(a, b[0]), b[0])
        else:
            a += b
            a.sort()
        lists[lo] = a
        other_end[lo], other_end[hi] = hi, lo
    start, distance, length = (np.array(x, np.int64) for x in (start, distance, length))
    long = distance + length >= least
    return start[long], distance[long], length[long]


def _smallest(start: np.ndarray, distance: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs, by start and period: of pairs with one start and end, the least distance."""
    end = start + distance + length
    order = np.lexsort((distance, end, start))
    start, end, distance = start[order], end[order], distance[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, distance = start[first], end[first], distance[first]
    order = np.lexsort((distance, start))
    return start[order], (end - start)[order], distance[order]


class _Batch:
    """Words of a batch of texts in the order they are read in, as numbers of distinct words."""

    def __init__(self, ids: pa.Array, column: pa.Array, order: Order | None):
        data, offsets = textkit.utf8(column)
        words = textkit.Words(data, offsets)
        self.counts, self.first = words.counts, words.first
        self.moved = {}
        if order:
            for k, (i, n) in enumerate(zip(ids.to_pylist(), self.counts.tolist())):
                to = order(i, n)
                if to is not None:
                    self.moved[k] = to
        sizes = words.ends - words.starts
        flat = data[textkit.ranges(words.starts, sizes)]
        before = np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes),
                                                      [None, pa.py_buffer(before), pa.py_buffer(np.ascontiguousarray(flat))])
        self.place = np.arange(len(sizes))
        for k, to in self.moved.items():
            self.place[self.first[k]:self.first[k + 1]] = self.first[k] + to
        self.text = words.text
        self.hashes = words.hashes()[self.place]

    def suspects(self, passage: int) -> np.ndarray:
        """Texts that hold some passage of so many words twice."""
        windows, before = textkit.shingles(self.hashes, self.first, passage)
        twice, _ = textkit.repeated(windows, np.repeat(np.arange(len(self.counts)), np.diff(before)))
        return np.flatnonzero(textkit.sums(twice, before) > 0)

    def runs(self, least: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        texts = self.suspects((least + 1) // 2)
        if not len(texts):
            return {}
        rows = textkit.ranges(self.first[texts], self.counts[texts])
        ids = pc.dictionary_encode(self.words.take(pa.array(self.place[rows]))).indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(texts)), self.counts[texts])
        start, length, period = _smallest(*maximal_pairs(ids, text, least))
        begin = np.append(0, np.cumsum(self.counts[texts]))
        of = np.searchsorted(begin, start, side="right") - 1
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        return {int(t): (start[a:b] - begin[k], length[a:b], period[a:b])
                for k, (t, a, b) in enumerate(zip(texts, cut, cut[1:])) if a < b}

    def collapsed(self, k: int, found) -> bytes:
        """The words of a text, but for those of a run after its first period."""
        n = int(self.counts[k])
        if found is None and k not in self.moved:
            chosen = self.words.slice(self.first[k], n).to_pylist()
        else:
            edge = np.zeros(n + 1, np.int64)
            if found is not None:
                start, length, period = found
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            chosen = self.words.take(pa.array(self.place[self.first[k] + kept])).to_pylist()
        return b" ".join(chosen)


RUNS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
DIGEST = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame, least: int = LEAST, order: Order | None = None, digest: bool = False) -> DataFrame:
    """For each row of (doc_id, text) its runs, the longest of them, and the collapsed text, or the digests of the two.

    ``order`` may put another word of the text in each place before runs are looked for.
    """
    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = _Batch(batch.column(0), batch.column(1), order)
        runs = words.runs(least)
        longest, number, lists, texts = [], [], [], []
        for k in range(batch.num_rows):
            found = runs.get(k)
            text = words.collapsed(k, found)
            if found is None:
                longest.append((None,) * 4)
                number.append(0)
                rows = []
            else:
                start, length, period = found
                best = np.lexsort((period, start, -length))[0]
                longest.append((int(start[best]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best])))
                number.append(len(start))
                rows = list(zip(start.tolist(), length.tolist(), period.tolist()))
            if digest:
                lists.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rows).encode()).hexdigest())
                texts.append(hashlib.sha256(text).hexdigest())
            else:
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in rows])
                texts.append(text.decode())
        columns = [batch.column(0).cast(pa.int64()), pa.array(number, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*longest))]
        kind = pa.string() if digest else pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
        names += ["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(lists, kind), pa.array(texts, pa.string())], names)

    return map_chunks(docs.select("doc_id", "text"), find, DIGEST if digest else RUNS)


def tandem_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of one in ten documents, by the crc32 of the id, the words from some place on are taken from one period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at
