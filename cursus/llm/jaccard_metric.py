"""Exact Jaccard similarity join of documents, by pivots in the metric space of shingle sets.

Distance is one less the Jaccard similarity of the sets of SHINGLE-word
shingles; two documents link when 100 * intersection >= PERCENT * union, so
within the radius eps = 1 - PERCENT / 100. Classes of documents with equal sets
are joined as one.

Nearly all pairs of documents are at a distance of about one, where no pivot
tells anything. So the space is first cut into families that no link leaves:

* The hash space is cut into more parts than two linked sets of a size can
  differ in, hence some part holds the same shingles in both; documents that
  share the shingles of a part are a list. (Parts are empty in some documents
  and don't count; a document with too few others adds each single shingle, so
  no link is lost by chance.)
* A document with a link shares all its parts but those that the difference
  can spoil; one that shares fewer has no link, and leaves all lists.
* Within a list, documents that cannot link are told apart by fixed pivots, the
  slices of the hash space: the differences of two sets' counts in them add up
  to no more than the sets differ by. Larger sets have more slices. What can
  still link, directly or by others, is a family. A list of more than LIST documents is
  taken as one family, which only leaves more to the next step.

A family is a region. Pivots are chosen in it, far from each other; each
document belongs to the Voronoi cell of its nearest pivot, and is a guest in
each cell whose pivot is at most 2 eps farther and at most eps beyond the
cell's radius: by the triangle inequality no other cell holds a link of it.
Cells are joined the same way; where cells don't shrink, the region's members
are joined exactly by their rarest shingles. Regions of up to REGION shingles
are joined within a task, larger ones are cut into cells by a shuffle, and what
LEVELS such cuts leave too large is joined block against block. Documents that
are already connected are not compared again, and only one link to connect
each is passed on: components need no more. Equality of shingles and sets is
that of their 64-bit hashes (128 bits for sets); parts are equal by their bucket
and 32 bits, since unequal parts that meet only add to what is compared.

Cases: a null text, and one without words, has an empty set, links with nothing
and is its own component; a text of fewer words than SHINGLE has its whole
sequence as the only shingle; rows with a null doc_id take no part and have a
null component_id; rows of equal doc_id are one vertex; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .shared import chunks, give_back, map_chunks, written

SHINGLE, PERCENT = 4, 85
REGION = 2_000_000  # shingles joined in a task
LEVELS, PIVOTS = 3, 8
FLUSH = 500_000   # part hashes that a task holds
MARK = np.uint32    # of a part among those of its bucket
PLACES = {2: np.uint16, 4: np.int32, 8: np.int64}  # of documents among those of a task, by their bytes
SLICES = 64         # of the hash space, at least, whose counts tell sets apart
SLICE_SHINGLES = 4  # shingles a slice
PAIR_COUNTS = 1 << 21  # counts of pairs compared at a time
LIST = 2_000        # documents of a list that are told apart
LEAF = 24           # members of a region that needs no pivots

U = np.uint64


# -- sets ------------------------------------------------------------------------

def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the number before each text."""
    data, offsets = textkit.utf8(column)
    words = textkit.Words(textkit.LOWER[data], offsets)
    hashes = words.hashes()
    windows, before = textkit.shingles(hashes, words.first, n)
    text = np.repeat(np.arange(len(words.counts)), np.diff(before))
    for size in range(1, n):  # whole sequences of the few texts that are too short
        few = np.flatnonzero(words.counts == size)
        whole = np.full(len(few), size, U)
        for k in range(size):
            whole = textkit.mix(whole * U(31) + hashes[words.first[few] + k])
        windows, text = np.append(windows, whole), np.append(text, few)
    order = np.lexsort((windows, text))
    windows, text = windows[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (text[1:] != text[:-1])
    return windows[new], np.searchsorted(text[new], np.arange(len(words.counts) + 1))


def set_keys(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    out = []
    for salt in (U(0), U(0x51ED270B)):
        sums = np.zeros(len(sets) + 1, U)
        np.cumsum(textkit.mix(sets + salt), out=sums[1:])
        out.append(textkit.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U)).view(np.int64))
    return out[0], out[1]


# -- families: parts that linked sets share --------------------------------------

def most_different(n: int, percent: int = PERCENT) -> int:
    """The most shingles that a set of n and a linked set of n or more don't share."""
    return (100 - percent) * (100 * n // percent) // 100


@cache
def size_classes(largest: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of set sizes: first size, number of parts, and the most shingles that linked sets don't share.

    A class spans 30 percent. It has at least one part more than linked sets can
    differ in, and so many that few of its sets leave too many parts empty.
    """
    low, parts, most, lo = [], [], [], 1
    while lo <= largest:
        hi = max(lo + 1, math.ceil(lo * 1.3))
        h = most_different(hi - 1, percent)
        m = h + 1
        # a union bound on lo shingles lying in h of m parts
        while h and m < 4 * h and (math.lgamma(m + 1) - math.lgamma(h + 1) - math.lgamma(m - h + 1)
                                   + lo * math.log(h / m)) > math.log(0.01):
            m += 1
        low.append(lo)
        parts.append(m)
        most.append(h)
        lo = hi
    return np.array(low), np.array(parts), np.array(most)


def part_hashes(sets: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the parts of each set, the set of each, and how many of its parts a set shares at least if it has a link.

    A pair of linked sets meets in the class of its smaller size, so a set gives
    its parts for its own class and for those of the sizes it can link with
    below. Each shingle that is not shared spoils one part: of a class, a set
    with a link shares all its parts but the most that linked sets differ in.
    """
    size = np.diff(first)
    low, parts, most = size_classes(int(max(size.max(initial=1), 1)), percent)
    own = np.searchsorted(low, size, side="right") - 1
    least = -(-percent * size // 100)
    text = np.repeat(np.arange(len(size)), size)
    salted = textkit.mix(sets + U(7))
    out, of = [], []
    need = np.full(len(size), np.iinfo(np.int64).max)
    for back in range(len(low)):
        c = own - back
        use = (size > 0) & (c >= 0)
        if back:
            use &= low[np.minimum(c + 1, len(low) - 1)] > least
        if not use.any():
            break
        sel = use[text]
        g, t, s = sets[sel], text[sel], salted[sel]
        part = ((g >> U(32)) * parts[c[t]].astype(U)) >> U(32)  # sets are sorted, so parts lie side by side
        new = np.ones(len(g), bool)
        new[1:] = (part[1:] != part[:-1]) | (t[1:] != t[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(g))
        sums = np.zeros(len(g) + 1, U)
        np.cumsum(s, out=sums[1:])
        place = part[a] * U(1_000_003) + c[t[a]].astype(U) * U(0x9E3779B97F4A7C15)
        out.append(textkit.mix(textkit.mix(sums[b] - sums[a]) + place))
        of.append(t[a])
        # sets with too few parts that aren't empty: any linked pair of them shares a shingle
        spare = np.bincount(t[a], minlength=len(size)) - most[np.maximum(c, 0)]
        few = use & (spare <= 0)
        need[use] = np.minimum(need[use], np.maximum(spare[use], 1))
        alone = few[t]
        out.append(textkit.mix(g[alone] + c[t[alone]].astype(U) * U(12_345_677) + U(99)))
        of.append(t[alone])
    return (np.concatenate(out), np.concatenate(of), need) if out else (np.zeros(0, U), np.zeros(0, np.int64), need)


def sketches(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Counts of each set in slices of the hash space, by other bits of the hashes than the parts' own.

    A set has a slice for every SLICE_SHINGLES of its shingles, SLICES at least, and a power of two of them. A set with
    too many shingles in a slice for a byte has no counts, which tells it apart from none.
    """
    out = []
    for a, b in pairwise(first.tolist()):
        slices = max(SLICES, 1 << (-(-(b - a) // SLICE_SHINGLES) - 1).bit_length())
        counts = np.bincount((sets[a:b] & U(slices - 1)).astype(np.int64), minlength=slices)
        out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"")
    return out


def _folded(counts: list[np.ndarray], slices: int) -> np.ndarray:
    """Counts in fewer slices."""
    return np.stack([c.reshape(-1, slices).sum(0, dtype=np.int32) for c in counts])


def possible(size: np.ndarray, counts: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which pairs may link, as their sizes and slice counts tell: a square of booleans.

    Pairs that some slices don't tell apart are compared in twice as many, as long as both sets have so many.
    """
    least, most = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
    fits = 100 * least >= percent * most
    # 100 * common >= percent * union, and common and union add up to both sizes
    apart = (100 - percent) * (least + most) // (100 + percent)
    slices = SLICES
    while True:
        has = np.flatnonzero([len(c) >= slices for c in counts])
        if not len(has):
            return fits
        c = _folded([counts[k] for k in has], slices)
        x, y = np.nonzero(np.triu(fits[np.ix_(has, has)], 1))
        step = max(1, PAIR_COUNTS // slices)
        for lo in range(0, len(x), step):
            i, j = x[lo:lo + step], y[lo:lo + step]
            differ = np.abs(c[i] - c[j]).sum(1, dtype=np.int64)
            i, j = has[i], has[j]
            gone = differ > apart[i, j]
            fits[i[gone], j[gone]] = fits[j[gone], i[gone]] = False
        slices *= 2


def clusters(near: np.ndarray) -> np.ndarray:
    """The least member of each member's connected component, from a square of booleans."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


PARTS = "bucket int, doc_id bigint, n bigint, k1 bigint, k2 bigint, need bigint, keys binary, docs binary"
MET = "doc_id bigint, n bigint, k1 bigint, k2 bigint, need bigint, counts binary, head bigint, list bigint, docs array<bigint>"
_MET = [c.split()[0] for c in MET.split(", ")]


def _met_rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"counts": pa.binary(), "docs": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in _MET], _MET)


def _part_rows(buckets: int, shingle: int, percent: int):
    """Rows of two kinds: documents (k1 given; ``keys`` has their slice counts), and parts, packed by bucket.

    Of documents with equal sets, the first of the task gives its parts.
    """
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        given: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, nodes = map(np.concatenate, zip(*held))
            held.clear()
            given.clear()
            bucket = (keys % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            marks, nodes, bucket = (keys >> U(32)).astype(MARK)[order], nodes[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() + [len(marks)]
            base = int(nodes.min())
            kind = next(k for k in PLACES.values() if int(nodes.max()) - base <= np.iinfo(k).max)
            packed = [(int(bucket[a]), marks[a:b].tobytes(), (nodes[a:b] - base).astype(kind).tobytes())
                      for a, b in pairwise(cuts)]
            for lo in range(0, len(packed), 512):
                part = packed[lo:lo + 512]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in part], pa.int32()), pa.array([base] * len(part), pa.int64()), none, none, none, none,
                     pa.array([p[1] for p in part], pa.binary()), pa.array([p[2] for p in part], pa.binary())], names)

        size = 0
        for batch in batches:
            for b in chunks(batch, "text"):
                sets, first = shingle_sets(b.column(1), shingle)
                k1, k2 = set_keys(sets, first)
                ids, n = b.column(0).to_numpy(), np.diff(first)
                all_keys, all_of, need = part_hashes(sets, first, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((textkit.mix(ids.view(U)) % U(buckets)).astype(np.int32)), b.column(0), pa.array(n.astype(np.int64)),
                     pa.array(k1), pa.array(k2), pa.array(need), pa.array(sketches(sets, first), pa.binary()),
                     pa.nulls(len(ids), pa.binary())], names)
                new = np.zeros(len(ids), bool)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if key not in given:
                        given.add(key)
                        new[i] = True
                sel = new[all_of]
                held.append((all_keys[sel], ids[all_of[sel]]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        give_back()
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by bucket: documents pass; the documents of a part make a list, equal lists one row.

    Of lists of more than LIST documents, links of all to the least.
    """
    bucket, keys, docs = None, [], []

    def finish() -> Iterator[pa.RecordBatch]:
        k, d = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, d = k[new], d[new]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(first, len(k)))
        some = sizes > 1
        names = textkit.mix(np.add.reduceat(textkit.mix(d.view(U) + U(3)), first) + sizes.astype(U)).view(np.int64)
        small = np.flatnonzero(some & (sizes <= LIST))
        _, one, weight = np.unique(names[small], return_index=True, return_counts=True)
        small = small[one]
        if len(small):
            members = d[textkit.ranges(first[small], sizes[small])]
            yield _met_rows(list=pa.array(names[small]), n=pa.array(weight),
                            docs=textkit.lists(members, np.append(0, np.cumsum(sizes[small])), pa.int64()))
        for a, n in zip(first[sizes > LIST], sizes[sizes > LIST]):
            yield _met_rows(doc_id=pa.array(d[a + 1:a + n]), head=pa.array(np.full(n - 1, d[a])))

    for b in batches:
        packed = b.column("docs").is_valid().to_numpy(zero_copy_only=False)
        plain = b.filter(pa.array(~packed))
        if plain.num_rows:
            yield _met_rows(counts=plain.column("keys"), **{c: plain.column(c) for c in ("doc_id", "n", "k1", "k2", "need")})
        rest = b.filter(pa.array(packed))
        for at, base, k, d in zip(*(rest.column(c).to_pylist() for c in ("bucket", "doc_id", "keys", "docs"))):
            if at != bucket:
                if keys:
                    yield from finish()
                bucket, keys, docs = at, [], []
            k = np.frombuffer(k, MARK)
            keys.append(k)
            docs.append(np.frombuffer(d, PLACES[len(d) // len(k)]).astype(np.int64) + base)
    if keys:
        yield from finish()
    give_back()


def _told_apart(percent: int):
    """Partitions sorted by list: links that connect what may link in each list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def finish() -> pa.RecordBatch:
            held.sort()
            ids = np.array([h[0] for h in held])
            size = np.array([h[1] for h in held])
            counts = [np.frombuffer(h[2], np.uint8) for h in held]
            label = clusters(possible(size, counts, percent))
            other = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(ids[label[other]]), pa.array(ids[other])], ["a", "b"])

        for b in batches:
            for key, *row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if key != name:
                    if len(held) > 1:
                        yield finish()
                    name, held = key, []
                held.append(row)
        if len(held) > 1:
            yield finish()
        give_back()
    return run


# -- regions -----------------------------------------------------------------------

class Region:
    """Sets of a region, joined in memory; ``links`` are (place, place) pairs that connect its components."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent, self.eps = sets, percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets])
        self.root = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def linked(self, common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)

    def connected(self, members: np.ndarray) -> bool:
        return len({self.find(int(x)) for x in members}) < 2

    def distances(self, members: np.ndarray, pivot: int) -> np.ndarray:
        """Distances of members to a pivot; links found on the way are kept."""
        flat = np.concatenate([self.sets[m] for m in members])
        p = self.sets[pivot]
        hit = p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat
        common = np.add.reduceat(hit, np.cumsum(self.size[members]) - self.size[members], dtype=np.int64)
        for m in members[self.linked(common, self.size[members], len(p))]:
            self.link(int(m), pivot)
        return 1 - common / (self.size[members] + len(p) - common)

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2 or self.connected(members):
            return
        if len(members) <= LEAF:
            return self.join_rarest(members)
        pivots, near = [int(members[self.size[members].argmax()])], None
        d = np.empty((len(members), 0))
        for _ in range(PIVOTS):
            d = np.column_stack([d, self.distances(members, pivots[-1])])
            near = d.min(1)
            if near.max() <= self.eps:
                break
            pivots.append(int(members[near.argmax()]))
        cells = list(voronoi(d, self.eps))
        if max(map(len, cells)) > 0.7 * len(members):
            return self.join_rarest(members)
        for cell in cells:
            self.join(members[cell])

    def join_rarest(self, members: np.ndarray) -> None:
        """All links of a region: two linked sets share one of the first shingles of both, the rarest first."""
        if self.connected(members):
            return
        n = self.size[members]
        flat, of = np.concatenate([self.sets[m] for m in members]), np.repeat(np.arange(len(members)), n)
        _, shingle, count = np.unique(flat, return_inverse=True, return_counts=True)
        begin = np.cumsum(n) - n
        by_rarity = np.lexsort((shingle, count[shingle], of))
        rank = np.arange(len(flat)) - begin[of]
        head = by_rarity[rank < (n - -(-self.percent * n // 100) + 1)[of]]
        head = head[count[shingle[head]] > 1]
        by_shingle = np.argsort(shingle, kind="stable")
        post, start = of[by_shingle], np.cumsum(count) - count
        of_head, head_shingle = of[head], shingle[head]
        heads = np.lexsort((of_head, head_shingle))
        h_shingle, h_of = head_shingle[heads], of_head[heads]
        first = np.searchsorted(of_head, np.arange(len(members) + 1))
        for x in range(len(members)):
            mine = head_shingle[first[x]:first[x + 1]]
            if not len(mine):
                continue
            a, b = np.searchsorted(h_shingle, mine, "left"), np.searchsorted(h_shingle, mine, "right")
            found = np.unique(np.concatenate([h_of[i:j] for i, j in zip(a, b)]))
            found = found[found > x]
            here = self.find(int(members[x]))
            found = [y for y in found.tolist() if self.find(int(members[y])) != here]
            if not found:
                continue
            every = shingle[begin[x]:begin[x] + n[x]]
            if len(found) > 16:
                hits = np.concatenate([post[start[s]:start[s] + count[s]] for s in every[count[every] > 1]])
                common = np.bincount(hits, minlength=len(members))[found]
            else:
                mine = self.sets[members[x]]
                common = np.array([len(np.intersect1d(mine, self.sets[members[y]], assume_unique=True)) for y in found])
            for y in np.array(found)[self.linked(common, n[x], n[found])]:
                self.link(int(members[x]), int(members[y]))


def voronoi(d: np.ndarray, eps: float) -> Iterator[np.ndarray]:
    """Members of each cell, guests included, from distances (members x pivots)."""
    home = d.argmin(1)
    near = d[np.arange(len(d)), home]
    slack = 1e-9
    for j in range(d.shape[1]):
        own = home == j
        if own.any():
            guest = (d[:, j] <= near + 2 * eps + slack) & (d[:, j] <= near[own].max() + eps + slack)
            yield np.flatnonzero(own | guest)


SETS = "region string, doc_id bigint, items binary"
LINKS = "a bigint, b bigint"


def _read_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U)


def _sets_of(rows: list, shingle: int) -> list[np.ndarray]:
    """Sets from texts, or from the bytes of sets."""
    if not isinstance(rows[0], str):
        return [_read_set(r) for r in rows]
    sets, first = [], 0
    for part in chunks(pa.record_batch([pa.array(rows, pa.large_string())], ["text"]), "text"):
        flat, first = shingle_sets(part.column(0), shingle)
        sets += [flat[a:b] for a, b in pairwise(first.tolist())]
    return sets


def _join_regions(percent: int, shingle: int):
    """Partitions sorted by region: each region joined in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, set()

        def finish() -> pa.RecordBatch:
            ids = [i for i, _ in held]
            r = Region(_sets_of([x for _, x in held], shingle), percent)
            r.join(np.flatnonzero(r.size > 0))
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k, _ in r.links], pa.int64()),
                                               pa.array([ids[k] for _, k in r.links], pa.int64())], ["a", "b"])

        for b in batches:
            for key, doc, given in zip(*(b.column(k).to_pylist() for k in range(3))):
                if key != region:
                    if held:
                        yield finish()
                    region, held = key, set()
                held.add((doc, given))  # rows of one doc_id may differ
        if held:
            yield finish()
        give_back()
    return run


def _cells(percent: int):
    """Members of large regions, with their region's pivots, to rows of cells and links to pivots."""
    eps = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for region, doc, items, pivots in zip(*(b.column(k).to_pylist() for k in range(4))):
                x = _read_set(items)
                row = []
                for p in pivots:
                    s = _read_set(p["items"])
                    common = len(np.intersect1d(x, s, assume_unique=True))
                    row.append((1 - common / (len(x) + len(s) - common), p["doc_id"],
                                100 * common >= percent * (len(x) + len(s) - common)))
                near = min(row)[0]
                out += [(f"{region}/{p}", region, doc, items if d <= near + 2 * eps + 1e-9 else None, d, d == near, near_link, p)
                        for d, p, near_link in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64()))],
                ["cell", "region", "doc_id", "items", "d", "home", "linked", "pivot"])
    return run


CELLS = "cell string, region string, doc_id bigint, items binary, d double, home boolean, linked boolean, pivot bigint"


def _split(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Cut large regions into Voronoi cells: the cells' members, guests included, and links to pivots.

    Pivots are chosen by hash: PIVOTS rows a region, so a region's are small.
    """
    pivots = (_first_by_hash(large).groupBy("region").agg(F.collect_list(F.struct("doc_id", "items")).alias("pivots")))
    rows = written(large.join(pivots, "region").select("region", "doc_id", "items", "pivots")
                   .mapInArrow(_cells(percent), CELLS), "cells")
    radius = rows.where("home").groupBy("cell").agg(F.max("d").alias("radius"))
    inside = rows.join(radius, "cell").where(
        F.col("items").isNotNull() & (F.col("d") <= F.col("radius") + (1 - percent / 100) + 1e-9))
    return (inside.select(F.col("cell").alias("region"), "doc_id", "items"),
            rows.where(F.col("linked") & (F.col("doc_id") != F.col("pivot"))).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))


def _first_by_hash(large: DataFrame) -> DataFrame:
    """PIVOTS members of each region, the least by hash; a rank filter keeps few rows of a region in each task."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("region", "doc_id"), "doc_id")
    return large.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).drop("r")


def _blocks(large: DataFrame, limit: int) -> DataFrame:
    """Every pair of blocks of a region as a region of its own, of at most about ``limit`` shingles."""
    size = large.groupBy("region").agg(F.sum(F.length("items") / 8).alias("total"))
    n = F.ceil(2 * F.col("total") / F.lit(limit)).cast("int") + 1
    rows = large.join(size.select("region", n.alias("blocks")), "region").withColumn(
        "mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(F.concat_ws("#", "region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"),
                        "doc_id", "items")


def _joined(regions: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """Links within regions: region, doc_id, and the text or the set of each member."""
    return (regions.repartition("region").sortWithinPartitions("region", "doc_id")
            .mapInArrow(_join_regions(percent, shingle), LINKS))


def link_large(regions: DataFrame, percent: int, limit: int, levels: int) -> DataFrame:
    """Links (a, b) that connect the components of regions too large for a task: region, doc_id, items."""
    found = []
    for level in range(levels):
        regions, to_pivots = _split(regions, percent)
        found.append(to_pivots)
        size = regions.groupBy("region").agg((F.sum(F.length("items")) / 8).alias("total"))
        big = size.where(F.col("total") > limit).select("region")
        found.append(_joined(regions.join(big, "region", "left_anti"), percent))
        regions = written(regions.join(big, "region", "left_semi"), "large-regions")
        if regions.isEmpty():
            break
    else:
        found.append(_joined(_blocks(regions, limit), percent))
    return reduce(DataFrame.union, found)


# -- the join ------------------------------------------------------------------------

def _set_rows(shingle: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, first = shingle_sets(batch.column(2), shingle)
        raw = [sets[a:b].tobytes() for a, b in zip(first.tolist(), first.tolist()[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())],
                                          ["region", "doc_id", "items"])
    return one


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, limit: int = REGION,
                      levels: int = LEVELS) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id connected with it."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    given = texts.where(F.col("doc_id").isNotNull())
    worded = given.where(F.col("text").isNotNull())
    buckets = 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    met = written(given.mapInArrow(_part_rows(buckets, shingle, percent), PARTS)
                  .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, MET), "parts")
    rows = met.where(F.col("k1").isNotNull()).select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    large = met.where(F.col("head").isNotNull()).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    # equal lists are one row, which stands for as many parts
    lists = (met.where(F.col("docs").isNotNull()).groupBy("list").agg(F.sum("n").alias("parts"), F.first("docs").alias("docs"))
             .select("list", "parts", F.explode("docs").alias("doc_id")))
    lists = written(lists, "lists")
    shared = (lists.groupBy("doc_id").agg(F.sum("parts").alias("parts"))
              .union(large.groupBy("b").agg(F.count("*"))).union(large.groupBy("a").agg(F.count("*")))
              .groupBy("doc_id").agg(F.sum("parts").alias("shared")))
    counted = (met.where(F.col("k1").isNotNull()).select("doc_id", "n", "need", "counts").join(shared, "doc_id")
               .where("shared >= need").select("doc_id", "n", "counts"))
    near = (lists.join(counted, "doc_id").select("list", "doc_id", "n", "counts")
            .repartition("list").sortWithinPartitions("list").mapInArrow(_told_apart(percent), LINKS))
    families = components(written(near.union(large).union(_bridges(rows)).distinct(), "near"))

    # one document for each set, the least; the family of a set is that of any document that gave its parts
    sets = (rows.where("n_shingles > 0").join(families, rows.doc_id == families.node, "left").groupBy("k1", "k2")
            .agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.min("component").alias("component")))
    sets = written(sets, "sets")
    members = sets.where(F.col("component").isNotNull()).select("component", "first_id", "n")
    # families of one set need no join
    regions = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    members = written(members.join(regions, "component").select(
        F.col("first_id").alias("doc_id"), F.col("component").cast("string").alias("region"),
        (F.col("total") > limit).alias("large")).distinct(), "members")
    links = _joined(worded.join(members.where("not large"), "doc_id").select("region", "doc_id", "text"), percent, shingle)
    if not members.where("large").isEmpty():
        asked = worded.join(members.where("large"), "doc_id").select("region", "doc_id", "text")
        large = written(map_chunks(asked, _set_rows(shingle), SETS).where(F.length("items") > 0).distinct(), "regions")
        links = links.union(link_large(large, percent, limit, levels))
    links = written(links, "links")
    # equal sets are links, too
    same = (rows.where("n_shingles > 0").join(sets.select("k1", "k2", "first_id"), ["k1", "k2"]).where("doc_id != first_id")
            .select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")))
    joined = components(links.union(same).distinct())
    out = (rows.join(joined, rows.doc_id == joined.node, "left")
           .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    nameless = map_chunks(texts.where(F.col("doc_id").isNull()), _counts(shingle), "doc_id bigint, n_shingles bigint")
    return out.unionByName(nameless.withColumn("component_id", F.lit(None).cast("bigint")))


def _bridges(rows: DataFrame) -> DataFrame:
    """Links between the documents of equal sets, where one of them has other sets, too (rows of equal doc_id).

    Such a document is in the families of all its sets, and they are one family; by these links, the families that
    the sets' other documents are in belong to it. Documents of one set are in its family already.
    """
    sets = rows.where("n_shingles > 0").select("doc_id", F.struct("k1", "k2").alias("key"))
    several = sets.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("doc_id")
    shared = sets.join(several, "doc_id", "left_semi").select("key").distinct()
    touched = sets.join(shared, "key", "left_semi")
    first = touched.groupBy("key").agg(F.min("doc_id").alias("a"))
    return touched.join(first, "key").where("a != doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def _counts(shingle: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.diff(shingle_sets(batch.column(1), shingle)[1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64))], ["doc_id", "n_shingles"])
    return one


def components_sql(shingle: int = SHINGLE, percent: int = PERCENT) -> str:
    """DuckDB SQL of similar_documents, by all pairs that share a shingle; for small tables with distinct ids."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{capitals}', '{small}'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {shingle - 1}, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION SELECT r.doc_id, b.b FROM reach r JOIN sides b ON r.other = b.a)
SELECT w.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM words w JOIN reach r ON r.doc_id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""
