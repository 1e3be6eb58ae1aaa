"""SentencePiece encodings sampled without replacement, and their decoding.

All segmentations of a text into pieces of a vocabulary form a lattice; a
segmentation's probability is the product of its pieces' weights over the sum
of all. ``sample_pieces`` emits the k segmentations with the largest perturbed
log probabilities, which is a sample of k without replacement, by an A* search:

* A node of the search is a set of segmentations that share a beginning. Its
  key is the exact maximum of their perturbed log probabilities, a Gumbel
  variable at the log of the set's mass, truncated at the key it came from.
* Popping a node yields its best segmentation, drawn piece by piece from the
  backward sums of the lattice, and splits the rest of the set by the place
  where it leaves that segmentation; each part enters the queue.
* The parts beyond AHEAD places stay together as one node until it is popped.

The key of the next node in the queue is the threshold for the inclusion
scores: log(1 - exp(-exp(log_prob - threshold))), zero if nothing is left.

The vocabulary's pieces don't span a blank that follows a character, nor a line
feed, so the lattice falls into segments there; each distinct segment of a
batch has its edges and sums computed once, and all texts of a batch are drawn
together, step by step. Weights: the vocabulary's pieces are ranked by merges,
and a piece of rank r has weight (r + OFFSET) ** -POWER; a character that is no
piece is spelled in its bytes, at BYTE each. Draws are hashes of the seed, the
row key and the place, so reruns agree.

``decode`` gives the text back from the ids, byte for byte; a literal U+2581 is
spelled in bytes, so it survives.

Cases: a null or empty text has the empty segmentation alone; a text with fewer
than k segmentations gives them all; a null key counts as a key of its own;
repeated rows give equal samples; texts are encoded whole; an empty table gives
no rows; other columns are dropped by ``sample_pieces``.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import map_chunks, process_cache

K, AHEAD, SEED = 2, 24, 11
NOTHING = 1e-13  # a share that is rounding
POWER, OFFSET, BYTE = 1.0, 2.0, -12.0
BLANK, FEED = 32, 10

U = np.uint64
_PLACE, _STEP, _DRAW = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


class Vocabulary:
    """Pieces of a SentencePiece model as bytes (the sign for a blank as a blank), their weights and byte ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        normal, self.byte_ids = [], np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                normal.append(i)
        # merges in their order; pieces that no merge made (runs of blanks) follow by id
        normal.sort(key=lambda i: (-model.get_score(i), i))
        self.weight = np.zeros(len(self.bytes))
        self.weight[normal] = -POWER * np.log(np.arange(len(normal)) + OFFSET)
        for i in normal:
            piece = self.bytes[i]
            if bytes([FEED]) in piece or b" " in piece.lstrip(b" "):
                raise ValueError("the vocabulary has pieces across words")
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._index({self.bytes[i]: i for i in reversed(normal)})

    def _index(self, ids: dict[bytes, int]) -> None:
        """A hash table of all beginnings of pieces; chains of equal slots follow ``after``."""
        heads = sorted({p[:n] for p in ids for n in range(1, len(p) + 1)})
        data, offsets = textkit.utf8(pa.array(heads, pa.binary()))
        self.keys = np.concatenate([[U(0)], textkit.PrefixHash(data)(offsets[:-1], offsets[1:])])
        self.piece = np.array([-1] + [ids.get(h, -1) for h in heads])
        slots = (self.keys & U((1 << 19) - 1)).astype(np.int64)
        self.table, self.after = np.zeros(1 << 19, np.int32), np.zeros(len(slots), np.int32)
        for i in range(1, len(slots)):
            self.after[i] = self.table[slots[i]]
            self.table[slots[i]] = i
        self.longest = max(map(len, heads), default=0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, 0 for those that begin no piece."""
        at = self.table[(hashes & U((1 << 19) - 1)).astype(np.int64)]
        wrong = np.flatnonzero((at > 0) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = self.after[at[wrong]]
            wrong = wrong[(at[wrong] > 0) & (self.keys[at[wrong]] != hashes[wrong])]
        return at

    def decode_all(self, ids: np.ndarray, bounds: list[int]) -> list[bytes]:
        """The texts of the runs of ids between bounds, without the blanks put before them."""
        size = self.size[ids]
        flat = self.flat[textkit.ranges(self.start[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[bounds].tolist()
        return [flat[a + 1:b] for a, b in pairwise(ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the blank put before it."""
        return self.decode_all(ids, [0, len(ids)])[0]


def vocabulary(path: str) -> Vocabulary:
    cache = process_cache("vocabularies")
    if path not in cache:
        cache[path] = Vocabulary(path)
    return cache[path]


@dataclass
class Lattice:
    """Edges of distinct segments, by the place they start at; a place is a byte, and one more ends each segment."""
    first: np.ndarray   # edges before each place
    to: np.ndarray      # the place where an edge ends
    piece: np.ndarray   # its piece, or -1 for a character in bytes
    prob: np.ndarray    # its probability, given its start
    log: np.ndarray     # the logarithm of that
    upto: np.ndarray    # the sum of prob up to it, of its start
    data: np.ndarray
    total: np.ndarray   # log weight of all paths from each place on

    @classmethod
    def of(cls, v: Vocabulary, data: np.ndarray, ends: np.ndarray) -> Lattice:
        """``ends``: the places behind the segments, whose bytes don't count; the next segment begins behind."""
        n = len(data)
        end = np.repeat(ends, np.diff(ends, prepend=-1))
        mark = ~textkit.CONTINUATION[data]
        mark[ends] = True
        chars = np.flatnonzero(mark)
        width = np.zeros(n, np.int64)
        width[chars] = np.diff(np.append(chars, n))
        mark[ends] = False
        chars = np.flatnonzero(mark)
        prefix = textkit.PrefixHash(data)
        found_at, found_size, found_piece = [], [], []
        count = np.zeros(n, np.int64)      # edges of each place
        alone = np.zeros(n, bool)          # characters that are pieces themselves
        live = chars
        for size in range(1, v.longest + 1):
            live = live[live + size <= end[live]]
            if not len(live):
                break
            entry = v.find(prefix(live, live + size))
            live, entry = live[entry > 0], entry[entry > 0]
            piece = v.piece[entry]
            at, piece = live[piece >= 0], piece[piece >= 0]
            found_at.append(at)
            found_size.append(size)
            found_piece.append(piece)
            alone[at[width[at] == size]] = True
            count[at] += 1
        spelled = chars[~alone[chars]]
        count[spelled] += 1
        first = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=first[1:])
        # the edges of a place side by side, the longest first
        to, piece = np.empty(first[-1], np.int32), np.full(first[-1], -1, np.int32)
        free = first[1:].copy()
        free[spelled] -= 1
        to[free[spelled]] = spelled + width[spelled]
        for at, size, ids in zip(found_at, found_size, found_piece):
            free[at] -= 1
            to[free[at]] = at + size
            piece[free[at]] = ids
        start = np.repeat(np.arange(n, dtype=np.int32), count)
        weight = v.weight[piece]
        in_bytes = np.flatnonzero(piece < 0)
        weight[in_bytes] = BYTE * (to[in_bytes] - start[in_bytes])

        # backward sums: all places as far from their segment's end at a time
        far = (end[chars] - chars)
        far = far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far
        order = np.argsort(far, kind="stable")
        places, far = chars[order], far[order]
        edges = textkit.ranges(first[places], count[places])
        target, base = to[edges], weight[edges]
        begins = np.append(0, np.cumsum(count[places]))
        total = np.zeros(n)
        steps = np.flatnonzero(np.append(True, far[1:] != far[:-1])) if len(places) else np.zeros(0, np.int64)
        for a, b in zip(steps.tolist(), np.append(steps[1:], len(places)).tolist()):
            lo, hi = begins[a], begins[b]
            value = base[lo:hi] + total[target[lo:hi]]
            group = begins[a:b] - lo
            top = np.maximum.reduceat(value, group)
            total[places[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[places[a:b]])), group))
        log = weight + total[to] - total[start]
        prob = np.exp(log)
        sums = np.zeros(len(prob) + 1)
        np.cumsum(prob, out=sums[1:])
        upto = sums[1:] - sums[first[start]]
        upto[first[chars + 1] - 1] = 1.0
        return cls(first, to, piece, prob, log, upto, data, total)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit values."""
    return ((textkit.mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _uniform(key: np.ndarray, place: np.ndarray | int, step: np.ndarray | int, draw: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    constant = U(draw * int(_DRAW) & (1 << 64) - 1)
    x = np.atleast_1d(np.asarray(place)).astype(U) * _PLACE + np.atleast_1d(np.asarray(step)).astype(U) * _STEP
    return _unit(x + (np.atleast_1d(np.asarray(key, U)) + constant))


def _truncated(mass: np.ndarray, limit: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at the logs of masses, given that they are at most the limit."""
    with np.errstate(divide="ignore"):
        value = mass - np.log(-np.log(u))
    high, low = np.maximum(-limit, -value), np.minimum(-limit, -value)
    return np.where(np.isneginf(mass), -np.inf, -(high + np.log1p(np.exp(low - high))))


@dataclass
class Batch:
    """Texts of a batch as occurrences of distinct segments."""
    lattice: Lattice
    start: np.ndarray   # place of each occurrence's segment
    end: np.ndarray
    first: np.ndarray   # occurrences before each text
    key: np.ndarray     # of each text

    @classmethod
    def of(cls, v: Vocabulary, column: pa.Array, key: np.ndarray) -> Batch:
        data, offsets = textkit.utf8(column)
        filled = np.diff(offsets) > 0
        # a blank before each text that is not empty
        shift = np.append(0, np.cumsum(filled))
        data = np.insert(data, offsets[:-1][filled], BLANK)
        offsets = offsets + shift
        cut = np.zeros(len(data), bool)
        if len(data):
            blank, feed = data == BLANK, data == FEED
            cut = feed.copy()
            cut[1:] |= (blank[1:] & ~blank[:-1]) | feed[:-1]
            cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        _, sample, which = np.unique(textkit.PrefixHash(data)(starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - starts)[sample]
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        lattice = Lattice.of(v, np.append(data, np.uint8(0))[textkit.ranges(starts[sample], sizes + 1)], begin + sizes)
        return cls(lattice, begin[which], (begin + sizes)[which], np.searchsorted(starts, offsets), key)

    def draw(self, occurrences: np.ndarray, place: np.ndarray, skipped: np.ndarray, key: np.ndarray,
             number: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from a place of each occurrence to its end, one after the other, and the number of each.

        skipped: steps before that place, number: of the occurrence in its text.
        """
        lat, end = self.lattice, self.end[occurrences]
        base = key + number.astype(U) * _PLACE + skipped.astype(U) * _STEP + U(turn * int(_DRAW) & (1 << 64) - 1)
        live, at, step = np.flatnonzero(place < end), place[place < end], 0
        who, edges = [], []
        while len(live):
            e = lat.first[at]
            u = _unit(base[live] + U(step * int(_STEP) & (1 << 64) - 1))
            low = np.flatnonzero(u > lat.upto[e])
            while len(low):
                e[low] += 1
                low = low[u[low] > lat.upto[e[low]]]
            who.append(live)
            edges.append(e)
            at = lat.to[e]
            on = at < end[live]
            live, at, step = live[on], at[on], step + 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(len(occurrences), np.int64)
        counts = np.bincount(np.concatenate(who), minlength=len(occurrences))
        before = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (w, e) in enumerate(zip(who, edges)):
            out[before[w] + k] = e
        return out, counts


@dataclass
class Path:
    """A segmentation of one text: its edges, and the edges of each of its occurrences."""
    edges: np.ndarray
    counts: np.ndarray
    score: float
    log_prob: float


class Search:
    """The queue of one text: nodes (-key, path, place, edges left out there); place -1 - p holds all places from p on."""

    def __init__(self, batch: Batch, key: int):
        self.batch, self.key, self.queue, self.paths, self.drawn = batch, key, [], [], 0

    def begin(self, path: Path, values: list[float]) -> None:
        """The parts of the set of all segmentations, whose keys ``first_parts`` gave: the places, then the tail."""
        self.paths.append(path)
        upper = min(len(path.edges), AHEAD)
        self.queue = [(-value, 0, j, ()) for j, value in enumerate(values[:upper]) if value > -np.inf]
        if values[AHEAD] > -np.inf:
            self.queue.append((-values[AHEAD], 0, -1 - upper, ()))
        heapq.heapify(self.queue)
        self.drawn = AHEAD + 1

    def push(self, path: Path, from_place: int, left_out: tuple[int, ...], limit: float) -> None:
        """Parts of the popped set that leave a path at from_place (without the edges left out) or behind it."""
        self.paths.append(path)
        self._split(len(self.paths) - 1, from_place, left_out, limit, False)

    def _split(self, n: int, from_place: int, left_out: tuple[int, ...], limit: float, attained: bool) -> None:
        """AHEAD places and the tail behind them, below the limit; if it is attained, by one of them by mass."""
        path = self.paths[n]
        upper = min(len(path.edges), from_place + AHEAD)
        prob = self.batch.lattice.prob[path.edges[:upper]]
        logs = np.zeros(upper + 1)
        np.cumsum(np.log(prob), out=logs[1:])
        rest = 1 - prob[from_place:]
        if len(rest) and left_out:
            rest[0] -= sum(self.batch.lattice.prob[e] for e in left_out)
        behind = 1 - np.exp(path.log_prob - logs[-1]) if upper < len(path.edges) else 0.0
        rest = np.append(rest, behind)
        rest[rest < NOTHING] = 0
        with np.errstate(divide="ignore"):
            mass = logs[from_place:] + np.log(rest)
        if not rest.any():
            return
        values = _truncated(mass, limit, self._uniforms(len(mass)))
        if attained:
            share = np.cumsum(np.exp(mass - mass.max()))
            values[int(np.searchsorted(share, self._uniforms(1)[0] * share[-1]))] = limit
        *values, tail = values.tolist()
        for j, value in enumerate(values):
            if value > -np.inf:
                heapq.heappush(self.queue, (-value, n, from_place + j, left_out if j == 0 else ()))
        if tail > -np.inf:
            heapq.heappush(self.queue, (-tail, n, -1 - upper, ()))

    def _uniforms(self, n: int) -> np.ndarray:
        u = _uniform(U(self.key), np.arange(self.drawn, self.drawn + n), 1 << 20, 1 << 20)
        self.drawn += n
        return u

    def pop(self) -> tuple[float, Path, int, tuple[int, ...]] | None:
        """The best node: its key, the path it leaves, where, and the edges not to take there."""
        while self.queue:
            value, n, place, left_out = heapq.heappop(self.queue)
            path = self.paths[n]
            if place >= 0:
                return -value, path, place, (*left_out, int(path.edges[place]))
            self._split(n, -1 - place, (), -value, True)
        return None


def sample_batch(v: Vocabulary, column: pa.Array, keys: np.ndarray,
                 k: int | np.ndarray) -> list[tuple[int, int, Path, float, Batch]]:
    """(text, rank, path, threshold, batch) for up to k segmentations of each text (k of its own, if an array), best first."""
    batch = Batch.of(v, column, textkit.mix(keys.view(U) + U(SEED * int(_DRAW) & (1 << 64) - 1)))
    n = len(batch.key)
    every = np.arange(len(batch.start))
    text = np.repeat(np.arange(n), np.diff(batch.first))
    number = every - batch.first[text]
    edges, counts = batch.draw(every, batch.start, np.zeros(len(every), np.int64), batch.key[text], number, 1)
    paths = _paths(batch, edges, counts, batch.first)
    searches, out = [Search(batch, int(key)) for key in batch.key], [[p] for p in paths]
    root = -np.log(-np.log(_uniform(batch.key, 0, 1 << 21, 1 << 21)))
    for s, p, score, values in zip(searches, paths, root.tolist(), first_parts(batch, paths, root).tolist()):
        p.score = score
        s.begin(p, values)
    wanted = np.broadcast_to(k, n)
    for turn in range(2, int(wanted.max(initial=0)) + 1):
        popped = [(i, *node) for i, s in enumerate(searches) if wanted[i] >= turn and (node := s.pop())]
        if not popped:
            break
        for (i, value, _, place, left_out), path in zip(popped, _branch(batch, popped, turn)):
            path.score = value
            searches[i].push(path, place, left_out, value)
            out[i].append(path)
    return [(i, r + 1, p, -searches[i].queue[0][0] if searches[i].queue else -np.inf, batch)
            for i in range(n) for r, p in enumerate(out[i])]


def first_parts(batch: Batch, paths: list[Path], limits: np.ndarray) -> np.ndarray:
    """For each text's first path, the keys of the parts that leave it at each of AHEAD places, and of the tail."""
    size = np.array([len(p.edges) for p in paths], np.int64)
    share = np.ones((len(paths), AHEAD))
    for row, p in zip(share, paths):
        row[:min(len(p.edges), AHEAD)] = batch.lattice.prob[p.edges[:AHEAD]]
    logs = np.zeros((len(paths), AHEAD + 1))
    np.cumsum(np.log(share), axis=1, out=logs[:, 1:])
    whole = np.array([p.log_prob for p in paths])
    rest = np.column_stack([1 - share, np.where(size > AHEAD, 1 - np.exp(whole - logs[:, -1]), 0)])
    rest[rest < NOTHING] = 0
    with np.errstate(divide="ignore"):
        mass = logs + np.log(rest)
    u = _uniform(batch.key[:, None], np.arange(AHEAD + 1)[None, :], 1 << 20, 1 << 20)
    return _truncated(mass, limits[:, None], u)


def _paths(batch: Batch, edges: np.ndarray, counts: np.ndarray, first: np.ndarray) -> list[Path]:
    """A path for each run of occurrences."""
    at = np.append(0, np.cumsum(counts))[first]
    logs = np.append(0, np.cumsum(batch.lattice.log[edges]))
    return [Path(edges[a:b], counts[f:g], 0.0, float(logs[b] - logs[a]))
            for a, b, f, g in zip(at, at[1:], first, first[1:])]


def _branch(batch: Batch, popped: list, turn: int) -> list[Path]:
    """For each popped node, its best segmentation: the path up to the place, another edge there, then fresh draws."""
    lat, heads, occ, place, skipped, key, number, firsts = batch.lattice, [], [], [], [], [], [], [0]
    for i, _, path, at, left_out in popped:
        before = np.append(0, np.cumsum(path.counts))
        k = int(np.searchsorted(before, at, side="right")) - 1  # the occurrence of the place
        start = int(lat.to[path.edges[at - 1]]) if at > before[k] else int(batch.start[batch.first[i] + k])
        options = [e for e in range(lat.first[start], lat.first[start + 1]) if e not in left_out]
        share = np.cumsum(lat.prob[options])
        u = _uniform(batch.key[i:i + 1], k, int(at - before[k]) + (1 << 22), turn)[0]
        edge = options[min(int(np.searchsorted(share, u * share[-1])), len(options) - 1)]
        heads.append((path.edges[:at], path.counts[:k], int(at - before[k]), edge))
        rest = np.arange(batch.first[i] + k, batch.first[i + 1])
        begin = batch.start[rest].copy()
        begin[0] = lat.to[edge]
        gone = np.zeros(len(rest), np.int64)
        gone[0] = at - before[k] + 1
        occ.append(rest)
        place.append(begin)
        skipped.append(gone)
        key.append(np.full(len(rest), batch.key[i], U))
        number.append(np.arange(k, k + len(rest)))
        firsts.append(firsts[-1] + len(rest))
    edges, counts = batch.draw(*map(np.concatenate, (occ, place, skipped, key, number)), turn)
    out = []
    for (head, head_counts, inside, edge), tail in zip(heads, _paths(batch, edges, counts, np.array(firsts))):
        mine = tail.counts.copy()
        mine[0] += inside + 1
        whole = np.concatenate([head, [edge], tail.edges])
        log_prob = float(lat.log[whole[:len(head) + 1]].sum()) + tail.log_prob
        out.append(Path(whole, np.append(head_counts, mine), 0.0, log_prob))
    return out


def piece_ids(v: Vocabulary, lattice: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of edges, a piece's id or the ids of the bytes of a spelled character, and how many of each edge."""
    ids = lattice.piece[edges]
    spelled = np.flatnonzero(ids < 0)
    size = np.ones(len(edges), np.int64)
    if not len(spelled):
        return ids, size
    start = lattice.to[edges[spelled]].astype(np.int64) - 1
    # a spelled character starts at its last byte that is no continuation
    while (more := textkit.CONTINUATION[lattice.data[start]]).any():
        start = start - more
    size[spelled] = lattice.to[edges[spelled]] - start
    ids = np.repeat(ids, size)
    ids[ids < 0] = v.byte_ids[lattice.data[textkit.ranges(start, size[spelled])]]
    return ids, size


SAMPLES = ("doc_id bigint, sample int, ids array<int>, n_ids bigint, ids_crc32 bigint, log_prob double, score double, "
           "log_inclusion double, restored boolean")


def _log_inclusion(log_prob: float, threshold: float) -> float:
    gap = log_prob - threshold
    if gap < -30:
        return gap
    return float(np.log(-np.expm1(-np.exp(min(gap, 50.0)))))


def sample_pieces(docs: DataFrame, model: str, k: int | str = K, ids: bool = True) -> DataFrame:
    """Up to k rows a document (k may name a column with a number of each, 1 at least), best first: doc_id, sample (from 1), ids (if asked for), n_ids, their crc32 as
    little-endian unsigned 32-bit integers, log_prob, score (the perturbed log probability), log_inclusion,
    restored (does decoding the ids give the text back)."""
    schema = SAMPLES if ids else SAMPLES.replace("ids array<int>, ", "", 1)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(model)
        keys, column = batch.column(1).to_numpy(), batch.column(2)
        raw, offsets = textkit.utf8(column)
        doc = batch.column(0).to_pylist()
        rows, lists = [], []
        found = sample_batch(v, column, keys, batch.column(3).to_numpy())
        if found:
            lattice = found[0][4].lattice
            flat, sizes = piece_ids(v, lattice, np.concatenate([f[2].edges for f in found]))
            ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(f[2].edges) for f in found]))].tolist()
            little, texts = flat.astype("<u4"), v.decode_all(flat, ends)
            given, at = raw.tobytes(), offsets.tolist()
            for (i, rank, path, threshold, _), a, b, text in zip(found, ends, ends[1:], texts):
                lists.append(flat[a:b])
                rows.append((doc[i], rank, b - a, zlib.crc32(little[a:b]), path.log_prob, path.score,
                             _log_inclusion(path.log_prob, threshold), text == given[at[i]:at[i + 1]]))
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
        if ids:
            first = np.append(0, np.cumsum([len(x) for x in lists]))
            columns.insert(2, textkit.lists(np.concatenate([*lists, np.zeros(0, np.int32)]), first, pa.int32()))
        return pa.RecordBatch.from_arrays(columns, names)

    doc_id = F.col("doc_id").cast("bigint")
    number = F.lit(k) if isinstance(k, int) else F.coalesce(F.col(k), F.lit(1))
    return map_chunks(docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("key"), "text",
                                  number.cast("int").alias("k")), one, schema)
