"""Spelling variants: words at one edit from each other, by composing finite-state machines.

The vocabulary is compiled into a minimal acceptor V. The composition V o T o V
with a transducer T that makes exactly one edit (a symbol put in, taken out or
replaced) accepts the pairs of words that are near. A path of it first copies
symbols, with both acceptors in one state, then makes its edit, then copies on,
with the acceptors in two states; where the two are the same state, all that
follows is accepted on both sides, and the search ends.

No acceptor holds the whole vocabulary. The composition is cut by initial
states: words that share their first FRONT symbols are one partition, whose
paths start behind them, so the edit comes later. An edit within the first FRONT
symbols leaves the last BACK symbols alone; those pairs are found in the same
way among reversed words, and kept only if the first FRONT symbols differ, so
each pair is found once. A state with more words behind it than ``most`` is
no initial state: the arcs out of it lead to the next ones, and the edits made
in the state itself are found by Spark, since what follows such an edit is
equal: a group by (state, what follows) holds at most one word a symbol, and
one more. So a task holds a bounded piece of the vocabulary, whatever a
prefix's share.

Pairs are never listed: a task gives each word its number of near words and
the most frequent one.

Cases: a null text has no words; a null doc_id hashes as the empty text; empty
tables give no rows; repeated rows count as often as they stand; words may be as
long as a text; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import give_back, map_chunks, written

SHORTEST = 7        # code points of a word
OCCURRENCES = 2     # of a word, overall
RATIO = 10          # a form occurs so many times as often
DAMAGED = 31        # one in so many occurrences loses a code point
FRONT, BACK = 3, 4  # symbols before an initial state; FRONT + BACK <= SHORTEST
MOST = 1 << 16      # words behind an initial state
SHARE = 256         # ... and at most this part of the vocabulary
DEPTHS = 8          # prefix lengths counted at a time
BATCH = 1 << 15     # words compiled into one acceptor, at least one initial state's
SLICE = 1 << 20     # rows of a composition step taken at a time
BYTEWISE = 64       # words of more bytes are hashed one by one

U = np.uint64

_LETTERS = textkit._bytes_table(bytes(range(65, 91)) + bytes(range(97, 123)) + b"\xc3")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _crc32(seeds: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of byte ranges, each carried on from its seed."""
    state = seeds ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(sizes, BYTEWISE + 1), kind="stable")
    long = int(np.count_nonzero(sizes > BYTEWISE))
    for k in order[:long]:
        state[k] = zlib.crc32(data[starts[k]:starts[k] + sizes[k]].tobytes(), int(seeds[k])) ^ 0xFFFFFFFF
    order = order[long:]
    s, at, left = state[order], starts[order], sizes[order]
    for pos in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -pos, side="left"))  # the first m words are longer than pos
        s[:m] = _CRC[(s[:m] ^ data[at[:m] + pos]) & np.uint32(255)] ^ (s[:m] >> np.uint32(8))
    state[order] = s
    return state ^ np.uint32(0xFFFFFFFF)


def _words(ids: pa.Array, column: pa.Array, damaged: int, shortest: int) -> pa.Array:
    """All words of a batch, lower-cased, damaged, as Latin-1 bytes."""
    data, offsets = textkit.utf8(column)
    inside = _LETTERS[data]
    inside[1:] |= data[:-1] == 0xC3  # always two bytes, U+00C0 to U+00FF
    starts, ends = textkit.runs(inside, offsets)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0xC3, out=marks[1:])
    length = ends - starts - (marks[ends] - marks[starts])
    fit = length >= shortest
    starts, ends, length = starts[fit], ends[fit], length[fit]
    data = textkit.LOWER[data]
    flat = data[textkit.ranges(starts, ends - starts)]
    lead = flat == 0xC3
    after = np.zeros(len(flat), bool)
    after[1:] = lead[:-1]
    flat[after] |= 0xC0
    flat = flat[~lead]
    before = np.cumsum(length) - length
    if damaged and len(length):
        text = np.searchsorted(offsets, starts, side="right") - 1
        seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
        h = _crc32(seeds[text], data, starts, ends - starts).astype(np.int64)
        hit = np.flatnonzero(h % damaged == 0)
        keep = np.ones(len(flat), bool)
        keep[before[hit] + h[hit] % length[hit]] = False
        flat = flat[keep]
        length[hit] -= 1
    first = np.append(0, np.cumsum(length))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length),
                                             [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    return words.filter(pa.array(length >= shortest))


def count_words(docs: DataFrame, damaged: int = DAMAGED, shortest: int = SHORTEST, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n for every word with at least ``occurrences``; counted per slice of texts before the shuffle."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _words(batch.column(0), batch.column(1), damaged, shortest).value_counts()
        words = [w.decode("latin-1") for w in found.field(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), found.field(1).cast(pa.int64())], ["word", "n"])

    rows = docs.select("doc_id", "text")
    return map_chunks(rows, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Acceptor:
    """The minimal acceptor of sorted, distinct strings in groups, one initial state a group.

    States are the distinct languages behind the nodes of a trie, told apart by
    a 64-bit hash and then compared. ``below`` counts a state's strings, and an
    arc's ``skip`` those that come before its own, so a path adds up to the
    number of its string.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, group: np.ndarray):
        n, sizes = len(first) - 1, np.diff(first)
        lcp = self._common(data, first, group)
        # the trie, depth by depth; a node is new where a string leaves the one before
        at, node = np.arange(n), np.cumsum(lcp < 0) - 1
        total = int(node[-1]) + 1 if n else 0
        self.initial = np.arange(total)
        levels, parents, labels = [(0, total)], [], []
        final = [np.bincount(node[sizes == 0], minlength=total) > 0]
        below = [np.bincount(node, minlength=total)]
        depth = 0
        while True:
            depth += 1
            deep = sizes[at] >= depth
            at, up = at[deep], node[deep]
            if not len(at):
                break
            new = lcp[at] < depth
            node = total + np.cumsum(new) - 1
            parents.append(up[new])
            labels.append(data[first[at[new]] + depth - 1])
            count = int(node[-1]) + 1 - total
            final.append(np.bincount(node[sizes[at] == depth] - total, minlength=count) > 0)
            below.append(np.bincount(node - total, minlength=count))
            levels.append((total, total + count))
            total += count
        self.final, self.below = np.concatenate(final), np.concatenate(below)
        parent = np.concatenate([np.full(levels[0][1], -1), *parents]).astype(np.int64)
        label = np.concatenate([np.zeros(levels[0][1], np.uint8), *labels])
        language = np.where(self.final, U(0x9E3779B97F4A7C15), U(0x2545F4914F6CDD1D))
        for lo, hi in reversed(levels[1:]):
            arcs = textkit.mix(textkit.mix(language[lo:hi]) + (label[lo:hi].astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
            ends = np.flatnonzero(np.append(parent[lo + 1:hi] != parent[lo:hi - 1], True))
            language[parent[lo:hi][ends]] += np.add.reduceat(arcs, np.append(0, ends[:-1] + 1))
        _, sample, state = np.unique(language, return_index=True, return_inverse=True)
        # arcs of nodes: a node's children follow each other
        child = np.arange(levels[0][1], total)
        begin = np.searchsorted(parent[child], np.arange(total + 1)) if total else np.zeros(1, np.int64)
        degree = np.diff(begin)
        self._same(sample[state], degree, begin, child, label, state)
        self.final, self.below = self.final[sample], self.below[sample]
        self.degree = degree[sample]
        rows = textkit.ranges(begin[sample], self.degree)
        self.begin = np.append(0, np.cumsum(self.degree))
        self.label, self.target = label[child[rows]].astype(np.int64), state[child[rows]]
        self.source = np.repeat(np.arange(len(sample)), self.degree)
        run = np.append(0, np.cumsum(self.below[self.target]))
        self.skip = run[:-1] - run[self.begin[:-1]][self.source] + self.final[self.source]
        self.arcs = self.source * 256 + self.label
        self.initial = state[self.initial]

    @staticmethod
    def _common(data: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Symbols that each string shares with the one before; -1 for the first of a group."""
        n, sizes = len(first) - 1, np.diff(first)
        lcp = np.full(n, -1, np.int64)
        same = np.flatnonzero(group[1:] == group[:-1]) + 1
        lcp[same], depth = 0, 0
        while len(same):
            same = same[(sizes[same] > depth) & (sizes[same - 1] > depth)]
            same = same[data[first[same] + depth] == data[first[same - 1] + depth]]
            depth += 1
            lcp[same] = depth
        return lcp

    @staticmethod
    def _same(like, degree, begin, child, label, state) -> None:
        """Nodes of one state must have the same arcs: a check on the hashes."""
        if (degree[like] != degree).any():
            raise ArithmeticError("two languages share a hash")
        mine = child[textkit.ranges(begin[:-1], degree)]
        other = child[textkit.ranges(begin[like], degree)]
        if (label[mine] != label[other]).any() or (state[mine] != state[other]).any():
            raise ArithmeticError("two languages share a hash")

    def _follow(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The arc of each state with a label, or -1."""
        if not len(self.arcs):
            return np.full(len(states), -1)
        want = states * 256 + labels
        k = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
        return np.where(self.arcs[k] == want, k, -1)

    def near_pairs(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the two strings of each accepted pair, once each; ``starts`` are the numbers of the groups' first strings."""
        state, rank = self.initial, starts
        while True:
            some = self.below[state] > 1
            state, rank = state[some], rank[some]
            if not len(state):
                return
            # rows that a step makes of each state: pairs of arcs, and arcs against the state
            cost = np.cumsum(self.degree[state] * (self.degree[state] + 1))
            lo = 0
            while lo < len(state):
                hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + SLICE, side="right")))
                yield from self._replaced(state[lo:hi], rank[lo:hi])
                yield from self._taken_out(state[lo:hi], rank[lo:hi])
                lo = hi
            d = self.degree[state]
            arc = textkit.ranges(self.begin[state], d)
            state, rank = self.target[arc], np.repeat(rank, d) + self.skip[arc]

    def _replaced(self, state, rank):
        """Two arcs out of one state."""
        d = self.degree[state]
        arc, base, end = textkit.ranges(self.begin[state], d), np.repeat(rank, d), np.repeat(self.begin[state] + d, d)
        later = end - arc - 1
        a = np.repeat(arc, later)
        b = textkit.ranges(arc + 1, later)
        base = np.repeat(base, later)
        yield from self._matched(self.target[a], self.target[b], base + self.skip[a], base + self.skip[b])

    def _taken_out(self, state, rank):
        """An arc that only the longer string takes; what comes next in the shorter one differs from it, so a pair is found once."""
        d = self.degree[state]
        arc, base, state = textkit.ranges(self.begin[state], d), np.repeat(rank, d), np.repeat(state, d)
        left, gone = self.target[arc], self.label[arc]
        both = self.final[left] & self.final[state]
        yield (base + self.skip[arc])[both], base[both]
        yield from self._matched(*self._step(left, state, base + self.skip[arc], base, gone))

    def _step(self, left, right, i, j, but=None):
        """Both sides take an arc of one label, other than ``but``."""
        d = self.degree[left]
        a = textkit.ranges(self.begin[left], d)
        right, i, j = np.repeat(right, d), np.repeat(i, d), np.repeat(j, d)
        b = self._follow(right, self.label[a])
        ok = b >= 0
        if but is not None:
            ok &= self.label[a] != np.repeat(but, d)
        a, b = a[ok], b[ok]
        return self.target[a], self.target[b], i[ok] + self.skip[a], j[ok] + self.skip[b]

    def _matched(self, left, right, i, j):
        """Strings that both states accept."""
        while len(left):
            same = left == right
            if same.any():
                n = self.below[left[same]]
                yield textkit.ranges(i[same], n), textkit.ranges(j[same], n)
                left, right, i, j = left[~same], right[~same], i[~same], j[~same]
            both = self.final[left] & self.final[right]
            if both.any():
                yield i[both], j[both]
            fewer = self.degree[left] <= self.degree[right]
            a, b = np.where(fewer, left, right), np.where(fewer, right, left)
            i, j = np.where(fewer, i, j), np.where(fewer, j, i)
            left, right, i, j = self._step(a, b, i, j)


NEAR = "word string, n_near bigint, best_n bigint, best string"
_DEALT = "fork boolean, side tinyint, key string, rest string, symbol string, word string, n bigint"


def _near(side: np.ndarray, keys: list[str], words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """Near words among rows sorted by side and key, for each word that has some."""
    rest = [(w[::-1] if s else w)[len(k):].encode("latin-1") for s, k, w in zip(side.tolist(), keys, words)]
    starts = np.array([0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or side[k] != side[k - 1])])
    group = np.zeros(len(keys), np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    order = np.array(sorted(range(len(keys)), key=lambda k: (group[k], rest[k])))
    side, n = side[order], n[order]
    words, rest = [words[k] for k in order], [rest[k] for k in order]
    front = np.array([w[:FRONT] for w in words])
    acceptor = Acceptor(np.frombuffer(b"".join(rest), np.uint8), np.append(0, np.cumsum([len(r) for r in rest])).astype(np.int64), group)
    place = np.empty(len(words), np.int64)
    ranked = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])))
    place[ranked] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for i, j in acceptor.near_pairs(starts):
        new = (side[i] == 0) | (front[i] != front[j])
        i, j = i[new], j[new]
        count += np.bincount(i, minlength=len(words)) + np.bincount(j, minlength=len(words))
        np.minimum.at(best, i, place[j])
        np.minimum.at(best, j, place[i])
    found = np.flatnonzero(count)
    most = ranked[best[found]]
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in found], pa.string()), pa.array(count[found]), pa.array(n[most]),
                                       pa.array([words[k] for k in most], pa.string())], ["word", "n_near", "best_n", "best"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (side, key, word, n) sorted by side and key, compiled some initial states at a time."""
    side, keys, words, n = [], [], [], []
    for b in batches:
        for s, k, w, c in zip(*(b.column(x).to_pylist() for x in range(4))):
            if len(keys) >= BATCH and (k != keys[-1] or s != side[-1]):
                yield _near(np.array(side), keys, words, np.array(n))
                side, keys, words, n = [], [], [], []
            side.append(s)
            keys.append(k)
            words.append(w)
            n.append(c)
    if keys:
        yield _near(np.array(side), keys, words, np.array(n))
    give_back()


def _sides(words: DataFrame) -> DataFrame:
    """Each word as it is read from its start (side 0) and from its end (side 1)."""
    return words.select("n", "word", F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("side"), F.col("word").alias("read")),
                                                       F.struct(F.lit(1).cast("tinyint").alias("side"), F.reverse("word").alias("read")))).alias("s")
                        ).select("n", "word", "s.side", "s.read")


def _crowded(words: DataFrame, most: int, share: int) -> set[tuple[int, str]]:
    """States (side, prefix) with more words than an initial state may have; at most max(share, words / most) for each length."""
    total = words.count()
    limit = min(most, max(64, total // share))
    shortest = F.when(F.col("side") == 0, FRONT).otherwise(BACK)
    found, base = set(), 0
    while True:
        lengths = F.sequence(shortest + base, F.least(shortest + base + DEPTHS - 1, F.length("read")))
        prefixes = (_sides(words).where(F.length("read") >= shortest + base)
                    .select("side", F.explode(lengths).alias("k"), "read").select("side", "k", F.expr("left(read, k)").alias("key")))
        rows = prefixes.groupBy("side", "k", "key").count().where(F.col("count") > limit).select("side", "k", "key").collect()
        found |= {(r.side, r.key) for r in rows}
        base += DEPTHS
        if not any(r.k == (BACK if r.side else FRONT) + base - 1 for r in rows):
            return found


def _deal(words: DataFrame, crowded: set[tuple[int, str]]) -> DataFrame:
    """Each word's row at its initial state, and two at each crowded state before: with and without the symbol taken there."""
    def deal(batches):
        for b in batches:
            out = [[] for _ in range(7)]

            def add(*row):
                for column, value in zip(out, row):
                    column.append(value)

            for n, word, side, read in zip(*(b.column(x).to_pylist() for x in range(4))):
                k = BACK if side else FRONT
                while (side, read[:k]) in crowded and len(read) >= k:
                    key = read[:k]
                    add(True, side, key, read[k:], None, word, n)
                    if len(read) == k:
                        break
                    add(True, side, key, read[k + 1:], read[k], word, n)
                    k += 1
                else:
                    add(False, side, read[:k], None, None, word, n)
            types = [pa.bool_(), pa.int8(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             ["fork", "side", "key", "rest", "symbol", "word", "n"])
    return _sides(words).mapInArrow(deal, _DEALT)


def _forks(dealt: DataFrame) -> DataFrame:
    """Near words whose edit is made in a crowded state: their rests are equal, at most one word a symbol and one without."""
    members = F.collect_list(F.struct("n", "word", "symbol"))
    groups = dealt.where("fork").groupBy("side", "key", "rest").agg(members.alias("all")).where(F.size("all") > 1)

    def apart(me, other):
        """Two symbols replace each other; one that is taken out differs from what follows it."""
        follows = F.left(F.col("rest"), F.lit(1))
        one = F.coalesce(me["symbol"], other["symbol"])
        fits = (me["word"] != other["word"]) & ((me["symbol"].isNotNull() & other["symbol"].isNotNull()) | (one != follows))
        return fits & ((F.col("side") == 0) | (F.left(me["word"], F.lit(FRONT)) != F.left(other["word"], F.lit(FRONT))))

    each = groups.select("side", "rest", "all", F.explode("all").alias("me"))
    near = each.select("me", F.filter("all", lambda o: apart(F.col("me"), o)).alias("near")).where(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda o: F.struct((-o["n"]).alias("n"), o["word"].alias("word"))))
    return (near.select(F.col("me.word").alias("word"), F.size("near").cast("bigint").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")))


def near_words(words: DataFrame, most: int = MOST, share: int = SHARE) -> DataFrame:
    """word, n_near, best_n, best (the most frequent near word, then the smallest) for the distinct words (word, n) that have near ones.

    Words consist of code points below 256, SHORTEST of them at least.
    """
    dealt = _deal(words, _crowded(words, most, share))
    dealt = written(dealt, "variants-dealt")
    groups = dealt.where("not fork").select("side", "key", "word", "n").repartition("side", "key").sortWithinPartitions("side", "key")
    parts = groups.mapInArrow(_composed, NEAR).unionByName(_forks(dealt))
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return (parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best"))


def group_variants(docs: DataFrame, ratio: int = RATIO, damaged: int = DAMAGED, most: int = MOST, share: int = SHARE) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the documents.

    The form is the most frequent near word if it occurs ``ratio`` times as often or more; the root is reached by
    following forms. ``damaged`` takes a code point out of one in so many occurrences, by their hash (0: of none).
    """
    vocabulary = written(count_words(docs, damaged), "variants-words")
    found = vocabulary.join(near_words(vocabulary, most, share), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = written(found.select("word", F.when(is_form, F.col("best")).alias("form"), "n",
                                 F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                 F.when(is_form, F.col("best_n")).alias("form_n")), "variants-forms")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    # occurrences grow by the ratio with each step, so paths are short; each round doubles the steps taken
    while True:
        roots = written(roots, "variants-roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(onward, "root", "left_semi").head(1):
            break
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return (found.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def variants_sql(damaged: int = DAMAGED, ratio: int = RATIO) -> str:
    """DuckDB SQL for ``group_variants`` over ``documents``, by words with one symbol left out."""
    return f"""
WITH RECURSIVE crc_steps AS (
  SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')) AS w FROM documents),
lowered AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM found GROUP BY 1, 2),
hashed AS (
  SELECT w, c, length(w) AS l, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)),
      lambda a, b: xor(list_extract(t, (xor(a, b) & 255) + 1), a >> 8)), 4294967295) AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM lowered), crc),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {damaged} = 0 THEN substr(w, 1, (h % l)::BIGINT) || substr(w, (h % l)::BIGINT + 2) ELSE w END AS word, c FROM hashed)
  WHERE length(word) >= {SHORTEST} GROUP BY 1 HAVING sum(c) >= {OCCURRENCES}),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY 1),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN other END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
paths AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT p.word, f.word, f.form FROM paths p JOIN forms f ON p.next = f.word)
SELECT f.word, f.form, p.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN paths p ON p.word = f.word AND p.next IS NULL"""
