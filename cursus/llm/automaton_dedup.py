"""Removal of passages that stand in an earlier document, by suffix automata over words.

A window is SPAN consecutive words. A word is removed if a window that covers
it has a word sequence that also starts in a document with a smaller doc_id.

Reference text for all of a corpus is as large as the corpus, so no automaton
over it can be broadcast. It is cut into shards that meet the documents by a
shuffle instead. Each window has an anchor, the least of its word GRAM hashes,
which depends on the window's words alone; the windows of a text that share one
anchor place form a context. Equal windows have equal anchors, so only contexts
of the same anchor need be compared, and only of anchors that occur in several
documents. A shard is the distinct contexts of an anchor in the order of their
smallest doc_id: each is streamed through the suffix automaton of those before
it, its matching statistics tell for each window whether an earlier document
has it and which is the first, and a context with new windows extends the
automaton. The windows of anchors with more than CONTEXTS distinct contexts
(passages with many surroundings) are grouped by their own hash instead, which
has no group to hold. Both ways are exact but for collisions of 64-bit hashes.

Cases: a null or empty text has no words and loses none; a null doc_id is
neither smaller nor larger than any, its document is left alone and no
reference; rows of equal doc_id don't affect each other, repeated rows get
equal results; texts are handled whole; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import give_back, map_chunks, written

SPAN, GRAM = 50, 10
CONTEXTS = 1_024  # of a shard, at most; about 70 words each

U = np.uint64


def window_anchors(hashes: np.ndarray, first: np.ndarray, span: int, gram: int):
    """Contexts of a batch: anchor hash, text, first and last window start (word places in the text).

    A window's anchor is its last least gram; windows of one anchor place stand
    side by side.
    """
    grams, before = textkit.shingles(hashes, first, gram)
    width = span - gram + 1
    least, at, reach = grams, np.arange(len(grams)), 1
    while reach < width:  # least[i] over grams i .. i + reach - 1; double the reach
        step = min(reach, width - reach)
        if len(least) <= step:
            break
        later = least[step:]
        take = later <= least[:-step]
        at = np.where(take, at[step:], at[:-step])
        least = np.where(take, later, least[:-step])
        reach += step
    counts = np.diff(before)
    windows = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = at[before[text] + start] if len(text) else at[:0]
    new = np.ones(len(text), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(text))[:len(a)] - 1
    return grams[place[a]], text[a], start[a], start[b]


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of word ranges, from prefix sums of a polynomial of word hashes."""
    up, down = textkit.powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return textkit.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


class Automaton:
    """A suffix automaton of word sequences, added in the order of their documents.

    ``doc`` is the first document of a state's sequences: it stays what it was
    at the state's birth, since later sequences come from later documents.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [0]

    def _state(self, length: int, doc: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.doc.append(doc)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the shorter sequences of q that end in p's and c."""
        clone = self._state(self.length[p] + 1, self.doc[q], self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], doc: int) -> None:
        follow, length, link = self.next, self.length, self.link
        last = 0
        for c in words:
            q = follow[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(length[last] + 1, doc, {}, 0), last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def first_docs(self, words: list[int], span: int) -> list[int | None]:
        """For each window of the words, the first document that has it, or None: the matching statistics, cut at span."""
        follow, length, link = self.next, self.length, self.link
        state = matched = 0
        out = []
        for k, c in enumerate(words):
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            if c in follow[state]:
                state = follow[state][c]
                matched += 1
            if matched >= span:
                matched = span
                while length[link[state]] >= span:
                    state = link[state]
            if k >= span - 1:
                out.append(self.doc[state] if matched == span else None)
        return out


def first_documents(contexts: list[tuple[int, list[int]]], span: int) -> list[list[int]]:
    """For each (document, words) in the order of documents, the first document of each window."""
    automaton, out = Automaton(), []
    for doc, words in contexts:
        found = automaton.first_docs(words, span)
        if None in found:
            automaton.add(words, doc)
        out.append([doc if d is None else d for d in found])
    return out


ANCHORS = "doc_id bigint, tid bigint, anchor bigint, context bigint, s1 int, s2 int"
CONTENTS = "anchor bigint, context bigint, doc bigint, words binary"
FIRSTS = "anchor bigint, context bigint, firsts array<bigint>"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def _anchors(span: int, gram: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = textkit.Words(*textkit.utf8(batch.column(2)))
        hashes = words.hashes()
        anchor, text, s1, s2 = window_anchors(hashes, words.first, span, gram)
        lo = words.first[text] + s1
        context = range_hashes(hashes, lo, words.first[text] + s2 + span)
        at = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)),
             pa.array(context.view(np.int64)), pa.array(s1.astype(np.int32)), pa.array(s2.astype(np.int32))],
            ["doc_id", "tid", "anchor", "context", "s1", "s2"])
    return one


def _contents(span: int):
    """The words of the contexts that a text provides."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = textkit.Words(*textkit.utf8(batch.column(1)))
        raw = words.hashes().view(np.int64)
        rows = [(c["anchor"], c["context"], doc, raw[f + c["s1"]:f + c["s2"] + span].tobytes())
                for doc, f, given in zip(batch.column(0).to_pylist(), words.first.tolist(), batch.column(2).to_pylist())
                for c in given]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            ["anchor", "context", "doc", "words"])
    return one


def _shards(span: int):
    """Partitions sorted by anchor and document, anchor by anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, {}

        def finish() -> pa.RecordBatch:
            contexts = [(doc, np.frombuffer(w, np.int64).tolist()) for doc, w in held.values()]
            firsts = first_documents(contexts, span)
            return pa.RecordBatch.from_arrays(
                [pa.array([anchor] * len(held), pa.int64()), pa.array(list(held), pa.int64()),
                 pa.array(firsts, pa.list_(pa.int64()))], ["anchor", "context", "firsts"])

        for b in batches:
            for a, c, doc, w in zip(*(b.column(k).to_pylist() for k in range(4))):
                if a != anchor:
                    if held:
                        yield finish()
                    anchor, held = a, {}
                held.setdefault(c, (doc, w))  # repeated rows of a provider give a context twice
        if held:
            yield finish()
        give_back()
    return run


def _windows(span: int):
    """A row for each window of a context: its hash and place."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [np.frombuffer(w, U) for w in batch.column(3).to_pylist()]
        size = np.array([len(w) for w in raw], np.int64)
        n = size - span + 1
        row = np.repeat(np.arange(len(raw)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        flat = np.concatenate([*raw, np.zeros(0, U)])
        lo = (np.cumsum(size) - size)[row] + k
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(range_hashes(flat, lo, lo + span).view(np.int64)), *[batch.column(j).take(at) for j in range(3)],
             pa.array(k.astype(np.int32))], ["window", "anchor", "context", "doc", "k"])
    return one


def _keep(span: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digest, kept = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()  # at the same six characters as textkit.SPACE
            left = words
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["a"]] += 1
                    edge[s["b"] + span] -= 1
                left = [w for w, c in zip(words, np.cumsum(edge).tolist()) if not c]
            joined = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()),
             pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return one


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, contexts: int = CONTEXTS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one blank)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    anchors = written(map_chunks(texts.where(F.col("doc_id").isNotNull()), _anchors(span, gram), ANCHORS), "anchors")
    several = written(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                      .where("lo < hi").select("anchor"), "anchors-of-several")  # so that Spark can split a hot anchor's join
    rows = written(anchors.join(several, "anchor"), "repeated-anchors")

    # distinct contexts, each with a document that provides its words
    distinct = rows.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "tid", "s1", "s2")).alias("p"))
    sizes = written(distinct.groupBy("anchor").agg(F.count("*").alias("n")), "contexts-of-anchors")
    distinct = written(distinct.join(sizes, "anchor").select("anchor", "context", "n", "p.*"), "contexts")
    given = (distinct.where("n > 1").groupBy("doc_id", "tid")
             .agg(F.collect_list(F.struct("anchor", "context", "s1", "s2")).alias("given")))  # of one text: bounded by it
    contents = (texts.join(given, ["doc_id", "tid"]).select("doc_id", "text", "given"))
    contents = written(map_chunks(contents, _contents(span), CONTENTS), "context-words")
    small = sizes.where((F.col("n") > 1) & (F.col("n") <= contexts)).select("anchor")
    large = sizes.where(F.col("n") > contexts).select("anchor")

    shards = contents.join(small, "anchor", "left_semi").repartition("anchor").sortWithinPartitions("anchor", "doc", "context")
    by_automaton = shards.mapInArrow(_shards(span), FIRSTS)
    windows = map_chunks(contents.join(large, "anchor", "left_semi"), _windows(span),
                         "window bigint, anchor bigint, context bigint, doc bigint, k int", text="words").distinct()
    by_hash = (windows.join(windows.groupBy("window").agg(F.min("doc").alias("least")), "window")
               .groupBy("anchor", "context").agg(F.array_sort(F.collect_set(F.struct("k", "least"))).alias("w"))
               .select("anchor", "context", F.col("w.least").alias("firsts")))  # of one context: about SPAN - GRAM windows
    known = by_automaton.unionByName(by_hash)

    # an anchor with one context repeats it whole
    alone = (rows.join(distinct.where("n = 1").select("anchor", F.col("doc_id").alias("least")), "anchor")
             .where("least < doc_id").select("doc_id", "tid", F.array(F.struct(F.col("s1").alias("a"), F.col("s2").alias("b"))).alias("w")))
    seen = F.transform("firsts", lambda d, k: F.when(d < F.col("doc_id"), F.struct((F.col("s1") + k).alias("a"), (F.col("s1") + k).alias("b"))))
    mixed = (rows.join(known, ["anchor", "context"])
             .select("doc_id", "tid", F.filter(seen, lambda x: x.isNotNull()).alias("w")).where(F.size("w") > 0))
    spans = alone.unionByName(mixed).groupBy("doc_id", "tid").agg(F.collect_set("w").alias("w"))  # of one text
    marked = texts.join(spans.select("doc_id", "tid", F.flatten("w").alias("spans")), ["doc_id", "tid"], "left")
    return map_chunks(marked.select("doc_id", "text", "spans"), _keep(span), RESULT)


def removal_sql(span: int = SPAN) -> str:
    """DuckDB SQL of remove_repeats without the texts, by a table of all windows; for tables with distinct ids."""
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {span - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {span - 1})) AS i FROM words)),
first AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(generate_series(0, {span - 1})) AS p
  FROM windows JOIN first USING (s) WHERE m < doc_id),
marked AS (
  SELECT x.doc_id, x.p, x.word, g.p IS NULL AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE kept), '')) AS kept_sha256
FROM words w LEFT JOIN marked m ON m.doc_id = w.doc_id GROUP BY w.doc_id, len(w.w)
"""
