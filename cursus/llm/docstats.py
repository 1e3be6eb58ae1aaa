"""Counts and shares of whole texts and of their lines, computed for a batch at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import textkit as K

#: Classes of bytes; a byte is of one class.
CLASSES = ("other", "upper", "lower", "digit", "symbol", "shout", "stop", "space", "feed", "continuation")
_OF = np.zeros(256, np.uint8)
_OF[65:91], _OF[97:123], _OF[48:58], _OF[0x80:0xC0] = 1, 2, 3, 9
_OF[list(b"#*$%&|<>")] = 4
_OF[list(b"!?")] = 5
_OF[list(b".,;:")] = 6
_OF[list(b" \t\x0b\x0c\r")] = 7
_OF[10] = 8
REPEAT_WINDOW = 3


@dataclass
class Measured:
    words: K.Words
    lines: K.Lines
    classes: np.ndarray       # bytes by text and class
    hashes: np.ndarray        # of words
    first_line: np.ndarray    # the line of each word
    dup_line: np.ndarray      # per line: equal to an earlier line of its text, and with a word
    twice_line: np.ndarray    # per line: equal to another line of its text, and with a word
    line_words: np.ndarray    # words by line
    repeat_word: np.ndarray   # per word: in a 3-word window found twice or more in its text

    @property
    def n(self) -> int:
        return len(self.words.counts)

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        return K.sums(of_word, self.words.first)

    def per_line(self, of_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.first_line, of_word, minlength=len(self.line_words))


def measure(data: np.ndarray, offsets: np.ndarray) -> Measured:
    words, lines = K.Words(data, offsets), K.Lines(data, offsets)
    n = len(offsets) - 1
    prefix = K.PrefixHash(data)
    hashes = prefix(words.starts, words.ends)
    of_word = np.searchsorted(lines.starts, words.starts, side="right") - 1
    line_words = np.bincount(of_word, minlength=len(lines.starts))
    has_word = line_words > 0
    twice, again = np.zeros((2, len(has_word)), bool)
    at = np.flatnonzero(has_word)
    twice[at], again[at] = K.repeated(prefix(lines.starts[at], lines.ends[at]), lines.text[at])

    windows, before = K.shingles(hashes, words.first, REPEAT_WINDOW)
    text = np.repeat(np.arange(n), np.diff(before))
    found = np.flatnonzero(K.repeated(windows, text)[0])
    # a window's place among words: its place among windows, moved on by the words without a window before it
    start = found + (words.first[:-1] - before[:-1])[text[found]]
    cover = np.zeros(len(hashes), bool)
    for k in range(REPEAT_WINDOW):
        cover[start + k] = True

    kinds = len(CLASSES)
    size = np.diff(offsets)
    key = np.repeat(np.arange(n, dtype=np.int64) * kinds, size)
    key += _OF[data]
    classes = np.bincount(key, minlength=n * kinds).reshape(n, kinds)
    return Measured(words, lines, classes, hashes, of_word, again, twice, line_words, cover)


def base_rules(m: Measured) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    chars = m.classes.sum(1) - m.classes[:, CLASSES.index("continuation")]
    blank = m.classes[:, CLASSES.index("space")] + m.classes[:, CLASSES.index("feed")]
    return {"n_words": m.words.counts, "word_chars": chars - blank, "n_symbols": m.classes[:, CLASSES.index("symbol")],
            "n_dup_lines": K.sums(m.dup_line, m.lines.first), "n_repeat_words": m.per_text(m.repeat_word)}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


STATISTICS = ("log_words", "word_chars", "symbols", "upper", "digits", "shouts", "stops", "dup_lines", "twice_lines",
              "repeat_words", "distinct_words", "echo_words", "words_a_line", "long_lines", "wordless", "log_longest",
              "short_words", "beyond_ascii", "upper_words", "symbol_words", "log_lines")


def statistics(m: Measured) -> np.ndarray:
    """The document statistics of each text, a column for each of STATISTICS; zeros without words."""
    base, c = base_rules(m), {k: m.classes[:, j].astype(float) for j, k in enumerate(CLASSES)}
    n, data = m.words.counts.astype(float), m.words.data
    chars = np.maximum(m.classes.sum(1) - c["continuation"], 0)
    length = m.words.ends - m.words.starts
    distinct = ~K.repeated(m.hashes, m.words.text)[1]
    echo = np.zeros(len(m.hashes), bool)
    echo[1:] = (m.hashes[1:] == m.hashes[:-1])
    starts = m.words.first[:-1][m.words.counts > 0]
    echo[starts] = False
    kind = _OF[data]
    total = {k: np.concatenate([[0], np.cumsum(kind == j)]) for j, k in enumerate(CLASSES) if k in ("upper", "lower", "symbol")}
    of = {k: t[m.words.ends] - t[m.words.starts] for k, t in total.items()}
    lines = K.sums(m.line_words > 0, m.lines.first).astype(float)
    longest = np.zeros(m.n)
    if len(length):
        np.maximum.at(longest, m.words.text, length)
    return np.column_stack([
        np.log1p(n), _ratio(base["word_chars"], n), _ratio(c["symbol"], chars), _ratio(c["upper"], c["upper"] + c["lower"]),
        _ratio(c["digit"], chars), _ratio(c["shout"], chars), _ratio(c["stop"], chars),
        _ratio(base["n_dup_lines"], lines), _ratio(K.sums(m.twice_line, m.lines.first), lines),
        _ratio(base["n_repeat_words"], n), _ratio(m.per_text(distinct), n), _ratio(m.per_text(echo), n), _ratio(n, lines),
        _ratio(K.sums(m.line_words >= 20, m.lines.first), lines),
        _ratio(m.per_text((of["upper"] + of["lower"]) == 0), n), np.log1p(longest), _ratio(m.per_text(length <= 3), n),
        _ratio(c["continuation"], chars), _ratio(m.per_text((of["upper"] >= 2) & (of["lower"] == 0)), n),
        _ratio(m.per_text(of["symbol"] > 0), n), np.log1p(lines)])


def byte_class(data: np.ndarray) -> np.ndarray:
    """The index in CLASSES of each byte."""
    return _OF[data]
