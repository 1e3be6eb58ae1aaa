"""Personal data, plain and disguised, with spans in the source text.

``find`` returns spans (kind, start, end) in code points. Plain identifiers are
found in the source as it stands. For the disguised ones a chain of
transducers rewrites the text: homoglyphs to ASCII and invisible characters to
nothing, bracketed or spelled "at" and "dot" to their signs, runs of spelled
digits to digits. The same detectors then read the rewritten text, and spans
map back through the chain to source characters. A disguised span is added
where the text it covers differs from what was detected and where it is not
part of a plain span; plain spans always stay.

A run of spelled digits of any words is rewritten if a detector takes it with
the digits beside it. Out of reach are digits spelled without blanks, in other
languages or as larger numbers ("eleven"), doubled digits ("double five"),
commas beside numbers in runs of fewer than four words, short runs behind or
before what is an identifier without them, and runs that a further digit beside
them makes too long or wrong by Luhn.

A bare "at" counts between a local part and a domain whose dots are plain or
disguised. Between "at" and a domain with plain dots the word before must not
be one that goes before a place (NOT_LOCAL: "meet us at example.com"), so a
local part that is such a word, or a number of up to four digits, is out of
reach. So are further endings than ENDINGS, MORE_ENDINGS and those of two letters (plain
dots behind "arroba" and its like take any), endings that are words behind
"point" unless the local part has a sign or digit, "at" before a determiner and
an unlisted ending, capitalized endings and code files' endings behind plain
dots, and "at" or "dot" in other languages than the four.

Cases: a null or empty text has no spans; spans of one kind never overlap among
the plain ones; texts of any length are read whole, in linear time; empty
tables and other columns are fine; repeated rows give repeated results.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .shared import map_chunks

KINDS = ("email", "ip", "card", "phone")

# -- plain identifiers ---------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is tried from its first digit only: a try from within it would end at the same character.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[@0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @ signs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    """Spans of plain identifiers, by start, then kind as listed."""
    out = []
    if not _ANY.search(text):
        return out
    out += [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


# -- transducers -----------------------------------------------------------------

#: Characters that look like an ASCII letter or sign, each followed by that sign.
HOMOGLYPHS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "А": "A",
    "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ј": "J", "Ѕ": "S", "З": "3", "з": "3", "б": "6",
    # Greek
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n",
    "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Latin letters and signs
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "․": ".", "。": ".", "．": ".", "｡": ".", "﹒": ".", "·": ".",
    "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "﹢": "+",
}
#: Characters without a width.
INVISIBLE = "­​‌‍⁠﻿"


def _look_alikes() -> dict[str, str]:
    table = {c: "" for c in INVISIBLE} | HOMOGLYPHS
    table |= {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}  # full-width forms
    for start in range(0x1D400, 0x1D6A4, 52):  # mathematical alphabets: 26 capitals, 26 small letters each
        table |= {chr(start + k): chr((65 if k < 26 else 71) + k) for k in range(52)}
    for start in range(0x1D7CE, 0x1D800, 10):  # mathematical digits
        table |= {chr(start + k): chr(48 + k) for k in range(10)}
    table |= {chr(0x2080 + k): chr(48 + k) for k in range(10)}  # subscripts
    table |= {c: str(k) for k, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")}
    table |= {chr(start + k): chr(48 + k) for start in (0x660, 0x6F0, 0x966) for k in range(10)}
    return table


LOOK_ALIKES = _look_alikes()
_LOOK_ALIKE = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + "]")
#: All of them lie here; a text without such a character is told at once.
_MAYBE_LOOK_ALIKE = re.compile("[\u00ad\u00b2\u00b3\u00b7\u00b9\u0100-\U0010ffff]")

#: How "at" and "dot" are spelled, in English, German, French and Spanish.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
#: Domain endings that may follow a bare "at" and "dot"; none of them is a common word.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "ai", "app", "dev", "co", "eu", "de",
           "fr", "es", "uk", "ch", "nl", "pl", "pt", "se", "dk", "fi", "ru", "cn", "jp", "br", "mx", "ar", "cl", "ca", "au",
           "nz", "ie", "cz", "gr", "hu", "ro", "tr", "kr", "tw", "example", "test", "invalid")
#: Further endings, like those of two letters for an "at" or "dot" that nothing else can mean.
MORE_ENDINGS = ("xyz", "online", "site", "shop", "store", "tech", "club", "live", "cloud", "pro", "name", "mobi", "blog",
                "email", "space", "website", "top", "icu", "cat", "aero", "coop", "museum", "jobs", "travel", "local")
#: Endings that are words, too; behind the ambiguous dot word they need a local part that is no word.
WORD_ENDINGS = frozenset(("in it us me be at no is as so to do my am by we if of on or an he up go hi oh ok la le un en el "
                          "et ne ce se il tu ma pa online site shop store club live cloud pro name email space top cat jobs "
                          "travel local").split())
AMBIGUOUS_DOT = "point"
#: Words before an "at" that tells a place: "meet us at example.com".
NOT_LOCAL = frozenset((
    "i you he she it we they me him her us them this that these those there here who what which where when how why and or "
    "but so as is are was were be been being am do does did done has have had not also only just now then again "
    "today online live still always directly free all more less most much many some any both each one ones out up off in "
    "on over down back away about around look looks looked looking see sees seen saw watch watched watching find finds found "
    "finding visit visits visited visiting meet meets met meeting join joins joined get gets got buy buys bought buying "
    "order ordered ordering shop shops shopping shopped sell sells sold selling read reads reading book booked booking "
    "register registered registering registration subscribe subscribed download downloads downloaded downloading available "
    "work works worked working live lives lived living stay stayed staying start starts started arrive arrived "
    "located based hosted hosting published posted listed offered featured displayed shown stored reported announced "
    "described explained documented discussed mentioned maintained developed provided accessible accessed access apply "
    "applied learn learned learning study studied check checked click clicked go goes going went gone come comes came log "
    "logged login signup store stores page pages site sites website websites homepage blog blogs article articles story "
    "stories post posts details price prices tickets video videos photos pictures copy copies version versions code source "
    "sources link links error line failed browse search searched searching pointed points aimed directed hotel home "
    "appeared appears appear written write writes wrote employed job jobs engineer manager editor director researcher "
    "reporter writer professor student year years time times people things content information service services store "
    "donate vote voted order orders play plays played playing stream streams streaming listen listened").split())
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_DOT_SIGN = rf"\s?{_OPEN}(?:{_DOT}|\.){_CLOSE}\s?|(?<=\w)\s(?:{_DOT})\s(?=\w)|(?<=\w)(?:_|-)(?:{_DOT})(?:_|-)(?=\w)"
_DISGUISE = re.compile(
    rf"(?P<at>\s?{_OPEN}(?:{_AT}|@){_CLOSE}\s?"
    # a bare "at" needs a domain after it: see _bare
    rf"|(?P<bare>(?<=\w)\s(?:{_AT})\s(?=[A-Za-z0-9-]))"
    rf"|(?<=\w)(?:_|-)(?:{_AT})(?:_|-)(?=\w)"
    rf"|(?<=\w)(?:\s@\s?|@\s)(?=\w))|(?P<dot>{_DOT_SIGN})", re.I)
_STEP = re.compile(rf"\.|{_DOT_SIGN}", re.I)
_LABEL = re.compile(rf"(?:[A-Za-z0-9]|-(?!(?:{_DOT})-))+", re.I)
_ENDING = re.compile(r"[A-Za-z]+\b")
#: Endings of code files, and words before a domain's dot word in prose ("at this point").
_FILES = frozenset("py sh rs md js ts rb hs kt vb ml cc so ps pl".split())
_DETERMINERS = frozenset("the this that a an my your his her our their its every each one some any which what no".split())

#: Spelled digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ITEM = re.compile(rf"\b(?:{_WORD})\b", re.I)
_BETWEEN = re.compile(r"[ \t\n,-]+|\.|[ ]?[()][ ]?")
_NUMBER = re.compile(r"[0-9]+")
_PLUS = re.compile(r"\bplus[ -]$", re.I)
#: A run of spelled digits counts from this many items on, so many of them distinct words; any other
#: counts if, with the digits beside it, a detector takes it.
RUN_ITEMS, RUN_WORDS = 4, 3
_BESIDE = frozenset("+ ().0123456789-")
_LISTED = re.compile(r"[,\t\n]")
_BEHIND = re.compile(r"[\x20().0-9-]*")


class Rewritten:
    """A text after a transducer: pieces with their spans in the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, self.at, self.src, at, self.same = [], [], [], 0, []
        pos = 0
        for a, b, new in edits:
            for s, e, piece, same in ((pos, a, text[pos:a], True), (a, b, new, False)):
                if piece:
                    self.at.append(at)
                    self.src.append((s, e))
                    self.same.append(same)
                    out.append(piece)
                    at += len(piece)
            pos = b
        if pos < len(text) or not out:
            self.at.append(at)
            self.src.append((pos, len(text)))
            self.same.append(True)
            out.append(text[pos:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span before that became [start, end)."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a = self.src[i][0] + (start - self.at[i] if self.same[i] else 0)
        b = self.src[j][0] + (end - self.at[j]) if self.same[j] else self.src[j][1]
        return a, b


def _homoglyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not _MAYBE_LOOK_ALIKE.search(text):
        return []
    return [(m.start(), m.end(), LOOK_ALIKES[m.group()]) for m in _LOOK_ALIKE.finditer(text)]


def _bare(text: str, m: re.Match) -> bool:
    """Does a bare "at" stand between a local part and a domain with plain or disguised dots?"""
    start = m.start()
    while start and text[start - 1] in _LOCAL:
        start -= 1
    local = text[start:m.start()].strip(".-").lower()
    digits = local.isdigit()
    marked = len(local) > 4 if digits else any(c in "0123456789._%+" for c in local)
    named = marked or bool(local) and not digits and local not in NOT_LOCAL
    explicit_at = m.group().strip().lower() != "at"
    label = first = _LABEL.match(text, m.end())
    hidden = explicit = ambiguous = False
    while label and (step := _STEP.match(text, label.end())):
        label = _LABEL.match(text, step.end())
        plain_dot = step.group() == "."
        if not plain_dot:
            hidden = True
            if step.group().strip().lower() == AMBIGUOUS_DOT:
                ambiguous = True
            else:
                explicit = True
        ending = label and _ENDING.match(text, label.start())
        if not ending:
            continue
        end = ending.group()
        low = end.lower()
        listed, short = low in ENDINGS, len(low) == 2 or low in MORE_ENDINGS
        if listed and not plain_dot:
            return True
        if explicit_at:
            if listed or short or plain_dot and len(low) > 2:
                return True
        elif not named or hidden and first.group().lower() in _DETERMINERS or not (listed or short):
            continue
        elif explicit or ambiguous and (marked or low not in WORD_ENDINGS):
            return True
        elif (not hidden and any(c.isalpha() for c in first.group()) and end in (low, end.upper())
              and (marked or low not in _FILES or low == "pl" and not text.startswith(" line ", ending.end()))):
            return True
    return False


def _sign_edits(text: str) -> list[tuple[int, int, str]]:
    edits, pos = [], 0
    while m := _DISGUISE.search(text, pos):
        if m.group("bare") and not _bare(text, m):
            pos = m.start() + 1
            continue
        edits.append((m.start(), m.end(), "@" if m.group("at") else "."))
        pos = m.end()
    return edits


def _digit(word: str) -> str:
    # what else matches an s or an i without regard to case
    return DIGIT_WORDS[word.replace("\u017f", "s").replace("\u0130", "i").replace("\u0131", "i").lower()]


def _beside(text: str, start: int, free: int) -> int:
    """Where the digits and signs right before ``start`` begin."""
    while start > free and text[start - 1] in _BESIDE:
        start -= 1
    return start


def _counts_as_run(text: str, edits: list[tuple[int, int, str]], free: int) -> bool:
    """Does a detector take the rewritten run, with the digits and signs beside it (from ``free`` on)?

    Not if they are an identifier without the run.
    """
    start, end = edits[0][0], edits[-1][1]
    left = _beside(text, start, free)
    beside = text[left:_BEHIND.match(text, end).end()]
    if plain(beside):
        return False
    run = Rewritten(beside, [(a - left, b - left, new) for a, b, new in edits])
    return any(x < end - left and start - left < y for _, a, b in plain(run.text) for x, y in (run.back(a, b),))


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits, digits among them, written as digits without the blanks between."""
    edits, free = [], 0
    for m in _ITEM.finditer(text):
        if m.start() < free:
            continue
        items, pos, before = [(m.start(), m.end(), _digit(m.group()))], m.end(), free
        words, spelled = {m.group().lower()}, 1
        while gap := _BETWEEN.match(text, pos):
            if word := _ITEM.match(text, gap.end()):
                words.add(word.group().lower())
                spelled += 1
                items += [(gap.start(), gap.end(), "." if gap.group() == "." else ""),
                          (word.start(), word.end(), _digit(word.group()))]
                pos = word.end()
            elif number := _NUMBER.match(text, gap.end()):
                items.append((gap.start(), gap.end(), "." if gap.group() == "." else ""))
                pos = number.end()
                items.append((number.start(), pos, number.group()))
            else:
                break
        free = pos
        left = _beside(text, m.start(), before)
        number = _NUMBER.search(text, left, m.start())
        head = number.start() if number else m.start()
        plus = [(x.start(), x.end(), "+") for x in _PLUS.finditer(text, max(before, head - 5), head)]
        strong = (len(items) + 1) // 2 >= RUN_ITEMS and len(words) >= RUN_WORDS
        if not strong and spelled < RUN_ITEMS:  # few words among numbers: lists of numbers stay lists
            items = [e for e in items if not _LISTED.search(text, e[0], e[1])]
        if strong or _counts_as_run(text, plus + items, before):
            edits += plus + items
    return edits


def disguised(text: str, known: list[tuple[str, int, int]], signs: bool = True,
              digits: bool = True) -> list[tuple[str, int, int]]:
    """Spans of identifiers that only the rewritten text shows.

    signs and digits: false if the text is known to hold nothing that the
    second and third transducer rewrite; they run anyway behind look-alikes.
    """
    chain, now = [], text
    for edits_of, wanted in ((_homoglyph_edits, True), (_sign_edits, signs), (_digit_edits, digits)):
        if (wanted or chain) and (edits := edits_of(now)):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    if not chain:
        return []
    out = []
    for kind, a, b in plain(now):
        found = now[a:b]
        for step in reversed(chain):
            a, b = step.back(a, b)
        if text[a:b] != found and not any(x < b and a < y and not (a <= x and y <= b and b - a > y - x)
                                          for _, x, y in known):
            out.append((kind, a, b))
    return out


def find(text: str | None, signs: bool = True,
         digits: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans with the disguised ones, each by start, then kind as listed."""
    if not text:
        return [], []
    base = plain(text)
    more = disguised(text, base, signs, digits)
    every = sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base
    return base, every


def redact(text: str | None, signs: bool = True, digits: bool = True) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind of its first span, as in ``[EMAIL]``."""
    spans = find(text, signs, digits)[1]
    if not spans:
        return text
    out, pos, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[pos:a], f"[{kind.upper()}]"]
        pos, k = b, k + 1
    return "".join(out) + text[pos:]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = textkit.utf8(pa.array(words))
    return textkit.PrefixHash(data)(offsets[:-1], offsets[1:])


def _places(data: np.ndarray) -> np.ndarray:
    """Bytes that begin an "at" with a plain dot in the word behind it; blanks outside ASCII may be any such character."""
    out = np.zeros(len(data), bool)
    if len(data) < 6:
        return out
    blank = _BLANK[data]
    low = data | 32
    at = 1 + np.flatnonzero((blank | (data > 127))[:-4] & (low[1:-3] == ord("a")) & (low[2:-2] == ord("t"))
                            & (blank | (data > 127))[3:-1])
    if len(at):
        inner = np.zeros(len(data) + 1, np.int64)
        inner[2:-1] = np.cumsum((data[1:-1] == ord(".")) & _ALNUM[data[:-2]] & _ALNUM[data[2:]])
        inner[-1] = inner[-2]
        blanks = np.append(np.flatnonzero(blank), len(data))
        out[at] = inner[blanks[np.searchsorted(blanks, at + 3)]] > inner[at + 3]
    return out


def worth_rewriting(column: pa.Array) -> tuple[list[bool], list[bool]]:
    """For each text: may it hold a disguised sign, and a run of spelled digits? From its words' hashes."""
    data, offsets = textkit.utf8(column)
    n = len(offsets) - 1
    words = textkit.Words(textkit.LOWER[data], offsets, textkit.PUNCTUATION)
    hashes, of = words.hashes(), words.text
    signs = [*DOT_WORDS, *AT_WORDS[1:]]
    spelled = [*signs, *DIGIT_WORDS]
    # capitals outside ASCII stand beside their small letters
    forms = spelled + ["".join(c if c.isascii() else c.upper() for c in w) for w in spelled]
    table, which = np.unique(_hashes(forms), return_index=True)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    hit = np.flatnonzero(table[at] == hashes)
    found = np.unique(of[hit] * len(spelled) + which[at[hit]] % len(spelled))  # distinct words of each text
    text, word = found // len(spelled), found % len(spelled)
    dots = np.bincount(text[word < len(signs)], minlength=n) > 0
    spoken = np.bincount(text[word >= len(signs)], minlength=n)
    # a run has RUN_WORDS distinct words, or with the digits beside it at least those of the shortest kind, an IP
    said = np.bincount(of[hit][which[at[hit]] % len(spelled) >= len(signs)], minlength=n)
    digits = (spoken >= RUN_WORDS) | (spoken > 0) & (said + textkit.sums(_DIGITS[data], offsets) >= 4)
    signs = dots | (textkit.sums(_SIGNS[data] | _places(data), offsets) > 0)
    return signs.tolist(), digits.tolist()


#: What a disguised sign holds besides the words for "dot".
_SIGNS = np.isin(np.arange(256), list(b"[({<@_-"))
_BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r\x1c\x1d\x1e\x1f "))
_ALNUM = np.isin(np.arange(256), list(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))

SPANS = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
         "spans string, n_disguised bigint")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: counts of plain spans by kind, their digest, all spans as text, and how many are disguised."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        rows = [find(*x) for x in zip(column.to_pylist(), *worth_rewriting(column))]
        counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in KINDS]
        digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *counts, pa.array(digest, pa.string()),
             pa.array([written(every) for _, every in rows], pa.string()),
             pa.array([len(every) - len(base) for base, every in rows], pa.int64())],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])

    return map_chunks(docs.select("doc_id", "text"), one, SPANS)


def redact_documents(docs: DataFrame) -> DataFrame:
    """Documents with identifiers replaced in ``text``; other columns as they are."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index("text")
        column = batch.column(k)
        new = pa.array([redact(*x) for x in zip(column.to_pylist(), *worth_rewriting(column))], batch.schema.field(k).type)
        return batch.set_column(k, batch.schema.field(k), new)

    return map_chunks(docs, one, docs.schema)
