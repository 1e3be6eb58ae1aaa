"""Course names brought to one form, to match a text list of courses with the catalogue.

The form of a name is its runs of ASCII letters and digits, lower case, joined
by one blank, after every character was replaced by the ASCII part of its
compatibility decomposition (and dropped if that is empty). The replacement
table comes from Python's Unicode data for the basic plane; as a column the
rule is native expressions only.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")


@cache
def ascii_parts() -> dict[str, str]:
    """Character -> ASCII part of its decomposition, where that is not empty."""
    parts = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        part = "".join(p for p in unicodedata.normalize("NFKD", chr(code)) if p.isascii())
        if part:
            parts[chr(code)] = part
    return parts


def normalise_text(text) -> str:
    """The form of one name, for the configured targets."""
    plain = _BEYOND_ASCII.sub(lambda m: ascii_parts().get(m.group(), ""), str(text))
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def normalise_name(name: Column) -> Column:
    """The form of a column of names; null stays null."""
    one = {c: p for c, p in ascii_parts().items() if len(p) == 1}
    more = {c: p for c, p in ascii_parts().items() if len(p) > 1}
    plain = F.translate(name, "".join(one), "".join(one.values()))
    # characters that become several are rare: look before taking a text apart
    several = F.from_json(F.lit(json.dumps(more, ensure_ascii=False)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    plain = F.when(plain.rlike("[" + "".join(more) + "]"), spelled).otherwise(plain)
    plain = F.lower(F.regexp_replace(plain, r"[^\x00-\x7f]", ""))
    return F.array_join(F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), F.lit(1)), " ")
