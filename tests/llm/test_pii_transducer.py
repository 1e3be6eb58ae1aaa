import hashlib
import re
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cursus.llm import pii_transducer as pii
from cursus.llm import queries

SF = "/root/testdata/sf0.01"
ORDER = ["email", "ip", "card", "phone"]


def luhn(digits):
    odd = sum(int(d) for d in digits[::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def brute(text):
    """The contract's patterns, one after the other."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ORDER.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.-+%_ ()25é", max_size=40))
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain(text) == brute(text)


@pytest.mark.parametrize("text, kind, part", [
    ("mail john.smith [at] example (dot) com now", "email", "john.smith [at] example (dot) com"),
    ("john at example dot com", "email", "john at example dot com"),
    ("write user @ mail.example.org today", "email", "user @ mail.example.org"),
    ("usеr@exаmple.com hi", "email", "usеr@exаmple.com"),
    ("jo​hn@example.com", "email", "jo​hn@example.com"),
    ("name_at_host_dot_org", "email", "name_at_host_dot_org"),
    ("juan arroba correo punto es", "email", "juan arroba correo punto es"),
    ("call plus one four one five five five five two four eight five", "phone",
     "plus one four one five five five five two four eight five"),
    ("IP four two dot one four four dot three five dot two five four ok", "ip",
     "four two dot one four four dot three five dot two five four"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("éè 42[.]144[.]35[.]254 ü", "ip", "42[.]144[.]35[.]254"),
])
def test_disguises_map_back_to_the_source(text, kind, part):
    base, every = pii.find(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in every
    assert set(base) <= set(every)
    assert part not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", [
    "We met at noon. Look at the point of it.", "le point de vue, un deux trois", "one two three", "un " * 40,
    "Meet me at home dot", "prices (at) 5", "5 @ 3", "белый дом", "a [1] b {2} <3>",
    "eight nine ten eleven"])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


def test_query_equals_patterns_on_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {i: brute(x) for i, x in zip(t["doc_id"], t["text"])}
    rows = queries.op6_pii_transducer(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ORDER]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(",")) | {""}


def test_batch_flags_lose_nothing(make_docs):
    texts = [None, "", "john at example dot com", "FÜNF vier drei zwei eins null sieben acht neun 1 2 3 4",
             "four zero four one eight nine four nine seven four six zero eight seven nine five", "x" * 300_000,
             "9" * 20_000, "1." * 20_000, "a@" * 20_000, "+1" * 20_000, "john at example dot com"]
    rows = list(enumerate(texts)) + [(0, None), (None, "a@b.cd")]
    docs = make_docs(rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "kind")
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert got == {i: pii.written(pii.find(t)[1]) for i, t in rows}
    redacted = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert redacted == {i: pii.redact(t) for i, t in rows}
    assert pii.find_pii(make_docs([])).count() == 0


CARD = "four" + " one" * 15


@pytest.mark.parametrize("text, kind, part", [
    (CARD, "card", CARD),
    ("pay " + CARD.replace(" one one one one", ", one one one one") + " ok", "card",
     CARD.replace(" one one one one", ", one one one one")),
    ("4111 1111 one one one one 1111", "card", "4111 1111 one one one one 1111"),
    ("plus one" + " five" * 10, "phone", "plus one" + " five" * 10),
    ("plus 49 170 one two 345678 x", "phone", "plus 49 170 one two 345678"),
    ("call +49 170 one two 345678", "phone", "+49 170 one two 345678"),
    ("host 10.0.0.one up", "ip", "10.0.0.one"),
    ("one dot one dot one dot one", "ip", "one dot one dot one dot one"),
])
def test_runs_of_few_distinct_words(make_docs, text, kind, part):
    span = (kind, text.index(part), text.index(part) + len(part))
    assert span in pii.find(text)[1]
    assert part not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)
    assert pii.find(text, *(x[0] for x in pii.worth_rewriting(pa.array([text])))) == pii.find(text)


@pytest.mark.parametrize("text", [
    "un " * 16, "one " * 500, "in one, 2004, 2005, 2006, 2007", "one of 100 and two of 2000", "+1 or one", "1.2 one.3",
    "\u017fix s\u0130x one two three four", "plus one", "one plus five five five"])
def test_prose_with_digit_words_stays_clean(text):
    assert pii.find(text) == ([], [])


def test_an_identifier_does_not_take_in_a_word_beside_it():
    text = "+1 (848) 555-1373 Un an"
    assert pii.find(text) == ([("phone", 0, 17)],) * 2


@pytest.mark.parametrize("text, part", [
    ("alice at example.com", "alice at example.com"), ("é alice\u00a0AT\u2003a.de", "alice\u00a0AT\u2003a.de"),
    ("Write to alice at example.com.", "alice at example.com"),
    ("mail j.doe at mail.example.co.uk now", "j.doe at mail.example.co.uk"),
    ("bob at mail.example dot com", "bob at mail.example dot com"),
    ("anna arroba ditta punto it", "anna arroba ditta punto it"),
    ("anna arroba ditta.online", "anna arroba ditta.online"),
    ("ravi at firma dot in", "ravi at firma dot in"), ("joe at shop dot me", "joe at shop dot me"),
    ("kim at site [.] xyz", "kim at site [.] xyz"), ("eva at firma dot online", "eva at firma dot online"),
    ("j.doe at firma point be", "j.doe at firma point be"), ("anna at ditta.it", "anna at ditta.it"),
    ("x7 at " + "a dot " * 9 + "com", "x7 at " + "a dot " * 9 + "com"),
])
def test_bare_at(text, part):
    span = ("email", text.index(part), text.index(part) + len(part))
    assert span in pii.find(text)[1] and part not in pii.redact(text)
    assert pii.find(text, *(x[0] for x in pii.worth_rewriting(pa.array(["a", text, "b"]).slice(1, 1)))) == pii.find(text)


@pytest.mark.parametrize("text", [
    "meet us at example.com", "Look at example.com for it", "more is available at shop.example.org", "We met at 10.30 or at 5.5",
    "died: error at main.py", "I stayed at home.He left", "at this point it is over", "look at that point in time",
    "We are at some point no better", "he looked at the dot in it", "work at a.m. or p.m.", "since 2019 at example.com"])
def test_places_are_no_addresses(text):
    assert pii.find(text) == ([], [])


def test_bare_ats_take_linear_time():
    for text in ("x at a" + " dot a" * 40_000, "a at b." * 40_000, "x at y dot at dot " * 20_000):
        start = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - start < 20
