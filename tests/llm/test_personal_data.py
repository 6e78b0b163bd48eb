import re
import time

import pytest
from corpus_fixtures import documents, no_documents  # noqa: F401
from hypothesis import example, given, settings
from hypothesis import strategies as st

from sensorloom.llm.personal_data import BASE_KINDS, Finder, find, iban, luhn

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB0123459.@+-() %\né🙂:/", max_size=60))
@example("a@b.c@d.e@f.g..h@i")
@example("1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.002.3.4")
@example("4111 1111 1111 1111-4111111111111111 +1 (23) 456-7890+12345678901")
def test_base_spans_equal_the_rules(text):
    assert [s for s in Finder().spans(text) if s[2] in BASE_KINDS] == brute(text)


def test_added_kinds():
    text = "See https://ex.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no 12-345678; address: Main St 5\nend"
    found = {k: text[a:b] for a, b, k in Finder().spans(text)}
    assert found["url"] == "https://ex.org/a?b=1" and found["address"] == "Main St 5"
    kinds = [text[a:b] for a, b, k in Finder().spans(text) if k == "account"]
    assert kinds == ["DE89 3704 0044 0532 0130 00", "12-345678"]
    assert iban("DE89370400440532013000") and not iban("DE88370400440532013000")


def found(text, kind):
    return [text[a:b] for a, b, k in Finder().spans(text) if k == kind]


@pytest.mark.parametrize("cue", ["Tax ID", "User ID", "Member ID", "License No", "Customer No.", "tAx iD", "iBAN"])
def test_cues_in_any_case(cue):
    assert found(f"é🙂 {cue}: 12345678, end", "account") == ["12345678"]


def test_places_in_any_case():
    for cue in ("aDDress:", "DIRECCIÓN:", "Dirección:", "dirECCión:", "Street:"):
        assert found(f"İ {cue} Main St 5\nend", "address") == ["Main St 5"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("SSN 123 45 6789.", "123 45 6789"),
        ("account 1234 5678 9012", "1234 5678 9012"),
        ("account 1234 5678 9012abc", "1234 5678"),
        ("Tax ID: 12-345 678, 9", "12-345 678"),
        ("account 1234-5678-AB 99", "1234-5678-AB"),
        ("account " + " ".join(["1234"] * 9), " ".join(["1234"] * 8)),
        ("account 12 34", None),
        ("account " + "1" * 50, None),
    ],
)
def test_groups_of_digits(text, want):
    assert found(text, "account") == [want] * (want is not None)


def test_addresses_reach_the_end_of_their_line():
    long = "Main Street " * 40
    assert found(f"address: {long}5 north \nnext 7", "address") == [f"{long}5 north"]
    assert found(f"address: {long}5, x", "address") == [f"{long}5, x"]
    assert found(f"address: {long}\n5 x", "address") == []
    assert found("address: a street: b\naddress:\nstreet: c 12", "address") == ["c 12"]


@pytest.mark.parametrize("unit", ["address: ", "street: é", "account 1 2 ", "SSN 1-"])
def test_many_cues_take_linear_time(unit):
    start = time.process_time()
    Finder().spans(unit * 100_000)
    assert time.process_time() - start < 8


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "+1 ", "a@", "://", "@", "+1(", "a.b@c."])
def test_long_texts_take_linear_time(unit):
    start = time.process_time()
    Finder().spans(unit * 200_000)
    assert time.process_time() - start < 8


def test_documents(documents, no_documents):
    got = find(documents).collect()
    assert len(got) == documents.count()
    want = {(r.doc_id, tuple(brute(r.text or ""))) for r in documents.collect()}
    base = {(r.doc_id, tuple((s.start, s.end, s.kind) for s in r.spans if s.kind in BASE_KINDS)) for r in got}
    assert base == want
    assert find(no_documents).count() == 0
