"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits,
scheme marks and identifier cues.  From each anchor a local parser expands to both sides and
validates what it finds.  A parser never rescans what an earlier span of its kind has taken, so
the work is linear in the text, also for very long runs without a boundary.

Kinds, in the order in which spans with equal starts are listed (``KINDS``):

* email, ip, card, phone: the fixed base rules, leftmost and without overlaps per kind;
* url: a scheme, ``://`` and what follows up to white space, quotes or angle brackets, without
  trailing punctuation, with a non-empty host;
* account: after an identifier cue such as ``iban`` or ``account``, an optional ``no``/``number``
  and separator, an identifier of 6 to 34 letters and digits with at least four digits (an IBAN by
  its check digits); groups of digits with single spaces or hyphens between them are one identifier;
* address: after ``address:`` or ``street:``, the rest of the line, however long, if it holds a
  house number.

Cues are found in any mixture of upper and lower case.

Defined cases: null and empty texts have no spans; repeated rows are treated alike; offsets are code
points, ends exclusive; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import ascii_lowercase

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
BASE_KINDS = KINDS[:4]

CUES = (
    "iban", "account", "acct", "passport", "licence no", "license no", "customer no", "ssn",
    "tax id", "member id", "user id", "konto", "compte", "cuenta",
)
PLACES = ("address:", "adresse:", "dirección:", "street:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DOTTED_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_BODY = re.compile(r"[^\s<>\"']+")
_ACCOUNT = re.compile(r"(?:(?<=no)\.)?(?:\s{0,3}(?:number|no|nr|num)\.?)?\s{0,3}[:#=]?\s{0,3}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,40})", re.I)
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*(?![A-Za-z0-9])")

# One code point for one, so that offsets stay.
_LOWER = {ord(c.upper()): c for c in {*ascii_lowercase, *"".join(CUES + PLACES)} if len(c.upper()) == 1}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, kind in [("@", "@"), ("+", "+"), ("://", ":")]:
        found.add_word(text, (kind, len(text)))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
    for kind, cues in (("account", CUES), ("address", PLACES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Check digits of an international account number."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    if not (m := _ACCOUNT.match(text, at)):
        return None
    body, start = m.group(1), m.start(1)
    # Separators inside are kept only where the whole is a valid international number.
    coded = re.match("[A-Z]{2}[0-9]{2}", re.sub("[ -]", "", body))
    for end in range(len(body), 14, -1) if coded else ():
        if body[end - 1].isalnum() and iban(re.sub("[ -]", "", body[:end])):
            return start, start + end
    found = [re.match("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*", body).group()]
    if groups := _GROUPS.match(body):
        # Whole groups, as many as one identifier can hold.
        found += [body[: g.end()] for g in re.finditer("[0-9]+", groups.group())]
    for one in sorted(found, key=len, reverse=True):
        plain = re.sub("[ -]", "", one)
        if 6 <= len(plain) <= 34 and sum(c.isdigit() for c in plain) >= 4:
            return start, start + len(one)
    return None


def _line(text: str, at: int) -> tuple[int, int, int]:
    """End of the line that ``at`` lies in, and the places after its last digit and last letter."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end

    def after(holds) -> int:
        return next((i + 1 for i in range(end - 1, at - 1, -1) if holds(text[i])), at)

    return end, after(str.isdigit), after(str.isalpha)


class Finder:
    """Finds the spans of one text after the other."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start and then by kind as listed."""
        out: list[tuple[int, int, str]] = []
        email = chain = dotted = phone = url = account = address = 0
        line = digit = letter = -1
        for last, (anchor, length) in self.anchors.iter(text.translate(_LOWER)):
            at = last - length + 1
            if anchor == "0":
                if at >= chain:
                    m = _DIGIT_CHAIN.match(text, at)
                    chain = m.end()
                    digits = re.sub("[ -]", "", m.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, chain, "card"))
                if at >= dotted:
                    m = _DOTTED_CHAIN.match(text, at)
                    dotted = m.end()
                    place = at
                    while four := _DOTTED.match(text, place, dotted):
                        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four.group().split(".")):
                            out.append((four.start(), four.end(), "ip"))
                        place = four.end() + 1
            elif anchor == "@":
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    out.append((start, m.end(), "email"))
                    email = m.end()
                else:
                    # No span can cross this sign, so what is before it is never read again.
                    email = at + 1
            elif anchor == "+":
                if at >= phone and (m := _PHONE.match(text, at)):
                    phone = m.end()
                    if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                        out.append((at, phone, "phone"))
            elif anchor == ":":
                start = at
                while start > url and text[start - 1] in _SCHEME:
                    start -= 1
                if start < at and (m := _URL_BODY.match(text, at + 3)):
                    end = at + 3 + len(m.group().rstrip(".,;:!?)]}"))
                    if end > at + 3 and text[at + 3].isalnum():
                        out.append((start, end, "url"))
                        url = end
                        continue
                url = max(url, at + 3)
            elif anchor == "account":
                bounded = at == 0 or not text[at - 1].isalnum()
                if at >= account and bounded and not text[last + 1 : last + 2].isalnum():
                    if found := _account(text, last + 1):
                        out.append((*found, "account"))
                        account = found[1]
            elif at >= address and (at == 0 or not text[at - 1].isalnum()):
                if last >= line:
                    line, digit, letter = _line(text, last + 1)
                if line - last > 5 and min(digit, letter) > last + 1:
                    body = text[last + 1 : line]
                    start = line - len(body.lstrip())
                    out.append((start, last + 1 + len(body.rstrip()), "address"))
                    address = line
        out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
        return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (start, end, kind) of every document, one row per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [
                [{"start": a, "end": b, "kind": k} for a, b, k in finder.spans(t)] if t else []
                for t in (x.as_py() for x in batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<start: bigint, end: bigint, kind: string>>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
