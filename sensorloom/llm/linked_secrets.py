"""Secret scans by linking the parts of multipart credentials.

A credential has up to three parts: an access identifier, a secret and an endpoint.  Patterns find
the parts of a text as intervals; an interval join over sorted starts then links parts that lie in
one scope.  Two parts are in one scope if no blank line lies between them and at most ``REACH`` code
points do.  The join is one binary search per part and category, so it is linear in the text but for
a logarithm, also where thousands of parts share a scope.

Strong parts are the fixed base rules, which are always reported, leftmost and without overlaps per
kind: ``assign`` (a secret), ``access`` (an identifier) and ``hex`` (a secret).  Weak parts are
reported only where complementary parts co-occur, and only outside the base spans:

* ``identifier``: a value after a cue such as ``user`` or ``client_id``, or the user of a URL;
  reported if a secret is linked to it;
* ``secret``: a value after a cue such as ``pwd`` or ``bearer``, the password of a URL, or a token of
  16 and more characters with upper case, lower case and digits and ``MIXED_BITS`` bits of entropy a
  character; reported if an identifier is linked to it;
* ``endpoint``: a URL, or a value after a cue such as ``host``; reported if an identifier and a secret
  are linked to it.

Reported parts of one scope get a common ``credential`` number (from 1 within a text) if they are of
two categories or more; other parts have none.

Defined cases: null and empty texts have no spans; repeated rows are treated alike; texts of any
length are scanned whole, as one scope if they hold no blank line; offsets are code points, ends
exclusive; other columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE_KINDS = KINDS[:3]
REACH = 300
MIXED_BITS = 3.2

_CATEGORY = {"assign": "secret", "access": "identifier", "hex": "secret"}
_NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}

# Cues in any case; ASCII letters only, so that no other letter folds into them.
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Whole runs only: a run starts after another character.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|(?:client|account|tenant|app|key|access_?key)_?id)"
    + _VALUE
    + r"([A-Za-z0-9@._+-]{2,})",
    re.I | re.A,
)
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:pass(?:phrase|code)?|pwd|auth|credentials?|(?:private|access|secret)_?key|signature)"
    + _VALUE
    + r"|bearer\x20+)([A-Za-z0-9+/_.=~!@#$%^&*-]{4,})",
    re.I | re.A,
)
_ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint|base_?url|bucket|database)" + _VALUE + r"([A-Za-z0-9._:/-]{3,})",
    re.I | re.A,
)
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\s<>\"']+")
_LOGIN = re.compile(r"://([^\s/:@]+):([^\s/@]+)@")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

Part = tuple[int, int, str]


def base_parts(text: str) -> list[Part]:
    """The spans of the base rules."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def mixed(token: str) -> bool:
    """Whether a token looks drawn at random: three classes of characters and enough entropy."""
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= MIXED_BITS


def _weak_identifiers(text: str) -> list[Part]:
    out = [(*m.span(1), "identifier") for m in _IDENTIFIER.finditer(text)]
    return out + [(*m.span(1), "identifier") for m in _LOGIN.finditer(text)]


def _other_weak(text: str) -> list[Part]:
    out = [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    out += [(*m.span(2), "secret") for m in _LOGIN.finditer(text)]
    out += [(*m.span(), "secret") for m in _TOKEN.finditer(text) if mixed(m.group())]
    for m in _URL.finditer(text):
        out.append((m.start(), m.start() + len(m.group().rstrip(".,;:!?)]}")), "endpoint"))
    return out + [(*m.span(1), "endpoint") for m in _ENDPOINT.finditer(text)]


def _apart(parts: list[Part]) -> list[Part]:
    """The parts in order, of overlapping ones the first (of equal starts the longest)."""
    out: list[Part] = []
    for p in sorted(parts, key=lambda p: (p[0], -p[1], KINDS.index(p[2]))):
        if not out or p[0] >= out[-1][1]:
            out.append(p)
    return out


def _outside(parts: list[Part], taken: list[Part]) -> list[Part]:
    """The parts that overlap none of the taken intervals, which are in order and apart."""
    ends = [t[1] for t in taken]
    out = []
    for p in parts:
        k = bisect_left(ends, p[0] + 1)
        if k == len(taken) or taken[k][0] >= p[1]:
            out.append(p)
    return out


def _reach(a: Part, b: Part, blanks: list[int]) -> bool:
    """Whether two parts, the first of which starts first, lie in one scope."""
    return b[0] - a[1] <= REACH and bisect_left(blanks, a[0]) == bisect_left(blanks, b[0])


def spans(text: str) -> list[tuple[int, int, str, int | None]]:
    """(start, end, kind, credential) of the reported parts, by start and then by kind as listed."""
    found = base_parts(text)
    identifiers = _weak_identifiers(text)
    if not identifiers and not any(kind == "access" for *_, kind in found):
        # Every link needs an identifier.
        return sorted(((*p, None) for p in found), key=lambda p: (p[0], KINDS.index(p[2])))
    blanks = [m.start() for m in _BLANK_LINE.finditer(text)]
    held = _apart(found)
    # A user and a password of a URL lie inside it, so each category is made apart on its own.
    weak = identifiers + _other_weak(text)
    by_kind = {c: _outside(_apart([p for p in weak if p[2] == c]), held) for c in _NEEDS}
    # A value cannot be an identifier and a secret; what a cue calls an identifier is one.
    by_kind["secret"] = _outside(by_kind["secret"], by_kind["identifier"])
    sides = {c: _apart([p for p in found if _CATEGORY[p[2]] == c] + by_kind[c]) for c in ("identifier", "secret")}
    starts = {c: [p[0] for p in side] for c, side in sides.items()}

    def linked(part: Part, category: str) -> bool:
        k = bisect_left(starts[category], part[0])
        side = sides[category]
        return (k < len(side) and _reach(part, side[k], blanks)) or (k > 0 and _reach(side[k - 1], part, blanks))

    reported = found + [
        p for c, needs in _NEEDS.items() for p in by_kind[c] if all(linked(p, need) for need in needs)
    ]
    reported.sort(key=lambda p: (p[0], KINDS.index(p[2])))
    return _numbered(reported, blanks)


def _numbered(parts: list[Part], blanks: list[int]) -> list[tuple[int, int, str, int | None]]:
    """The parts with the number of their credential."""
    out: list[tuple[int, int, str, int | None]] = []
    number = at = 0
    while at < len(parts):
        end, far = at + 1, parts[at]
        while end < len(parts) and _reach(far, parts[end], blanks):
            far = max(far, parts[end], key=lambda p: p[1])
            end += 1
        linked = len({_CATEGORY.get(k, k) for *_, k in parts[at:end]}) > 1
        number += linked
        out += [(*p, number if linked else None) for p in parts[at:end]]
        at = end
    return out


_SPANS = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("credential", pa.int32())])
)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (start, end, kind, credential) of every document, one row per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("start", "end", "kind", "credential"), s)) for s in spans(t)] if t else []
                for t in (x.as_py() for x in batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<start: bigint, end: bigint, kind: string, credential: int>>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
