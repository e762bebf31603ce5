"""Personal data by anchor expansion: an automaton finds anchors, and parsers settle where each finding begins and ends.

One pass of an Aho-Corasick automaton over the lower-cased bytes of a text finds at-signs, plus signs, digits,
schemes and identifier cues. At each anchor a parser that reads only its surroundings expands and validates one finding; what
a parser has read is not read again by the next anchor of its kind, so the work is linear in the text.

Kinds of the base, each leftmost and without overlaps; a finding that fails its validation is dropped and not tried again:

- ``email``: around an at-sign, a local part of letters, digits and ``._%+-``, and a domain of two labels or more.
- ``ip``: at a digit, four dotted numbers of at most 255 each.
- ``card``: at a digit, digits with at most one space or hyphen between two; 13 to 19 of them, with a valid check digit (Luhn).
- ``phone``: at a plus sign before a digit, digits with spaces, parentheses, dots and hyphens; 9 to 15 digits.

Kinds that cues add:

- ``account``: behind ``iban``, an IBAN whose check number fits (modulo 97); behind ``account``, ``acct`` or ``passport`` and
  ``no``, ``number``, ``#`` or a colon, an identifier of 6 to 20 letters, digits and hyphens, five digits at least.
- ``address``: in front of a street word (``street``, ``avenue``, ``road``, ``lane``, ``boulevard``, ``drive``), a house number and one
  to three capitalised words.
- ``login``: behind ``://``, a user with or without a password in front of an at-sign and a host; the user and the password.
- ``masked_email``: around ``(at)`` or ``[at]``, a local part and a domain whose dots may be written ``(dot)`` or ``[dot]``.

Positions are code points, the end exclusive. Null and empty texts hold nothing. Every row is judged alike, repeated ones
too; ids are not read. Empty tables give empty tables. Columns of any names are kept, except those called as what is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _shared, _text

#: In the order in which spans are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "account", "address", "login", "masked_email"]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\W{0,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])", re.ASCII)
_NUMBERED = re.compile(r"(?:\s{0,2}(?:no\.?|number|num\.?|#)\s{0,2}:?|\s{0,2}:)\s{0,2}([A-Za-z0-9](?:-?[A-Za-z0-9]){5,19})(?![A-Za-z0-9-])", re.ASCII | re.IGNORECASE)
_LOGIN = re.compile(r"([A-Za-z0-9._~%!$&'()*+,;=-]+(?::[^\s/@?#]*)?)@[A-Za-z0-9.-]+")
_HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'.-]* ){1,3}\Z", re.ASCII)
_MASKED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
#: How far in front of a street word its house number may stand.
_HOUSE_REACH = 80


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


class _Reader:
    """What the parsers find in one text, given as one character per byte."""

    def __init__(self, raw: str):
        self.raw, self.found = raw, []
        self.read = dict.fromkeys(KINDS, 0)

    def _local_start(self, at: int, kind: str) -> int:
        begin, least, raw = at, self.read[kind], self.raw
        while begin > least and raw[begin - 1] in _LOCAL:
            begin -= 1
        return begin

    def at_sign(self, at: int, end: int) -> None:
        begin, domain = self._local_start(at, "email"), _DOMAIN.match(self.raw, end)
        if begin < at and domain:
            self.found.append(("email", begin, domain.end()))
            self.read["email"] = domain.end()
        else:
            # nothing in front of this sign can be part of a later local part
            self.read["email"] = end

    def digit(self, at: int, end: int) -> None:
        if at >= self.read["ip"]:
            run = _DOTTED.match(self.raw, at)
            self.read["ip"] = run.end()
            if run.group().count(".") >= 3:
                begin, parts = at, run.group().split(".")
                for four in (parts[i : i + 4] for i in range(0, len(parts) - 3, 4)):
                    stop = begin + sum(map(len, four)) + 3
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                        self.found.append(("ip", begin, stop))
                    begin = stop + 1
        if at >= self.read["card"]:
            run = _GROUPED.match(self.raw, at)
            self.read["card"] = run.end() if run else end
            if run and run.end() - at >= 13:
                digits = run.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    self.found.append(("card", at, run.end()))

    def plus(self, at: int, end: int) -> None:
        run = _DIALLED.match(self.raw, at)
        if run and 9 <= sum(map(run.group().count, "0123456789")) <= 15:
            self.found.append(("phone", at, run.end()))

    def _add(self, kind: str, begin: int, end: int) -> None:
        if begin >= self.read[kind]:
            self.found.append((kind, begin, end))
            self.read[kind] = end

    def _word_starts(self, at: int) -> bool:
        return not at or not self.raw[at - 1].isalnum()

    def iban(self, at: int, end: int) -> None:
        if self._word_starts(at) and (m := _IBAN.match(self.raw, end)):
            value = m[1].replace(" ", "").upper()
            if int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1:
                self._add("account", m.start(1), m.end(1))

    def numbered(self, at: int, end: int) -> None:
        if self._word_starts(at) and (m := _NUMBERED.match(self.raw, end)) and sum(map(str.isdigit, m[1])) >= 5:
            self._add("account", m.start(1), m.end(1))

    def street(self, at: int, end: int) -> None:
        if end < len(self.raw) and self.raw[end].isalnum() or not self.raw[at].isupper():
            return
        window = self.raw[max(0, at - _HOUSE_REACH) : at]
        if m := _HOUSE.search(window):
            self._add("address", at - len(window) + m.start(), end)

    def scheme(self, at: int, end: int) -> None:
        if m := _LOGIN.match(self.raw, end):
            self._add("login", m.start(1), m.end(1))

    def masked_at(self, at: int, end: int) -> None:
        stop = at - 1 if at and self.raw[at - 1] == " " else at
        begin, domain = self._local_start(stop, "masked_email"), _MASKED_DOMAIN.match(self.raw, end)
        if begin < stop and domain:
            self._add("masked_email", begin, domain.end())


# Anchors and the parser that each calls.
ANCHORS = {
    "@": "at_sign", "+": "plus", "://": "scheme", "(at)": "masked_at", "[at]": "masked_at", "iban": "iban",
    "account": "numbered", "acct": "numbered", "passport": "numbered",
    "street": "street", "avenue": "street", "road": "street", "lane": "street", "boulevard": "street", "drive": "street",
} | dict.fromkeys("0123456789", "digit")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, parser in ANCHORS.items():
        a.add_word(word, (len(word), parser))
    a.make_automaton()
    return a


def spans_of(text: bytes) -> list[tuple[str, int, int]]:
    """Kind, start and end of all findings in one text of UTF-8 bytes, by kind and then by start, in code points."""
    raw = text.decode("latin-1")
    reader = _Reader(raw)
    for last, (size, parser) in _automaton().iter(text.lower().decode("latin-1")):
        getattr(reader, parser)(last + 1 - size, last + 1)
    found = sorted(reader.found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    if found and not raw.isascii():
        before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(kind, int(before[a]), int(before[b])) for kind, a, b in found]
    return found


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted((a, -b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def find_private(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with ``spans``; its text stays as it is, or has ``[KIND]`` in place of findings if ``redact``.

    Of findings that overlap, the one that begins first, and of those the longest, names the place.
    """
    keep = [c for c in _shared.others(docs, ["spans"]) if not redact or c != text]
    rows = docs.select(_shared.packed(keep).alias("row"), _shared.column(text).cast("string").alias("text"))
    shape = T.StructType([rows.schema["row"], *([T.StructField("text", T.StringType())] if redact else []), T.StructField("spans", T.DataType.fromDDL(SPANS))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.flat(batch.column("text"))
            found = [spans_of(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
            cols = [batch.column("row")]
            if redact:
                cols.append(pa.array([_redacted(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), found, strict=True)], pa.string()))
            cols.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind))
            yield pa.RecordBatch.from_arrays(cols, shape.names)

    out = rows.mapInArrow(run, shape)
    restored = dict(zip(keep, _shared.unpacked(keep), strict=True))
    if redact:
        restored[text] = F.col("text").alias(text)
    return out.select(*[restored[c] for c in docs.columns if c in restored], "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
