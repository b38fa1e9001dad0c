"""Personal data by anchor expansion (operator 9).

One Aho-Corasick automaton finds anchors: at-signs, scheme marks, a plus before a digit, a dot between digits, pairs
of digits that may belong to an account number, and words that announce an identifier. Local parsers expand each
anchor to its span and validate it; they read on only within the span, so a text is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vekspar.llm.common import chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "address")
# The parts of the base patterns, read from their anchors.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Words that announce an identifier.
CUES = ("iban", "account", "acct", "passport", "ssn")
_LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"(?:\x20*(?:no|number|#))?[.:=#\x20]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8})")
_DAY = re.compile(r"(?:19|20)[0-9]{2}-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])-(?:0[1-9]|1[0-2])-(?:19|20)[0-9]{2}")
# Words that a street's name ends or begins with, and the parts of a postal address around them.
STREETS = (" Street", " Avenue", " Road", " Lane", " Drive", " Boulevard", "straße", "strasse", "Calle ", "Rue ", "rue ")
_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][A-Za-z'-]*\x20?){1,3}\Z")
_NAME = re.compile(r"[A-ZÄÖÜ][a-zäöüß-]*\Z")
_TOWN = re.compile(r"(?:,?\x20[A-Z][A-Za-z-]+){0,2}(?:,?\x20[A-Z]{2})?,?\x20[0-9]{5}(?![0-9])")
_HOUSE = re.compile(r"\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])(?:,?\x20[0-9]{5}\x20[A-ZÄÖÜ][A-Za-zäöüß-]+)?")
_CALLE = re.compile(r"(?:[A-Z][^\s,0-9]*\x20|d[eu]\x20|la\x20){1,5}[0-9]{1,4}(?![0-9])|(?:[A-Z][^\s,0-9]*\x20?|d[eu]\x20|la\x20){1,5},\x20[0-9]{1,4}(?![0-9])")
_ACCOUNT = re.compile(r"(?:s?\x20*(?:no|number|id|#))?[.:=#\x20]{1,4}([A-Z]{0,2}[0-9][0-9-]{4,18}[0-9])", re.I | re.A)


@cache
def _anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    digits = "0123456789"
    for x in digits:
        a.add_word(f"+{x}", ("phone", 2))
        for y in digits:
            a.add_word(f"{x}.{y}", ("ip", 3))
            a.add_word(f"{x}{y}", ("card", 2))
            a.add_word(f"{x} {y}", ("card", 3))
            a.add_word(f"{x}-{y}", ("card", 3))
    a.add_word("@", ("email", 1))
    a.add_word("://", ("login", 3))
    for w in CUES:
        for v in {w, w.upper(), w.capitalize()}:
            a.add_word(v, ("iban" if w == "iban" else "account", len(v)))
    for w in STREETS:
        a.add_word(w, ("address", len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    over = dict.fromkeys(KINDS, 0)  # where each kind's last match, kept or dropped, ended
    for last, (kind, size) in _anchors().iter(text):
        at, end = last - size + 1, last + 1
        if at < over[kind]:
            continue
        if kind == "email":
            s = at
            while s > over[kind] and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, end)):
                found[kind].append((s, m.end()))
                over[kind] = m.end()
        elif kind == "ip":
            s = at
            while s > over[kind] and "0" <= text[s - 1] <= "9":
                s -= 1
            if m := _IP.match(text, s):
                over[kind] = m.end()
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                    found[kind].append(m.span())
        elif kind == "card":
            m = _CARD.match(text, at)
            over[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - at >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                found[kind].append(m.span())
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                over[kind] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found[kind].append(m.span())
        elif kind == "login":
            if m := _LOGIN.match(text, end):
                found[kind].append(m.span())
                over[kind] = m.end()
        elif kind == "address":
            if span := _address(text, at, end, over[kind]):
                found[kind].append(span)
                over[kind] = span[1]
        elif at and (text[at - 1].isalnum() or text[at - 1] == "_"):  # a cue inside a word
            continue
        elif m := (_IBAN if kind == "iban" else _ACCOUNT).match(text, end):
            if not _DAY.fullmatch(m[1]) if kind == "account" else _iban(m[1]):
                found[kind].append(m.span(1))
                over[kind] = m.end()
    return [(k, *x) for k in KINDS for x in found[k]]


def _address(text: str, at: int, end: int, least: int) -> tuple[int, int] | None:
    """The postal address around a street word: number and names before it, or names before or after it and then a number; with a town where one follows."""
    word = text[at:end]
    if word[0] == " ":
        line = text[max(least, at - 60) : at + 1]
        if not (m := _BEFORE.search(line)) or text[end : end + 1].isalnum():
            return None
        town = _TOWN.match(text, end)
        return at + 1 - len(line) + m.start(), town.end() if town else end
    if word[0].islower() and word[-1] != " ":
        m, house = _NAME.search(text[max(least, at - 40) : at]), _HOUSE.match(text, end)
        return (at - len(m[0]), house.end()) if m and house else None
    m = _CALLE.match(text, end)
    return (at, m.end()) if m and not text[at - 1 : at].isalnum() else None


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def scan_pii(documents: DataFrame) -> DataFrame:
    """doc_id and the spans of each row's whole text, as an array of (kind, start, end). A null text has none; each row gives one, rows that share a doc_id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in chunks(batches):
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")
