"""Secret scans (operator 8): fixed patterns, and values in credential contexts weighed by password guess cost.

The guess cost of a value is the least sum of log10 guesses over its segmentations into common words, dates, repeats
of a unit of up to PERIOD characters, straight keyboard walks and brute-force characters, found by dynamic programming
over all of them. A value that would take 10**MIN_COST guesses or more is reported as a span of kind guess, beside the
base kinds, which stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vekspar.llm.common import chunks
from vekspar.llm.common_words import COMMON

KINDS = ("assign", "access", "hex", "guess")
MIN_COST = 9.0
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Words that announce a credential.
CONTEXT = re.compile(
    r"(?:password|passwd|secret|token|api_?key|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|login|credentials?|auth|authorization|bearer|private_?key|access_?key|secret_?key|client_?secret)(?![A-Za-z0-9_]))"
    r"(?:[\"']?\x20*[:=]\x20*|\x20+is\x20+)(?:bearer\x20+)?([\"']?)(?=\S)",
    re.I | re.A,
)
# Where a value without quotes ends: at a space, a tag, a quote that ends it, or a separator before another name.
STOP = re.compile(r"\s|<(?=[A-Za-z/!])|[\"'](?=[\s,;:)}\]<>]|$)|[,;&](?=[\"']?[A-Za-z_][\w.-]*[\"']?[:=])", re.A)
_DOUBLE, _SINGLE = re.compile(r"[\"\n]"), re.compile(r"['\n]")
_AFTER = "\"'<>,;.:)]}"
# Common words of passwords, most usual first, and rows of the keyboard.
WORDS = """password admin welcome login letmein monkey dragon master hello freedom whatever secret access shadow superman
michael football baseball sunshine princess summer winter spring autumn love star test user root guest pass qwerty
default changeme example sample token key word home work house money happy family secure private system server
database manager office company internet computer january february march april june july august september october
november december monday tuesday wednesday thursday friday saturday sunday https:// http:// www. .com .org .net .html""".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
SHIFTED = "!@#$%^&*()"
PERIOD = 8

_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *COMMON]))}
_LONGEST = max(map(len, _RANK))
_LEET = str.maketrans("4@301!5$7", "aaeolisst")
_KEY = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)} | {c: (0, i) for i, c in enumerate(SHIFTED)}
#: Steps from a key to one beside it: along a row, straight down or up a column, or across.
_STEPS = {(0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d", re.A)


def _lower(value: str) -> str:
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The step between two keys side by side."""
    if a not in _KEY or b not in _KEY:
        return None
    step = _KEY[b][0] - _KEY[a][0], _KEY[b][1] - _KEY[a][1]
    return step if step in _STEPS else None


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation takes."""
    return _cost(value, math.log10(10) if value.isdigit() else math.log10(26 + 26 * (value != _lower(value)) + 10 * any(c.isdigit() for c in value) + 33 * (not value.isalnum())))


def _cost(value: str, card: float, units: dict[str, float] | None = None) -> float:
    """The dynamic program; card: the cost of a character by brute force. About linear in the value's length."""
    n, low = len(value), _lower(value)
    plain = low.translate(_LEET)
    units = {} if units is None else units
    same = {p: [0] * (n + 1) for p in range(1, min(PERIOD, n - 1) + 1)}  # how far value[i:] agrees with value[i + p:]
    for p, run in same.items():
        for i in range(n - p - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
    steps = [_step(low[i], low[i + 1]) for i in range(n - 1)]
    walk = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        if steps[i]:
            walk[i] = walk[i + 1] + 1 if i + 2 < n and steps[i] == steps[i + 1] else 2
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        if here + card < best[i + 1]:
            best[i + 1] = here + card
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            if rank := _RANK.get(low[i:j]) or _RANK.get(plain[i:j]):
                c = here + math.log10(rank + 10) + 0.5 * (value[i:j] != low[i:j]) + 0.5 * (low[i:j] not in _RANK)
                if c < best[j]:
                    best[j] = c
        for j in range(i + 4, min(n, i + 10) + 1):
            if value[i].isdigit() and _DATE.fullmatch(value, i, j):
                best[j] = min(best[j], here + (4.6 if j - i > 4 else 2.1))
        for p, run in same.items():
            most = run[i] // p + 1
            if most >= 2 and p * most >= 3:
                unit = value[i : i + p]
                if unit not in units:
                    units[unit] = _cost(unit, card, units)
                # what follows a run starts at its end or in its last characters: a run cut earlier costs more than a longer one
                for k in {*range(2, min(most, 4) + 1), *range(max(2, most - _LONGEST // p), most + 1)}:
                    if p * k >= 3:
                        best[i + p * k] = min(best[i + p * k], here + units[unit] + math.log10(k))
        for k in {*range(3, min(walk[i], 12) + 1)}:
            best[i + k] = min(best[i + k], here + 1.6 + math.log10(k))
    return best[n]


def values(text: str) -> list[tuple[int, int]]:
    """The whole values in credential contexts: to the closing quote or, without quotes, to where STOP says."""
    out, last = [], 0
    for m in CONTEXT.finditer(text):
        s = m.end()
        if m[1] and (shut := (_DOUBLE if m[1] == '"' else _SINGLE).search(text, s)) and shut[0] == m[1]:
            e = shut.start()
        else:
            if s >= last:  # else inside the one before, which ends at the same place
                stop = STOP.search(text, s)
                last = stop.start() if stop else len(text)
            e = last
            while e > s and text[e - 1] in _AFTER:
                e -= 1
        if e > s:
            out.append((s, e))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start, then kind as listed."""
    return _scan(text, values(text))


def _scan(text: str, whole: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    found, ends = [], {}
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append(("assign", m.start(), m.end()))
            ends.setdefault(m.start(2), set()).add(m.end(2))
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for s, e in whole:
        ends.setdefault(s, set()).add(e)
    done = 0
    for s, of in sorted(ends.items()):  # the longest of a whole value and its base span that is dear
        if max(of) <= done:
            continue
        if e := next((e for e in sorted(of, reverse=True) if e - s >= 8 and guess_cost(text[s:e]) >= MIN_COST), None):
            found.append(("guess", s, e))
            done = e
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def clean(text: str) -> str:
    """The text with its secrets masked, and with each base span the rest of the value that it begins."""
    whole = values(text)
    spans = _scan(text, whole)
    to = dict(whole)
    rest = [("assign", m.start(2), to[m.start(2)]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6 and m.start(2) in to] if spans else []
    return redact(text, sorted(spans + rest, key=lambda x: x[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and the spans of each row's whole text, as an array of (kind, start, end). A null text has none; each row gives one, rows that share a doc_id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in chunks(batches):
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_secrets(documents: DataFrame) -> DataFrame:
    """documents with every secret masked in `text` and `n_chars`, where there is one, counted anew; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            masked = [t if t is None else clean(t) for t in texts]
            cols = {n: b.column(n) for n in b.schema.names}
            cols["text"] = pa.array(masked, cols["text"].type)
            if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type):
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([o if a == c else len(c) for o, a, c in zip(old, texts, masked, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return documents.mapInArrow(run, documents.schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
