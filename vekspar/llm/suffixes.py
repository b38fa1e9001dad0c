"""Suffix-array dedup (operator 7): repeated byte strings found with a logarithmic family of suffix arrays.

A string of LENGTH bytes has one anchor, its first least-hashed run of GRAM bytes, which its content alone decides.
Positions whose strings have one anchor form a run; the suffixes at runs, about one in sixteen, make sparse suffix
arrays. They are ordered by fingerprints, of the anchor (64 bits) and then of the whole run's bytes (64 bits), instead
of the bytes themselves, so an entry has a fixed size.

Entries are sharded by anchor. In a shard, batches come in document order: a batch's array is merge-scanned against
each level for equal runs of smaller documents, then becomes a level, and levels of equal size merge, so n entries
take log(n) merges each. Runs equal as a whole are settled by that. Runs that share an anchor but differ, the ends of
matches, are taken apart: their single strings go through a second family, keyed by two fingerprints of the string.

So all strings of all texts are covered, positions are exact, and what decides is 128 bits of fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5, sha256
from itertools import batched
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vekspar.llm import packed
from vekspar.llm.common import carried, chunks, unused, written
from vekspar.llm.words import _BASE, mix, powers

LENGTH = 50
GRAM = 20
SHARD_BYTES = 16_000_000
FLUSH_BYTES = 40_000_000
STRINGS = 1_500_000
BATCH = 1 << 18
#: A text of more bytes is read in pieces of so many, so what a task needs beyond the text itself does not grow with it.
PIECE = 4_000_000
#: A document is told by its id and tx, a checksum of its text, as rows may share an id and differ in text.
RUN: packed.Layout = [("doc", "doc"), ("tx", "of"), ("p", "p4"), ("n", "u1"), ("a", "u8"), ("b", "u8")]
MARK: packed.Layout = [("doc", "doc"), ("tx", "of"), ("p", "p4"), ("n", "p4")]
ENTRIES, MARKS, ASKED = 0, 1, 2
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))


def _fingerprints(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() gets the fingerprint of any span."""
    return np.r_[np.uint64(0), np.cumsum((mix(np.arange(256, dtype=np.uint64) + np.uint64(77))[buf]) * powers(len(buf))[: len(buf)], dtype=np.uint64)]


_inverse_powers = np.ones(1, np.uint64)


def _span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < len(sums):
        _inverse_powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * len(sums), _INVERSE, np.uint64)], dtype=np.uint64)
    return mix((sums[end] - sums[start]) * _inverse_powers[start])


def runs(texts: list[bytes], length: int = LENGTH, start: int = 0) -> dict[str, np.ndarray]:
    """All runs of texts: text number (doc), first position p, positions n, anchor's and run's fingerprints a and b. start: where in a longer text the first one begins."""
    gram = min(GRAM, length)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    empty = {k: np.zeros(0, np.uint64 if k in "ab" else np.int64) for k in ("a", "b", "doc", "p", "n")}
    if len(buf) < length:
        return empty
    sums = _fingerprints(buf)
    at = np.arange(len(buf) - gram + 1)
    h = (_span(sums, at, at + gram) & ~np.uint64(0xFFFFF)) | ((at + start).astype(np.uint64) & np.uint64(0xFFFFF))
    width = length - gram + 1
    size = -(-len(h) // width) * width
    x = np.full(size, 2**64 - 1, np.uint64)
    x[: len(h)] = h
    x = x.reshape(-1, width)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - width + 1
    low = (np.minimum(after[:m], before[width - 1 : width - 1 + m]) & np.uint64(0xFFFFF)).astype(np.int64)
    pos = at[:m]
    anchor = pos + ((low - pos - start) & 0xFFFFF)
    inside = np.ones(m, bool)
    for e in end[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False  # strings that would cross the end of a text
    pos, anchor = pos[inside], anchor[inside]
    if not len(pos):
        return empty
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (pos[1:] != pos[:-1] + 1)])
    n = np.diff(np.r_[first, len(pos)])
    p, c = pos[first], anchor[first]
    doc = np.searchsorted(end, p, side="right")
    return {"a": _span(sums, c, c + gram), "b": _span(sums, p, p + n + length - 1) ^ mix((c - p + n * 1000).astype(np.uint64)), "doc": doc, "p": p - np.r_[0, end][doc], "n": n}


def long_runs(text: bytes, length: int, piece: int) -> Iterator[dict[str, np.ndarray]]:
    """The runs of a long text, those that start in each piece of it in turn; pieces overlap by more than a run."""
    width = length - min(GRAM, length) + 1  # positions of the longest run
    for s in range(0, max(0, len(text) - length + 1), piece):
        low = max(0, s - width)
        e = runs([text[low : s + piece + width + length]], length, low)
        e["p"] = e["p"] + low
        mine = (e["p"] >= s) & (e["p"] < s + piece)
        yield {k: v[mine] for k, v in e.items()}


def strings(text: bytes, p: np.ndarray, n: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Positions p of all strings of runs, with two fingerprints."""
    at = np.repeat(p - (np.cumsum(n) - n), n) + np.arange(n.sum())
    buf = np.frombuffer(text, np.uint8)
    a = _span(_fingerprints(buf), at, at + length)
    b = _span(_fingerprints(np.bitwise_xor(buf[::-1], 0x5A)), len(buf) - at - length, len(buf) - at)
    return {"a": a, "b": b, "p": at, "n": np.ones(len(at), np.int64)}


class IndexFamily:
    """Levels of arrays of (a, b, smallest doc) in order of (a, b), each level's size about twice the next one's or more."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _find(level: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries, given in order, the level has, and its documents for them."""
        la, lb, ld = level
        lo = np.searchsorted(la, a)
        some = np.flatnonzero(la[np.minimum(lo, len(la) - 1)] == a)
        a, b, lo = a[some], b[some], lo[some]
        end = np.searchsorted(la, a, "right")
        hi = end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (lb[np.minimum(mid, len(lb) - 1)] < b)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, len(lb) - 1)
        same = (lo < end) & (lb[at] == b)
        return some[same], ld[at[same]]

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Takes a batch, none of whose documents is smaller than one taken before; which entries a smaller document has."""
        if not len(a):
            return np.zeros(0, bool)
        order = in_order(a, b)
        first, group = _groups(a[order], b[order])
        level = a[order[first]], b[order[first]], np.minimum.reduceat(doc[order], first)
        least = level[2].copy()
        for older in self.levels:
            at, docs = self._find(older, *level[:2])
            least[at] = np.minimum(least[at], docs)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a2, b2, d2 = (np.concatenate(x) for x in zip(self.levels.pop(-2), self.levels.pop(), strict=True))
            o = in_order(a2, b2, merge=True)
            first = _groups(a2[o], b2[o])[0]
            self.levels.append((a2[o[first]], b2[o[first]], np.minimum.reduceat(d2[o], first)))
        found = np.zeros(len(order), bool)
        found[order] = doc[order] > least[group]
        return found


def in_order(a: np.ndarray, b: np.ndarray, merge: bool = False) -> np.ndarray:
    """The order by (a, b), few rows having equal a; merge: a is two ordered runs, which a stable sort merges."""
    order = np.argsort(a, kind="stable" if merge else None)
    same = a[order[1:]] == a[order[:-1]]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    rows = order[tied]
    order[tied] = rows[np.lexsort((b[rows], a[rows]))]
    return order


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal (a, b), and each row's group; rows in order, one at least."""
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _settle(e: dict[str, np.ndarray]) -> np.ndarray:
    """Which entries a smaller document has, by the family; e in any order."""
    order = np.argsort(e["doc"], kind="stable")
    found, family = np.zeros(len(order), bool), IndexFamily()
    for s in range(0, len(order), BATCH):
        o = order[s : s + BATCH]
        found[o] = family.add(e["a"][o], e["b"][o], e["doc"][o])
    return found


def _differing(e: dict[str, np.ndarray]) -> np.ndarray:
    """Entries whose anchor has runs of other content too."""
    order = in_order(e["a"], e["b"])
    a, b = e["a"][order], e["b"][order]
    if not len(a):
        return order
    new = np.r_[True, a[1:] != a[:-1]]
    group = np.cumsum(new) - 1
    kinds = np.add.reduceat((np.r_[True, b[1:] != b[:-1]] | new).astype(np.int64), np.flatnonzero(new))
    return order[kinds[group] > 1]


def _dedup(marks: dict[str, np.ndarray], shards: int, kind: int, width: int) -> Iterator[pa.RecordBatch]:
    """Marks or questions, neighbouring ones joined, on their way to their document's shard."""
    order = np.lexsort((marks["p"], marks["tx"], marks["doc"]))
    d, t, p, n = (marks[k][order].astype(np.int64) for k in ("doc", "tx", "p", "n"))
    if not len(d):
        return
    new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + n[:-1])]
    first = np.flatnonzero(new)
    n = np.maximum.reduceat(p + n, first) - p[first]
    yield from packed.deal(MARK, {"doc": d[first], "tx": t[first], "p": p[first], "n": n}, packed.shard_of(d[first], shards), kind, width)


def repeated_bytes(documents: DataFrame, length: int = LENGTH, shared: bool = True) -> DataFrame:
    """(doc_id, tx, marks): for each text with any, the positions at which strings of `length` bytes start that also start in a text with a smaller doc_id.

    marks: packed pairs (position, count). doc_id must not be null; tx is crc32 of the text, or 0 where shared says that
    no two rows have one doc_id, which saves a sixth of what is shuffled.
    """
    sum_of = crc32 if shared else lambda text: 0
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = max(1, -(-total // SHARD_BYTES))
    wide, piece = packed.first_width(shards), PIECE

    def sent(e: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Entries of a task: marks of those that it settles, the others dealt to their shards."""
        done = _settle(e)
        yield from _dedup({k: e[k][done] for k in ("doc", "tx", "p", "n")}, shards, MARKS, wide)
        e = {k: v[~done] for k, v in e.items()}
        yield from packed.deal(RUN, e, packed.shard_of(e["a"], shards), ENTRIES, wide)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        least: dict[bytes, tuple[int, int]] = {}  # text: number, smallest id
        txs: list[int] = []
        copies: list[tuple[bytes, int, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.zeros(len(least), np.int64)
            for i, d in least.values():
                ids[i] = d
            e = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()
            e["tx"], e["doc"] = np.array(txs, np.int64)[e["doc"]], ids[e["doc"]]
            whole = [(d, t, 0, n - length + 1) for k, d, t, n in copies if d != least[k][1] and n >= length]
            cols = [np.array(x, np.int64) for x in zip(*whole, strict=True)] if whole else [np.zeros(0, np.int64)] * 4
            yield from _dedup(dict(zip(("doc", "tx", "p", "n"), cols, strict=True)), shards, MARKS, wide)
            yield from sent(e)

        for b in chunks(batches):
            new = []
            start = len(txs)
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                tx = sum_of(t)
                if len(t) > piece:
                    for some in batched(long_runs(t, length, piece), 8):
                        e = {k: np.concatenate([h[k] for h in some]) for k in some[0]}
                        e["doc"], e["tx"] = np.full(len(e["p"]), d), np.full(len(e["p"]), tx)
                        yield from sent(e)
                    continue
                key = md5(t, usedforsecurity=False).digest()
                copies.append((key, d, tx, len(t)))
                if key in least:
                    least[key] = (least[key][0], min(least[key][1], d))
                else:
                    least[key] = (len(txs), d)
                    txs.append(tx)
                    new.append(t)
            e = runs(new, length)
            e["doc"] = e["doc"] + start
            held.append(e)
            size += sum(map(len, new))
            if size >= FLUSH_BYTES:
                yield from flush()
                held, least, txs, copies, size = [], {}, [], [], 0
        if held:
            yield from flush()

    def settle(shard: int, rows: dict[int, list[bytes]]) -> Iterable[pa.RecordBatch]:
        for x in rows.get(MARKS, ()):
            yield packed.batch([(shard, shard, MARKS, x)])
        e = packed.unpack(RUN, rows.get(ENTRIES, ()))
        done = _settle(e)
        yield from _dedup({k: v[done] for k, v in e.items()}, shards, MARKS, 1)
        ask = _differing(e)  # settled runs have an equal one of a smaller document, which is asked instead
        ask = ask[~done[ask]]
        yield from _dedup({k: v[ask] for k, v in e.items()}, shards, ASKED, 1)

    def settle_strings(shard: int, rows: dict[int, list[bytes]]) -> Iterable[pa.RecordBatch]:
        for x in rows.get(MARKS, ()):
            yield packed.batch([(shard, shard, MARKS, x)])
        e = packed.unpack(RUN, rows.get(ENTRIES, ()))
        done = _settle(e)
        yield from _dedup({k: v[done] for k, v in e.items()}, shards, MARKS, 1)

    def per_document(shard: int, rows: dict[int, list[bytes]]) -> Iterable[pa.RecordBatch]:
        for kind, blobs in rows.items():
            m = packed.unpack(MARK, blobs)
            order = np.lexsort((m["p"], m["tx"], m["doc"]))
            m = {k: v[order] for k, v in m.items()}
            first = np.flatnonzero(np.r_[True, (m["doc"][1:] != m["doc"][:-1]) | (m["tx"][1:] != m["tx"][:-1])])
            pairs = np.stack([m["p"], m["n"]], axis=1).astype(np.uint32)
            for at in range(0, len(first), 2000):
                part = first[at : at + 2000]
                ends = np.r_[first, len(order)][at + 1 : at + 1 + len(part)]
                yield pa.RecordBatch.from_arrays([pa.array(m["doc"][part]), pa.array(m["tx"][part]), pa.array([kind] * len(part), pa.int32()), pa.array([pairs[s:e].tobytes() for s, e in zip(part, ends, strict=True)], pa.binary())], ["doc_id", "tx", "kind", "marks"])

    shape = "doc_id long, tx long, kind int, marks binary"
    dealt = packed.regroup(docs.mapInArrow(index, packed.SCHEMA), RUN, "a", shards, ENTRIES)
    found = written(packed.by_shard(packed.by_shard(dealt, settle, shards=shards), per_document, shape, shards), "runs")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            e = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()
            yield from sent(e)

        for b in chunks(batches):
            for d, tx, asked, t in zip(b.column("doc_id").to_pylist(), b.column("tx").to_pylist(), b.column("marks").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if sum_of(t) != tx:
                    continue
                pairs = np.frombuffer(asked, np.uint32).reshape(-1, 2).astype(np.int64)
                for s in range(0, len(t), piece):
                    p, end = np.maximum(pairs[:, 0], s), np.minimum(pairs.sum(axis=1), s + piece)
                    some = p < end
                    if not some.any():
                        continue
                    e = strings(t[s : s + piece + length], p[some] - s, (end - p)[some], length)
                    e["p"] = e["p"] + s
                    e["doc"], e["tx"] = np.full(len(e["p"]), d), np.full(len(e["p"]), tx)
                    held.append(e)
                    count += len(e["p"])
                    if count >= STRINGS:
                        yield from flush()
                        count = 0
        if held:
            yield from flush()

    asked = found.where(f"kind = {ASKED}").drop("kind").join(docs, "doc_id").select("doc_id", "tx", "marks", "text")
    dealt = packed.regroup(asked.mapInArrow(take_apart, packed.SCHEMA), RUN, "a", shards, ENTRIES)
    more = written(packed.by_shard(packed.by_shard(dealt, settle_strings, shards=shards), per_document, shape, shards), "strings")  # frees the shuffled strings before the texts are joined
    marks = found.where(f"kind = {MARKS}").unionAll(more)
    return marks.groupBy("doc_id", "tx").agg(F.collect_list("marks").alias("marks"))  # one list from each family at most


def covered(marks: Iterable[bytes], length: int = LENGTH) -> np.ndarray:
    """Maximal spans (start, end) of the bytes that marked strings cover, in order."""
    pairs = np.frombuffer(b"".join(marks), np.uint32).reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] + length - 1)
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return np.stack([start[first], end[np.r_[first[1:] - 1, len(end) - 1]]], axis=1)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with `removed`, the spans (start, end) of bytes of the UTF-8 text that repeat, and `kept`, the remaining bytes; all rows and other columns stay.

    A byte repeats if a string of `length` bytes that covers it also starts in a document with a smaller doc_id, judged
    on the texts as they came in; matches never cross documents. A null text is an empty one; a row with a null doc_id
    neither repeats nor is repeated. Rows with equal ids are not compared with each other, whether their texts are
    equal or not. Columns of documents named removed or kept are replaced.
    """
    plain = documents.drop("removed", "kept")
    names, found = plain.columns, unused(plain, "_marks")
    shared = bool(documents.where("doc_id is not null").groupBy(F.col("doc_id").cast("long")).count().where("count > 1").limit(1).count())
    marks = repeated_bytes(documents, length, shared).select(F.col("doc_id").alias("_id"), F.col("tx").alias("_tx"), F.col("marks").alias(found))
    rows = carried(plain, _id=F.col("doc_id").cast("long"), _tx=F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if shared else F.lit(0).cast("long"))
    rows = rows.join(marks, ["_id", "_tx"], "left").select("row.*", found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in chunks(batches):
            removed, kept = [], []
            for t, m in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column(found).to_pylist(), strict=True):
                spans, t = covered(m or (), length).tolist(), t or b""
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept.append(b"".join(t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": s, "end": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(removed, span), pa.array(kept, pa.binary())], [*names, "removed", "kept"])

    shape = T.StructType([*plain.schema.fields, *T._parse_datatype_string("removed array<struct<start:bigint,end:bigint>>, kept binary").fields])
    return rows.mapInArrow(run, shape)


def digest(kept: bytes) -> str:
    return sha256(kept).hexdigest()
