"""Benchmark decontamination (operator 2): SimHash of item-sized windows and a multi-index over Hamming blocks.

A fingerprint has 64 bits, the signs of the sums of a window's word hashes. It is cut into BLOCKS blocks; two
fingerprints within RADIUS bits agree in at least one block up to RADIUS // BLOCKS = 2 bits, so a table of every item's
blocks with up to two bits flipped finds all items within the radius (pigeonhole). Each candidate is verified by the
exact weighted Jaccard similarity of shingle counts.

Only windows with enough shingles that some item holds to reach the similarity are fingerprinted; the others cannot.

The benchmark comes to the tasks in blocks of about ITEM_CHARS characters, whatever its size: a larger benchmark takes
more passes, not more memory. Of several blocks, each one's pass is written to the shared folder before the next is
read, so that the driver holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vekspar.llm.common import chunks, dropped, made, written
from vekspar.llm.words import _STEP, WIDTH, mix, shingles, words

SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 7
ITEM_CHARS = 4_000_000
_CUTS = np.array([0, 10, 19, 28, 37, 46, 55, 64])


def _signs(w: np.ndarray) -> np.ndarray:
    """+1 or -1 for each word and bit."""
    return (np.unpackbits(w[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1).astype(np.int8)


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def grams(w: np.ndarray, size: int) -> np.ndarray:
    """The shingles of a run of words that is part of a window of so many words; as in words.shingles."""
    k = min(size, WIDTH)
    n = len(w) - k + 1
    s = np.full(max(n, 0), size if size < WIDTH else 0, np.uint64)
    for j in range(k):
        s += w[j : j + max(n, 0)] * _STEP[j]
    return mix(s)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = np.minimum(ca[ia], cb[ib]).sum()
    return float(both / (len(a) + len(b) - both)) if len(a) + len(b) else 0.0


class Items:
    """The multi-index of a block of items. An item without words matches nothing."""

    def __init__(self, ids: list, texts: list[str | None]):
        w, at = words(texts)
        self.ids, self.grams, self.sizes = [], [], []
        prints = []
        for i, item in enumerate(ids):
            own = w[at[i] : at[i + 1]]
            if len(own):
                self.ids.append(item)
                self.sizes.append(len(own))
                self.grams.append(grams(own, len(own)))
                prints.append(_prints(_signs(own).sum(0, dtype=np.int32)[None])[0])
        self.prints = np.array(prints, np.uint64)
        self.known = {k: np.unique(np.concatenate([g for g, n in zip(self.grams, self.sizes, strict=True) if min(n, WIDTH) == k and (k == WIDTH or n == k)])) for k in {min(n, WIDTH) for n in self.sizes}}
        self.maybe = {k: _bitmap(v) for k, v in self.known.items()}
        self.index = {}
        sizes = np.array(self.sizes)
        for n in set(self.sizes):
            mine = np.flatnonzero(sizes == n)
            for b in range(BLOCKS):
                bits = int(_CUTS[b + 1] - _CUTS[b])
                part = (self.prints[mine] >> np.uint64(_CUTS[b])) & np.uint64((1 << bits) - 1)
                flips = sorted({1 << x | 1 << y for x in range(bits) for y in range(bits)} | {0})
                keys = np.concatenate([part ^ np.uint64(x) for x in flips]).astype(np.int64)
                who = np.tile(mine, len(flips))
                order = np.argsort(keys, kind="stable")
                self.index[n, b] = (np.searchsorted(keys[order], np.arange((1 << bits) + 1)), who[order])

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item of that size) within RADIUS bits."""
        found = []
        for b in range(BLOCKS):
            offsets, who = self.index[size, b]
            v = ((prints >> np.uint64(_CUTS[b])) & np.uint64((1 << int(_CUTS[b + 1] - _CUTS[b])) - 1)).astype(np.int64)
            n = offsets[v + 1] - offsets[v]
            win = np.repeat(np.arange(len(v)), n)
            item = who[np.repeat(offsets[v] - (np.cumsum(n) - n), n) + np.arange(len(win))]
            ok = np.bitwise_count(prints[win] ^ self.prints[item]) <= RADIUS
            found.append(win[ok] * len(self.prints) + item[ok])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))

    def matches(self, texts: list[str | None], least: float = SIMILARITY) -> list[tuple[int, object, float, int, int]]:
        """(text number, item id, similarity, first word, words) of each text and item, at its most similar window (the first of equals)."""
        out = []
        if not self.ids:
            return out
        w, at = words(texts)
        hits = {}
        for k, known in self.known.items():
            s = grams(w, k) if len(w) >= k else np.zeros(0, np.uint64)
            may = np.flatnonzero(self.maybe[k][(s >> np.uint64(44)).astype(np.int64)])
            may = may[known[np.minimum(np.searchsorted(known, s[may]), len(known) - 1)] == s[may]]
            doc = np.searchsorted(at, may, side="right") - 1
            inside = may + k <= at[doc + 1]
            for d in np.unique(doc[inside]):
                hits.setdefault(d, {})[k] = may[inside & (doc == d)] - at[d]
        for d, by_width in sorted(hits.items()):
            own = w[at[d] : at[d + 1]]
            sums = np.zeros((len(own) + 1, 64), np.int32)
            np.cumsum(_signs(own), axis=0, dtype=np.int32, out=sums[1:])
            best: dict[int, tuple[float, int]] = {}
            for size in sorted(set(self.sizes)):
                k = min(size, WIDTH)
                at_k = by_width.get(k)
                if at_k is None:
                    continue
                span = min(size, len(own))  # a shorter text is its only window
                n = span - k + 1
                held = np.zeros(len(own) + 1, np.int64)
                held[at_k + 1] = 1
                held = np.cumsum(held)
                starts = np.flatnonzero(held[n : len(own) - k + 2] - held[: len(own) - span + 1] >= least * (n + size - k + 1) / (1 + least) - 1e-6)
                if not len(starts):
                    continue
                for p, i in zip(*self.near(_prints(sums[starts + span] - sums[starts]), size), strict=True):
                    sim = similarity(grams(own[starts[p] : starts[p] + span], span), self.grams[i])
                    if sim >= least and sim > best.get(i, (0.0, 0))[0]:
                        best[i] = (sim, int(starts[p]))
            out += [(int(d), self.ids[i], sim, p, min(self.sizes[i], len(own))) for i, (sim, p) in sorted(best.items())]
        return out


def _bitmap(values: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(values >> np.uint64(44)).astype(np.int64)] = True
    return seen


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """Multi-indexes over all items, in blocks of about ITEM_CHARS characters, and whether it is one of several."""
    b = benchmark.select("item_id", "text").where("text is not null")
    n = max(1, -(-int(b.agg(F.sum(F.length("text") + 40)).first()[0] or 0) // ITEM_CHARS))
    for i in range(n):
        rows = sorted(b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect(), key=lambda r: (r[0] is None, r[0], r[1]))
        yield Items([r[0] for r in rows], [r[1] for r in rows]), n > 1


def find_leaks(documents: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, word_start, n_words: each document with each item that it holds at `least` or more.

    benchmark: item_id, text. Null and wordless texts hold nothing and leak nothing; equal items are reported each.
    """
    kind, item = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item}, similarity double, word_start long, n_words long"
    out = None
    for items, several in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                if got := items.matches(b.column("text").to_pylist(), least):
                    d, i, s, p, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(i), pa.array(s), pa.array(p, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "similarity", "word_start", "n_words"])

        one = documents.select("doc_id", "text").mapInArrow(run, schema)
        one = written(one, "leaks") if several else one  # so that the driver holds one block
        out = one if out is None else out.unionAll(one)
    return out


def drop_leaks(documents: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """documents without the rows that hold an item; all columns stay."""
    rest, last = documents, made()
    for items, several in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                bad = {d for d, *_ in items.matches(b.column("text").to_pylist(), least)}
                yield b.take(pa.array([i for i in range(b.num_rows) if i not in bad], pa.int64())) if bad else b

        rest = rest.mapInArrow(run, documents.schema)
        if several:  # so that the driver holds one block
            rest = written(rest, "unleaked")
            dropped(documents.sparkSession, last, rest)
    return rest
