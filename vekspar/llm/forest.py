"""Embedding near-duplicates by a forest of random-projection trees with spill overlap (operator 4).

Equal vectors of a label are one class. A tree splits at the median projection on a random direction, recursively;
classes within the spill zone of a split go both ways. The trees of a label share their upper levels, down to parts of
about _room() classes, which a task holds; below them, each of TREES trees goes on in the part's task, in memory, until
no leaf has over LEAF classes or splitting one parts nothing, as in a cluster of vectors that all link. So a vector
travels once to each part that it is in, whatever the number of trees and leaves, and the driver holds no vectors.

Classes of one leaf are compared in single precision with a margin, and what that leaves in double precision, in tiles.
A pair that meets in several parts or leaves counts in the first only, so tasks return counts and spanning forests,
never pairs. A part that stays large, as no split parts it, is cut into blocks, which meet in pairs.

The spill zone below is 1.5 standard deviations of the projected difference of two vectors at the cosine threshold,
which parts such a pair at about one split in 200; it must be parted in every tree to be lost. The shared levels, where
parting loses the pair, have a zone of 4 deviations: about one split in a million parts it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vekspar.llm.common import Links, by_group, components, written

COSINE = 0.98
TREES = 4
LEAF, SPLIT = 256, 32_768
#: Shared levels at most, and classes that the cuts of a label are fitted on at least.
DEPTH, SAMPLE = 14, 4096
PART_BYTES = 72_000_000
BLOCK = 16_384
TILE = 512
SPILL, SHARED_SPILL = 0.75, 2.0
#: The share of a part that each child gets with the shared levels' spill.
CHILD = 0.66
#: What single precision may be off for each component, and more.
MARGIN = 1e-7


def _directions(nodes: int, dim: int) -> np.ndarray:
    d = np.random.default_rng(1000).standard_normal((nodes, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def fit(x: np.ndarray, depth: int, spill: float) -> np.ndarray:
    """The split points of a tree's first levels over unit vectors, nodes numbered as in a heap; infinite where the spill zone holds nearly all."""
    cuts, d, node = np.full(2**depth - 1, np.inf), _directions(2**depth - 1, x.shape[1]), np.zeros(len(x), np.int64)
    for level in range(depth):
        p = np.einsum("ij,ij->i", x, d[node])
        order = np.lexsort((p, node))
        first = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1)))
        for i, (s, e) in enumerate(zip(first, first[1:], strict=False)):
            own = p[order[s:e]]
            if e > s and (np.abs(own - np.median(own)) <= spill).mean() < 0.8:
                cuts[2**level - 1 + i] = np.median(own)
        node = 2 * node + 1 + (p > cuts[node])
    return cuts


def parts(x: np.ndarray, cuts: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) of unit vectors, by row and part."""
    depth, d = int(log2(len(cuts) + 1)), _directions(len(cuts), x.shape[1])
    at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(depth):
        p = np.einsum("ij,ij->i", x[at], d[node]) - cuts[node]
        low, high = p <= spill, p > -spill
        at, node = np.r_[at[low], at[high]], np.r_[2 * node[low] + 1, 2 * node[high] + 2]
    order = np.lexsort((node, at))
    return at[order], node[order]


def leaves(x: np.ndarray, spill: float) -> Iterator[np.ndarray]:
    """The leaves of TREES trees over unit vectors, as their rows."""
    rng = np.random.default_rng(1)
    for _ in range(TREES):
        todo = [np.arange(len(x), dtype=np.int32)]
        while todo:
            rows = todo.pop()
            if len(rows) > LEAF:
                d = rng.standard_normal(x.shape[1])
                p = x[rows] @ (d / np.linalg.norm(d)).astype(x.dtype)
                cut = np.median(p)
                low, high = rows[p <= cut + spill], rows[p > cut - spill]
                if max(len(low), len(high)) < 0.9 * len(rows):
                    todo += [low, high]
                    continue
            if len(rows) > 1:
                yield rows


def _vectors(data: pa.BinaryArray, dim: int, width: int) -> np.ndarray:
    """The vectors of an array without nulls, not copied."""
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset] if len(data) else 0
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[at : at + len(data) * dim * width].view(f"f{width}").reshape(-1, dim)


def _unit(data: pa.BinaryArray, dim: int, width: int) -> np.ndarray:
    x = _vectors(data, dim, width).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(vec_id, key) of each row, key null for one that links with nothing; (key, rep, weight, label, dim, vec) of each class; bytes of a component."""
    kind = embeddings.schema["embedding"].dataType
    width = 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, e = b.column("label").to_pylist(), b.column("embedding")
            ends = np.r_[0, np.cumsum(pc.list_value_length(e).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            x = e.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # a null is NaN
            some = np.flatnonzero(np.diff(ends))
            top = np.zeros(b.num_rows)
            if len(some):
                top[some] = np.maximum.reduceat(np.abs(x), ends[some])
            for i in np.flatnonzero(np.isfinite(top) & (top > 0) & ~((top > 1e-100) & (top < 1e100))).tolist():
                x[ends[i] : ends[i + 1]] /= top[i]
            with np.errstate(over="ignore"):
                data = x.astype(f"f{width}").tobytes()
            ok = (np.isfinite(top) & (top > 0)).tolist()
            vecs = [data[s:t] if good and lab is not None else None for s, t, good, lab in zip((ends[:-1] * width).tolist(), (ends[1:] * width).tolist(), ok, label, strict=True)]
            keys = [None if v is None else blake2b(v + str(lab).encode(), digest_size=16).digest() for v, lab in zip(vecs, label, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast("int64"), b.column("label").cast("int64"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "vec"])

    rows = embeddings.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label long, key binary, vec binary")
    c = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return written(rows.select("vec_id", "key"), "vectors"), written(c.withColumn("dim", (F.length("vec") / width).cast("int")), "vector-classes"), width


def _room(total: int, row_bytes: int) -> int:
    """Classes of a part: what a task holds, less where that makes few tasks."""
    return max(min(SPLIT, PART_BYTES // row_bytes), min(total // 16, PART_BYTES // row_bytes), 1)


def _dealt(mine: DataFrame, dim: int, width: int, spill: float) -> DataFrame:
    """mine (rep, label, weight, vec), each row once for each part (and pair of blocks bi, bj of it) that it is in, with the lesser parts that it is in too (before) and its block (own)."""
    room = _room(mine.count(), dim * width)
    large = mine.groupBy("label").count().where(F.col("count") > room)  # the rows over the room at most
    levels = F.least(F.lit(DEPTH), F.ceil(F.log(F.col("count") / room) / -log(CHILD))).cast("int")
    large = written(large.withColumn("depth", levels), "large-labels")

    def fitted(g: dict) -> Iterable[pa.RecordBatch]:
        x, depth = _unit(g["vec"], dim, width), g["depth"][0].as_py()
        yield pa.RecordBatch.from_arrays([g["label"][:1], pa.array([fit(x, max(1, min(depth, int(log2(max(2, len(x) / 16))))), spill).tobytes()], pa.binary())], ["label", "cuts"])

    share = F.greatest(F.lit(SAMPLE), F.lit(64) * F.pow(F.lit(2), "depth")) / F.col("count") * float(1 << 30)
    some = mine.join(F.broadcast(large), "label").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share).select("label", "depth", "vec")
    cuts = {r.label: np.frombuffer(bytes(r.cuts)) for r in by_group(some, ["label"], fitted, "label long, cuts binary").collect()}

    def placed(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
        """Some rows of a label, and the (row, part) of theirs."""
        label = b.column("label").to_numpy()
        for lab in np.unique(label).tolist():
            rows = np.flatnonzero(label == lab)
            step = max(1, 16_000_000 // (8 * dim))
            for s in range(0, len(rows), step):
                own = b.take(pa.array(rows[s : s + step]))
                at = np.arange(own.num_rows)
                yield own, lab, *(parts(_unit(own.column("vec"), dim, width), cuts[lab], spill) if lab in cuts else (at, np.zeros(len(at), np.int64)))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lab, _, part in placed(b):
                seen, n = np.unique(part, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), lab)), pa.array(seen), pa.array(n)], ["label", "part", "n"])

    blocks = {}
    if cuts:
        split = mine.join(F.broadcast(large.select("label")), "label", "left_semi").mapInArrow(sizes, "label long, part long, n long")
        blocks = {(r.label, r.part): -(-r.n // BLOCK) for r in split.groupBy("label", "part").agg(F.sum("n").alias("n")).where(F.col("n") > 1.5 * room).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, lab, at, part in placed(whole):
                first = np.searchsorted(at, at)
                n = np.arange(len(at)) - first  # lesser parts of its row
                before = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(part[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int32)))
                cut = np.array([blocks.get((lab, p), 1) for p in part.tolist()], np.int64)
                own = (b.column("rep").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % cut
                again = np.repeat(np.arange(len(at)), cut)
                other = np.arange(len(again)) - np.repeat(np.cumsum(cut) - cut, cut)
                step = max(1, 16_000_000 // (width * dim))
                for s in range(0, len(again), step):
                    i, o = again[s : s + step], other[s : s + step]
                    rows = b.take(pa.array(at[i]))
                    cols = [*(rows.column(k) for k in ("rep", "label", "weight", "vec")), before.take(pa.array(i)), *(pa.array(v) for v in (part[i], own[i], np.minimum(own[i], o), np.maximum(own[i], o)))]
                    yield pa.RecordBatch.from_arrays(cols, ["rep", "label", "weight", "vec", "before", "part", "own", "bi", "bj"])

    return mine.mapInArrow(deal, "rep long, label long, weight long, vec binary, before array<int>, part long, own long, bi long, bj long")


def _linked(x: np.ndarray, weight: np.ndarray, before: tuple[np.ndarray, np.ndarray], own: np.ndarray | None, cosine: float, spill: float) -> Links:
    """The links of a part's vectors. before: lengths and values of the lists of lesser parts that they are in; pairs that share one don't count. own: blocks, of which only pairs of unlike ones count."""
    norm, unit, links = np.zeros((len(x), 1)), np.zeros(x.shape, np.float32), Links(weight)
    for s in range(0, len(x), BLOCK):
        norm[s : s + BLOCK] = np.linalg.norm(x[s : s + BLOCK].astype(np.float64), axis=1, keepdims=True)
        unit[s : s + BLOCK] = x[s : s + BLOCK] / norm[s : s + BLOCK]
    found, least = list(leaves(unit, spill)), cosine - MARGIN * max(100, x.shape[1])
    length = np.array([len(f) for f in found], np.int64)
    who = np.r_[np.repeat(np.arange(len(x), dtype=np.int32), before[0]), *found].astype(np.int32)
    place = np.r_[-1 - before[1].astype(np.int32), np.repeat(np.arange(len(found), dtype=np.int32), length)]
    order = np.argsort(who, kind="stable")
    place, start = place[order], np.r_[0, np.cumsum(np.bincount(who, minlength=len(x)))]
    del who, order

    def met(rows: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(row number, place) of the places before the leaf."""
        n = start[rows + 1] - start[rows]
        i, p = np.repeat(np.arange(len(rows)), n), place[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return i[p < leaf], p[p < leaf]

    for leaf, rows in enumerate(found):
        for r in range(0, len(rows), TILE):
            for s in range(r, len(rows), TILE):
                a, b = rows[r : r + TILE], rows[s : s + TILE]
                near = unit[a] @ unit[b].T >= least
                if r == s:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                a, b = a[i], b[j]
                hit = near[np.ix_(i, j)] & ((x[a] / norm[a]) @ (x[b] / norm[b]).T >= cosine)
                if own is not None:
                    hit &= own[a][:, None] != own[b][None]
                (i, p), (j, q) = met(a, leaf), met(b, leaf)
                both, column = np.unique(np.r_[p, q], return_inverse=True)
                if len(both):
                    in_a, in_b = np.zeros((len(a), len(both)), np.float32), np.zeros((len(b), len(both)), np.float32)
                    in_a[i, column[: len(p)]] = 1
                    in_b[j, column[len(p) :]] = 1
                    hit &= in_a @ in_b.T == 0
                links.add(hit, a, b, False)
    return links


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings (vec_id, label: whole numbers; embedding: numbers).

    Linked: other rows of an equal, not null label whose vectors have that cosine or more; vectors of unequal length
    don't link, nor do null, empty or zero ones or those with null or non-finite components, which are their own
    components. component_id: the smallest vec_id reachable. Rows that share a vec_id are taken as connected through it.
    """
    spark = embeddings.sparkSession
    rows, c, width = _classes(embeddings)
    found = None
    for dim in sorted(r[0] for r in c.select("dim").distinct().collect()):  # a number for each length of vectors
        mine = c.where((F.col("dim") == dim) & F.col("rep").isNotNull()).select("rep", "label", "weight", "vec")
        deviation = sqrt(2 - 2 * cosine) / sqrt(dim)
        dealt = _dealt(mine, dim, width, SHARED_SPILL * deviation)

        def compare(g: dict, dim: int = dim, spill: float = SPILL * deviation) -> Iterable[pa.RecordBatch]:
            x = _vectors(g["vec"], dim, width)
            before = g["before"].value_lengths().to_numpy(), g["before"].flatten().to_numpy()
            own = g["own"].to_numpy() if g["bi"][0] != g["bj"][0] else None
            yield _linked(x, g["weight"].to_numpy(), before, own, cosine, spill).rows(g["rep"].to_numpy())

        one = by_group(dealt, ["part", "label", "bi", "bj"], compare, "id long, links long, other long")
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, other long")
    found = written(found, "vector-links")
    comp = components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")).join(comp, "rep", "left")
    per_class = c.select("key", "rep", "weight").join(links, "rep", "left").select("key", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.join(per_class, "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
