"""Approximate indexes: fit on the first rows by docid (bounded), assign a list and a code to every row, search probed lists.

Each index maps to columns of the table: `list_id` (write the table partitioned by it, and probes become partition
pruning) and for compressed kinds `code`. Search scores the rows of the probed lists, on codes where there are any, and
re-ranks the best `recall_num` with the raw vectors. With nprobe = ncentroids an IVFFLAT search equals the exact one, and
so does one on codes that is asked to be whole, at any number of rows.

HNSW and DISKANN_STATIC are graphs over shards of a list, walked in the task that reads the shard, and merged exactly;
GPU names are aliases of the CPU kinds. SCANN is not built.
"""

from __future__ import annotations

import io
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from math import sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vekspar.errors import Code, EngineError, param
from vekspar.functions.distance import COLUMNS, HIGHER, exact, significant
from vekspar.operators.search import matrix, query_blocks, ranked, top_k

# Defaults.
NCENTROIDS, NPROBE, BINARY_NCENTROIDS = 2048, 80, 256
#: Bytes of vectors that a fit may bring to the driver; fewer rows are taken where they would not fit.
FIT_BYTES = 256_000_000
#: Rows of (query, id) that a re-ranking broadcasts at most.
RERANK_ROWS = 200_000


def training_rows(n_lists: int, threshold: int = 0) -> int:
    """How many rows to fit on: 39 to 256 for each list."""
    if threshold < n_lists:
        return 39 * n_lists
    return min(threshold, 256 * n_lists)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; empty clusters restart at the points farthest from their centres."""
    x = x.astype(np.float32)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own, far = nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[np.argsort(-far)[: len(empty)]] if len(x) >= len(empty) else c[empty]
    return c


def _binary(codes: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """A binary column of n rows with a code of equal width at each of the given rows, null elsewhere."""
    at = np.zeros(n + 1, np.int32)
    at[rows + 1] = codes.shape[1]
    valid = np.zeros(n, bool)
    valid[rows] = True
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [bits, pa.py_buffer(np.cumsum(at, dtype=np.int32).tobytes()), pa.py_buffer(codes.tobytes())])


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    own, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    cc = (c * c).sum(1)
    for s in range(0, len(x), step):
        d = cc[None] - 2 * (x[s : s + step] @ c.T)
        own[s : s + step] = d.argmin(1)
        dist[s : s + step] = d.min(1) + (x[s : s + step] ** 2).sum(1)
    return own, dist


class VectorIndex(ABC):
    """Extension point: subclasses give fit, assign and search."""

    def __init__(self, vector: str, dim: int, metric: str = "InnerProduct", id_col: str = "_id", order: str = "_docid", **params):
        if metric not in HIGHER:
            raise param(f"metric {metric!r}")
        self.vector, self.dim, self.metric, self.id_col, self.order, self.params = vector, dim, metric, id_col, order, params
        self.ncentroids = int(params.get("ncentroids") or NCENTROIDS)
        self.nprobe = min(int(params.get("nprobe") or NPROBE), self.ncentroids)

    def _sample(self, data: DataFrame) -> np.ndarray:
        n = max(1, min(training_rows(self.ncentroids, int(self.params.get("training_threshold") or 0)), FIT_BYTES // (4 * self.dim)))
        got = data.where(F.col(self.vector).isNotNull()).orderBy(self.order).limit(n).select(self.vector).toArrow()
        rows, x = matrix(got.column(0).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())), self.dim, self.metric)
        if len(rows) < min(self.ncentroids, n):
            raise EngineError(Code.FORCE_MERGE_BUILD_INDEX_ERR, f"{len(rows)} vectors are too few to train {self.ncentroids} lists")
        return x

    def _map(self, data: DataFrame, extra: str, fn) -> DataFrame:
        """data with columns from fn(vectors); rows without a valid vector get list_id -1 and no code."""
        vector, dim, metric = self.vector, self.dim, self.metric
        names = data.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, x = matrix(b.column(names.index(vector)), dim, metric)
                cols = fn(x)
                own = np.full(b.num_rows, -1, np.int64)
                own[rows] = cols[0]
                out = [*b.columns, pa.array(own, pa.int32())]
                if len(cols) > 1:
                    out.append(_binary(np.ascontiguousarray(cols[1]), rows, b.num_rows))
                yield pa.RecordBatch.from_arrays(out, [*names, "list_id", *(["code"] if len(cols) > 1 else [])])

        from pyspark.sql import types as T

        return data.mapInArrow(run, T.StructType([*data.schema.fields, *T._parse_datatype_string(extra).fields]))

    def probes(self, queries: np.ndarray, nprobe: int | None) -> list[list[int]]:
        """The lists to search for each query; an invalid nprobe means the default."""
        n = nprobe if nprobe and 0 < nprobe <= self.ncentroids else self.nprobe
        q, c = queries.astype(np.float64), self.centroids.astype(np.float64)
        d = -(q @ c.T) if self.metric == "InnerProduct" else ((q[:, None] - c[None]) ** 2).sum(2) if len(q) * c.size < 5e7 else (c * c).sum(1)[None] - 2 * q @ c.T
        return np.argsort(d, axis=1, kind="stable")[:, :n].tolist()

    def dump(self) -> bytes:
        """The fitted state, for load(): parameters as JSON and arrays, in NumPy's archive format."""
        own = {k: v for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}
        plain = {"kind": self.kind, "vector": self.vector, "dim": self.dim, "metric": self.metric, "id_col": self.id_col, "order": self.order, "params": self.params, "state": {k: v for k, v in self.__dict__.items() if isinstance(v, int) and k != "dim"}}
        out = io.BytesIO()
        np.savez(out, _about=np.frombuffer(json.dumps(plain).encode(), np.uint8), **own)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> VectorIndex:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        about = json.loads(got["_about"].tobytes())
        model = make(about["kind"], about["vector"], about["dim"], about["metric"], id_col=about["id_col"], order=about["order"], **about["params"])
        for k in got.files:
            if k != "_about":
                setattr(model, k, got[k])
        for k, v in about["state"].items():
            setattr(model, k, v)
        return model

    @abstractmethod
    def fit(self, data: DataFrame) -> VectorIndex: ...

    @abstractmethod
    def assign(self, data: DataFrame) -> DataFrame: ...

    @abstractmethod
    def search(self, indexed: DataFrame, queries: Sequence[Sequence[float]], k: int, nprobe: int | None = None, **bounds) -> DataFrame: ...


class Flat(VectorIndex):
    def fit(self, data: DataFrame) -> Flat:
        return self

    def assign(self, data: DataFrame) -> DataFrame:
        return data

    def search(self, indexed, queries, k, nprobe=None, **bounds):
        return top_k(indexed, self.vector, queries, k, self.metric, self.id_col, **bounds)


class IvfFlat(VectorIndex):
    def fit(self, data: DataFrame) -> IvfFlat:
        self.centroids = kmeans(self._sample(data), self.ncentroids)
        return self

    def assign(self, data: DataFrame) -> DataFrame:
        c = self.centroids
        return self._map(data, "list_id int", lambda x: (nearest(x.astype(np.float32), c)[0],))

    def search(self, indexed, queries, k, nprobe=None, **bounds):
        q = np.asarray(queries, np.float64)
        return top_k(indexed, self.vector, q, k, self.metric, self.id_col, lists=("list_id", self.probes(q, nprobe)), **bounds)


class _Coded(IvfFlat):
    """Lists of codes: scored by `_scores`, then re-ranked on raw vectors."""

    def search(self, indexed, queries, k, nprobe=None, recall_num: int | None = None, where=None, min_score=None, max_score=None, whole: bool = False, **_):
        """whole: re-ranks, whatever recall_num, all rows of the probed lists that their codes do not rule out by a bound, so the result is that of IVFFLAT over these lists."""
        q = np.asarray(queries, np.float64)
        probes = self.probes(q, nprobe)
        if whole:
            table, decoded = self._tables(q[:0]), self._decoded
            return top_k(indexed, self.vector, q, k, self.metric, self.id_col, min_score, max_score, where, ("list_id", probes), ("code", lambda codes, lists: decoded(table, codes, lists)))
        n = max(k, recall_num or int(self.params.get("recall_num") or 0))
        up, id_col, kind = HIGHER[self.metric], self.id_col, dict(indexed.dtypes)[self.id_col]
        data = indexed if where is None else indexed.where(where)
        out = None
        for first, block in query_blocks(q):
            table, own_lists = self._tables(block), [np.array(p) for p in probes[first : first + len(block)]]
            coded = self._scores

            def run(batches, first=first, table=table, own_lists=own_lists):
                for b in batches:
                    lists = b.column(1).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(lists >= 0)
                    if not len(rows):
                        continue
                    codes = np.stack([np.frombuffer(c, np.uint8) for c in b.column(2).take(pa.array(rows)).to_pylist()])
                    for i, mine in enumerate(own_lists):
                        at = np.flatnonzero(np.isin(lists[rows], mine))
                        if len(at):
                            s = significant(coded(table, i, codes[at], lists[rows[at]]))
                            if len(s) > n:
                                keep = np.argpartition(-s if up else s, n - 1)[:n]
                                at, s = at[keep], s[keep]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + i), pa.int64()), b.column(0).take(pa.array(rows[at])), pa.array(s)], ["qid", id_col, "_score"])

            probed = sorted(set(np.concatenate(own_lists).tolist()))
            one = data.where(F.col("list_id").isin(probed)).select(id_col, "list_id", "code").mapInArrow(run, f"qid long, `{id_col}` {kind}, _score double")
            out = one if out is None else out.unionAll(one)
        best = ranked(out, n, up, id_col)
        if n <= k and not recall_num:
            bound = F.lit(True) if min_score is None else F.col("_score") >= min_score
            return best.where(bound if max_score is None else bound & (F.col("_score") <= max_score))
        return self._rerank(data, best, q, k, n, min_score, max_score)

    def _rerank(self, data: DataFrame, best: DataFrame, q: np.ndarray, k: int, recall_num: int, low, high) -> DataFrame:
        """The best by their codes, scored again on raw vectors: queries x recall_num rows, broadcast up to RERANK_ROWS, join the table."""
        qs = data.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, q array<double>")
        best = best.select("qid", self.id_col)
        if len(q) * max(k, recall_num) <= RERANK_ROWS:
            best = F.broadcast(best)
        rows = data.select(self.id_col, self.vector).join(best, self.id_col).join(F.broadcast(qs) if len(q) <= 1000 else qs, "qid")
        s = rows.select("qid", self.id_col, COLUMNS[self.metric](F.col(self.vector), F.col("q")).alias("_score"))
        if low is not None:
            s = s.where(F.col("_score") >= low)
        if high is not None:
            s = s.where(F.col("_score") <= high)
        return ranked(s, k, HIGHER[self.metric], self.id_col)


class IvfPq(_Coded):
    """Residual product quantiser of nsubvector parts, 256 words each; with opq, in a rotation that the parts quantise best."""

    def fit(self, data: DataFrame) -> IvfPq:
        x = self._sample(data).astype(np.float32)
        self.centroids = kmeans(x, self.ncentroids)
        m = int(self.params.get("nsubvector") or max(1, self.dim // 2))
        if self.dim % m:
            raise param(f"nsubvector {m} does not divide the dimension {self.dim}")
        r = x - self.centroids[nearest(x, self.centroids)[0]]
        self.rotation = np.eye(self.dim, dtype=np.float32)
        books = lambda y, rounds: np.stack([kmeans(y.reshape(len(y), m, -1)[:, i], min(256, len(y)), rounds) for i in range(m)])
        if self.params.get("opq"):  # alternate words and the rotation that brings residuals nearest to them (Procrustes)
            some = r[:: max(1, len(r) // 20_000)]
            for _ in range(6):
                y = some @ self.rotation
                words = books(y, 4)
                near = np.concatenate([words[i][nearest(y.reshape(len(y), m, -1)[:, i], words[i])[0]] for i in range(m)], axis=1)
                u, _, v = np.linalg.svd(some.T.astype(np.float64) @ near)
                self.rotation = (u @ v).astype(np.float32)
        self.books = books(r @ self.rotation, 12)
        return self

    def assign(self, data: DataFrame) -> DataFrame:
        c, books, turn = self.centroids, self.books, self.rotation

        def code(x: np.ndarray):
            x = x.astype(np.float32)
            own = nearest(x, c)[0]
            r = ((x - c[own]) @ turn).reshape(len(x), len(books), -1)
            return own, np.stack([nearest(r[:, i], books[i])[0] for i in range(len(books))], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(books)), np.uint8)

        return self._map(data, "list_id int, code binary", code)

    def _tables(self, block: np.ndarray):
        return block, self.centroids.astype(np.float64), self.books.astype(np.float64), self.metric, self.rotation.astype(np.float64)

    @staticmethod
    def _scores(table, i: int, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        q, c, books, metric, turn = table
        m, _, w = books.shape
        part = np.arange(m)
        if metric == "InnerProduct":
            adc = np.einsum("mkw,mw->mk", books, (q[i] @ turn).reshape(m, w))
            return adc[part, codes].sum(1) + c[lists] @ q[i]
        own, where = np.unique(lists, return_inverse=True)
        r = ((q[i] - c[own]) @ turn).reshape(len(own), m, w)
        adc = ((r[:, :, None, :] - books[None]) ** 2).sum(3)
        return adc[where[:, None], part[None], codes].sum(1)


    @staticmethod
    def _decoded(table, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        _, c, books, _, turn = table
        return c[lists] + books[np.arange(len(books)), codes].reshape(len(codes), -1) @ turn.T


class IvfRabitq(_Coded):
    """RaBitQ: residuals on the unit sphere, randomly rotated, each component on a grid of 2**nb_bits levels.

    A residual o = |o| u is coded by the grid point g nearest in direction to its rotation; stored beside the levels are
    |o| and <g, u>. The estimate of <u, q> is <g, q> / <g, u> (Gao and Long, RaBitQ, 2024; its extension to several
    bits), which is unbiased over rotations. qb: levels of the rotated query in bits, 0 for none (exact). centered:
    residuals of the lists' centres (else of the origin).
    """

    def fit(self, data: DataFrame) -> IvfRabitq:
        self.bits, self.qb = int(self.params.get("nb_bits") or 4), int(self.params.get("qb", 0) or 0)
        if not 1 <= self.bits <= 9:
            raise param("nb_bits should be in [1, 9]")
        if not 0 <= self.qb <= 8:
            raise param("qb should be in [0, 8]")
        self.centroids = kmeans(self._sample(data).astype(np.float32), self.ncentroids)
        self.origin = self.centroids if self.params.get("centered", True) else np.zeros_like(self.centroids)
        self.rotation = np.linalg.qr(np.random.default_rng(17).standard_normal((self.dim, self.dim)))[0]
        return self

    def assign(self, data: DataFrame) -> DataFrame:
        c, origin, rot, bits = self.centroids, self.origin, self.rotation, self.bits

        def code(x: np.ndarray):
            own = nearest(x.astype(np.float32), c)[0]
            r = (x - origin[own]) @ rot
            size = np.linalg.norm(r, axis=1, keepdims=True)
            u = r / np.where(size > 0, size, 1)
            top = (1 << bits) - 1
            best, align = np.zeros(u.shape, np.int64), np.full((len(u), 1), -1.0)
            widest = np.abs(u).max(1, keepdims=True) if len(u) else np.ones((0, 1))
            for part in (1.0,) if bits == 1 else (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4):  # the grid's width, by which the direction is nearest
                step = np.maximum(2 * widest * part / (top + 1), 1e-300)
                level = np.clip(np.floor(u / step) + (top + 1) // 2, 0, top).astype(np.int64)
                g = level - top / 2
                now = (g * u).sum(1, keepdims=True) / np.linalg.norm(g, axis=1, keepdims=True)
                better = now > align
                best, align = np.where(better, level, best), np.where(better, now, align)
            g = best - top / 2
            head = np.concatenate([size, (g * u).sum(1, keepdims=True)], axis=1).astype(np.float32)
            return own, np.concatenate([head.view(np.uint8).reshape(len(x), 8), best.astype("<u2" if bits > 8 else np.uint8).view(np.uint8).reshape(len(x), -1)], axis=1)

        return self._map(data, "list_id int, code binary", code)

    def _tables(self, block: np.ndarray):
        return block, self.rotation, self.origin.astype(np.float64), self.bits, self.qb, self.metric

    @staticmethod
    def _scores(table, i: int, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        q, rot, origin, bits, qb, metric = table
        head = np.ascontiguousarray(codes[:, :8]).view(np.float32).astype(np.float64)
        level = np.ascontiguousarray(codes[:, 8:])
        g = (level.view("<u2") if bits > 8 else level).astype(np.float64) - ((1 << bits) - 1) / 2
        own, where = np.unique(lists, return_inverse=True)
        away = q[i] - origin[own] if metric != "InnerProduct" else q[i][None]
        turned = away @ rot
        if qb:
            low = turned.min(1, keepdims=True)
            step = (turned.max(1, keepdims=True) - low) / ((1 << qb) - 1)
            turned = low + np.rint((turned - low) / np.where(step > 0, step, 1)) * step
        dot = (g @ turned[0] if len(turned) == 1 else (g * turned[where]).sum(1)) * head[:, 0] / np.where(head[:, 1] > 0, head[:, 1], 1)
        if metric == "InnerProduct":
            return dot + (origin[own] @ q[i])[where]
        return head[:, 0] ** 2 + (away * away).sum(1)[where] - 2 * dot


    @staticmethod
    def _decoded(table, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The nearest point to each row in the direction of its grid point."""
        _, rot, origin, bits, _, _ = table
        head = np.ascontiguousarray(codes[:, :8]).view(np.float32).astype(np.float64)
        level = np.ascontiguousarray(codes[:, 8:])
        g = (level.view("<u2") if bits > 8 else level).astype(np.float64) - ((1 << bits) - 1) / 2
        return origin[lists] + g * (head[:, 0] * head[:, 1] / (g * g).sum(1))[:, None] @ rot.T


class BinaryIvf(VectorIndex):
    """Hamming lists of packed bits (binary columns of dimension / 8 bytes); centres are bit majorities."""

    def __init__(self, vector: str, dim: int, metric: str = "Hamming", id_col: str = "_id", order: str = "_docid", **params):
        super().__init__(vector, dim, "Hamming", id_col, order, **{"ncentroids": BINARY_NCENTROIDS, **params})

    def fit(self, data: DataFrame) -> BinaryIvf:
        x = np.unpackbits(self._sample(data).astype(np.uint8), axis=1).astype(np.float32)
        self.centroids = (kmeans(x, self.ncentroids) > 0.5).astype(np.float32)
        return self

    def assign(self, data: DataFrame) -> DataFrame:
        c = self.centroids
        return self._map(data, "list_id int", lambda x: (nearest(np.unpackbits(x.astype(np.uint8), axis=1).astype(np.float32), c)[0],))

    def search(self, indexed, queries, k, nprobe=None, **bounds):
        q = np.asarray(queries, np.uint8)
        n = nprobe if nprobe and 0 < nprobe <= self.ncentroids else self.nprobe
        d = (np.unpackbits(q, axis=1)[:, None] != self.centroids[None]).sum(2)
        return top_k(indexed, self.vector, q, k, "Hamming", self.id_col, lists=("list_id", np.argsort(d, axis=1, kind="stable")[:, :n].tolist()), **bounds)


SHARD = 4096


def graph(x: np.ndarray, links: int, candidates: int, alpha: float = 1.2, seed: int = 3) -> np.ndarray:
    """Neighbours of each row (links columns, -1 where fewer): of its nearest candidates those that no nearer neighbour hides (Subramanya et al., DiskANN, 2019), links back, and two random ones."""
    n = len(x)
    out = np.full((n, links), -1, np.int32)
    if n < 2:
        return out
    xx = (x * x).sum(1)
    widest = max(4 * xx.max(), 1e-300)
    d, c = np.empty((n, n), np.float32), min(candidates, n - 1)  # as shares of the widest, half of a double's bytes
    near = np.empty((n, c), np.int32)
    for s in range(0, n, 256):
        part = np.maximum(xx[s : s + 256, None] + xx[None] - 2 * x[s : s + 256] @ x.T, 0) / widest
        part[np.arange(len(part)), np.arange(s, s + len(part))] = np.inf
        own = np.argpartition(part, c - 1, axis=1)[:, :c]
        near[s : s + 256] = np.take_along_axis(own, np.argsort(np.take_along_axis(part, own, 1), axis=1, kind="stable"), 1)
        d[s : s + 256] = part
    own, rng = [], np.random.default_rng(seed)
    for i in range(n):
        left, kept = near[i], []
        while len(left) and len(kept) < links // 2:
            kept.append(int(left[0]))
            left = left[1:][alpha * d[left[0], left[1:]] > d[i, left[1:]]]
        own.append(kept)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, kept in enumerate(own):
        for j in kept:
            back[j].append(i)
    far = rng.integers(0, n, (n, 2))
    for i in range(n):
        all_ = list(dict.fromkeys([*own[i], *(j for j in far[i].tolist() if j != i), *sorted(back[i], key=lambda j: d[i, j])]))[:links]
        out[i, : len(all_)] = all_
    return out


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, ef: int, metric: str) -> np.ndarray:
    """Rows found by a best-first walk that keeps the ef best, from the best of an evenly spread upper layer."""
    less = (lambda r: -(x[r] @ q)) if metric == "InnerProduct" else (lambda r: ((x[r] - q) ** 2).sum(1))
    start = np.arange(0, len(x), max(1, len(x) // 64))
    s = less(start)
    best = np.argsort(s, kind="stable")[: max(4, ef // 8)]
    rows, cost = start[best], s[best]
    seen = np.zeros(len(x), bool)
    seen[rows] = True
    open_ = np.ones(len(rows), bool)
    while open_.any():
        at = int(np.flatnonzero(open_)[0])  # rows are in rising cost
        open_[at] = False
        new = links[rows[at]]
        new = new[new >= 0]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        s = less(new)
        if len(rows) >= ef:
            ok = s < cost[-1]
            new, s = new[ok], s[ok]
        rows, cost, open_ = np.r_[rows, new], np.r_[cost, s], np.r_[open_, np.ones(len(new), bool)]
        order = np.argsort(cost, kind="stable")[:ef]
        rows, cost, open_ = rows[order], cost[order], open_[order]
    return rows


class GraphIndex(IvfFlat):
    """A neighbour graph over each shard of up to SHARD rows of a list: HNSW (nlinks, efConstruction, efSearch) and DISKANN_STATIC (R, L, l_search).

    code holds a row's shard, place, the shard's size and its neighbours' places. A task that reads a whole shard walks
    its graph; where rows are missing, as under a filter or at a file's cut, those there are scored all. So a filter
    loses no result, and shards' results are merged by exact scores.
    """

    @property
    def links(self) -> int:
        return int(self.params.get("nlinks") or self.params.get("R") or 32) * 2

    def __init__(self, vector: str, dim: int, metric: str = "L2", id_col: str = "_id", order: str = "_docid", **params):
        super().__init__(vector, dim, metric, id_col, order, **{"ncentroids": 1, **params})
        self.nprobe = min(int(params.get("nprobe") or max(8, self.ncentroids // 4)), self.ncentroids)

    def assign(self, data: DataFrame) -> DataFrame:
        from pyspark.sql import types as T

        rows = super().assign(data)
        names, links, vector, dim, metric, key_col = rows.columns, self.links, self.vector, self.dim, self.metric, self.id_col
        wide = int(self.params.get("efConstruction") or self.params.get("L") or 100)
        keys = [k for k in ("_bucket",) if k in names] + ["list_id"]

        def built(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for s in range(0, t.num_rows, SHARD):
                b = t.slice(s, SHARD)
                shard = crc32(str(b.column(names.index(key_col))[0].as_py()).encode()) & 0x7FFFFFFF  # told from its neighbours in a file
                ok, x = matrix(b.column(names.index(vector)), dim, metric)
                near = graph(x.astype(np.float64), links, wide)
                code = np.concatenate([np.stack([np.full(len(ok), shard), np.arange(len(ok)), np.full(len(ok), len(ok))], axis=1), near], axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays([*b.columns, _binary(code.view(np.uint8).reshape(len(ok), 4 * code.shape[1]), ok, b.num_rows)], [*names, "code"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last, size = [], None, 0
            for b in batches:
                k = np.stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in keys], axis=1)
                cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), b.num_rows]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    if e == s:
                        continue
                    if held and tuple(k[s]) != last:
                        yield from built(held)
                        held = []
                    last = tuple(k[s])
                    held.append(b.slice(s, e - s))
            if held:
                yield from built(held)

        schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType())])
        return rows.repartition(*keys).sortWithinPartitions(*keys, self.id_col).mapInArrow(run, schema)

    def search(self, indexed, queries, k, nprobe=None, ef: int | None = None, where=None, min_score=None, max_score=None, **_):
        q = np.asarray(queries, np.float64)
        probes = self.probes(q, nprobe)
        ef = max(k, int(ef or self.params.get("efSearch") or self.params.get("l_search") or 64))
        up, id_col, kind, vector, dim, metric = HIGHER[self.metric], self.id_col, dict(indexed.dtypes)[self.id_col], self.vector, self.dim, self.metric
        low, high = -np.inf if min_score is None else min_score, np.inf if max_score is None else max_score
        data = indexed if where is None else indexed.where(where)
        out = None
        for first, block in query_blocks(q):
            own_lists = [set(p) for p in probes[first : first + len(block)]]

            def found(ids: pa.Array, x: np.ndarray, code: np.ndarray, list_id: int, first: int = first, block: np.ndarray = block, own_lists: list = own_lists) -> Iterator[pa.RecordBatch]:
                whole = code[0, 2] == len(code) and min_score is None and max_score is None
                order = np.argsort(code[:, 1], kind="stable")
                x, links, who = x[order], code[order, 3:], []
                for i in range(len(block)):
                    if list_id not in own_lists[i]:
                        continue
                    at = walk(x, links, block[i], ef, metric) if whole else np.arange(len(x))
                    v = exact(metric, x[at], block[i])
                    ok = (v >= low) & (v <= high)
                    at, v = at[ok], v[ok]
                    cut = np.argsort(-v if up else v, kind="stable")
                    if len(cut) > k:  # with all that tie with the k-th
                        cut = np.flatnonzero((v >= v[cut[k - 1]]) if up else (v <= v[cut[k - 1]]))
                    who.append((np.full(len(cut), first + i), order[at[cut]], v[cut]))
                if who:
                    qid, at, v = (np.concatenate(c) for c in zip(*who, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), ids.take(pa.array(at)), pa.array(v)], ["qid", id_col, "_score"])

            def run(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
                held: dict[tuple, list] = {}
                for b in batches:
                    rows, x = matrix(b.column(1), dim, metric)
                    if not len(rows):
                        continue
                    code = np.frombuffer(b"".join(b.column(3).take(pa.array(rows)).to_pylist()), "<i4").reshape(len(rows), -1)
                    lists, ids = b.column(2).take(pa.array(rows)).to_numpy(zero_copy_only=False), b.column(0).take(pa.array(rows))
                    key = np.stack([lists, code[:, 0]], axis=1)
                    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(rows)]
                    for s, e in zip(cuts, cuts[1:], strict=False):
                        now = (int(key[s, 0]), int(key[s, 1]))
                        if now not in held:
                            for (list_id, _), parts in held.items():
                                yield from found(pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), list_id)
                            held = {now: []}
                        held[now].append((ids.slice(s, e - s), x[s:e], code[s:e]))
                for (list_id, _), parts in held.items():
                    yield from found(pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), list_id)

            probed = sorted(set().union(*own_lists))
            one = data.where(F.col("list_id").isin(probed)).select(id_col, vector, "list_id", "code").mapInArrow(run, f"qid long, `{id_col}` {kind}, _score double")
            out = one if out is None else out.unionAll(one)
        return ranked(out, k, up, id_col)


KINDS: dict[str, type[VectorIndex]] = {
    "FLAT": Flat, "IVFFLAT": IvfFlat, "GPU_IVFFLAT": IvfFlat, "HNSW": GraphIndex, "DISKANN_STATIC": GraphIndex,
    "IVFPQ": IvfPq, "GPU_IVFPQ": IvfPq, "IVFPQFastScan": IvfPq, "IVFRABITQ": IvfRabitq, "BINARYIVF": BinaryIvf,
}


def default_lists(rows: int) -> int:
    """About 4 sqrt(n) lists, the shape that recall is gated at."""
    return max(1, min(262_144, int(4 * sqrt(max(rows, 1))), rows // 39 or 1))


def make(kind: str, vector: str, dim: int, metric: str = "InnerProduct", **params) -> VectorIndex:
    if kind not in KINDS:
        raise param(f"index type {kind!r} has no implementation")
    model = KINDS[kind](vector, dim, metric, **params)
    model.kind = kind
    return model


def register(kind: str, index: type[VectorIndex]) -> None:
    """Adds an index kind, for make() and the engine."""
    if kind in KINDS or not issubclass(index, VectorIndex):
        raise param(f"index kind {kind!r}")
    KINDS[kind] = index


def from_description(text: str, vector: str, dim: int, metric: str = "InnerProduct", **params) -> VectorIndex:
    """An index from a factory string: Flat; IVF<lists>,Flat; IVF<lists>,PQ<parts>; OPQ<parts>,IVF<lists>,PQ<parts>; IVF<lists>,RaBitQ<bits>; HNSW<links>."""
    m = re.fullmatch(r"(?:(?P<opq>OPQ)\d*,)?(?:IVF(?P<lists>\d+),(?P<code>Flat|PQ(?P<parts>\d+)|RaBitQ(?P<bits>\d*))|(?P<flat>Flat)|HNSW(?P<links>\d+))", text)
    if not m or m["opq"] and not m["parts"]:
        raise param(f"index description {text!r}")
    if m["flat"]:
        return make("FLAT", vector, dim, metric, **params)
    if m["links"]:
        return make("HNSW", vector, dim, metric, nlinks=int(m["links"]), **params)
    more = {"ncentroids": int(m["lists"]), **({"nsubvector": int(m["parts"]), "opq": bool(m["opq"])} if m["parts"] else {}), **({"nb_bits": int(m["bits"] or 1)} if m["bits"] is not None else {})}
    return make("IVFPQ" if m["parts"] else "IVFRABITQ" if m["bits"] is not None else "IVFFLAT", vector, dim, metric, **more, **params)
