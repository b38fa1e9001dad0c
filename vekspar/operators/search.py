"""Exact top-k search, score bounds, paging and multi-vector fusion.

The kernel is one scan: the queries, a request's literal list, go to the tasks in blocks of bounded size; each Arrow
batch is scored roughly by matrix products of at most CELLS scores, with a bound of their error; rows that may be among
the k best are scored exactly. A task keeps k rows for each query, and only those are shuffled, by query. So the shuffle
is tasks x queries x k rows whatever the table holds. Filters stay below the kernel, at the Parquet scan.

Scores are in double precision at any scale of the vectors, to fifteen significant digits, with ties by id, so results
don't depend on the plan; fewer digits would be rounded twice where a query shows nine decimals. L2 is squared. Rows without a vector, or with one of another length, are never found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vekspar.errors import param
from vekspar.functions.distance import HIGHER, exact, moved, rough
from vekspar.sources.scratch import written

QUERY_BYTES = 16_000_000
CELLS = 1_000_000
#: Rows of a batch that a task returns.
ROWS = 100_000


def query_blocks(queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query number, block) of at most QUERY_BYTES each."""
    step = max(1, QUERY_BYTES // max(1, queries.shape[1] * 8))
    for s in range(0, len(queries), step):
        yield s, queries[s : s + step]


def matrix(column: pa.Array, dim: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a vector column that have the dimension and no null component, and their vectors."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        lens = np.array([-1 if v is None else len(v) for v in column.to_pylist()])
        ok = np.flatnonzero(lens == dim)
        return ok, np.frombuffer(b"".join(column.take(pa.array(ok)).to_pylist()), np.uint8).reshape(-1, dim)
    lens = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(lens == dim)
    flat = column.take(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    if metric == "Hamming":
        return ok, x.astype(np.int64)
    good = np.isfinite(x).all(1) if len(x) else np.zeros(0, bool)
    return ok[good], x[good]


def top_k(
    data: DataFrame, vector: str, queries: Sequence[Sequence[float]] | np.ndarray, k: int, metric: str = "InnerProduct", id_col: str = "_id",
    min_score: float | None = None, max_score: float | None = None, where: Column | None = None, lists: tuple[str, Sequence[Sequence[int]]] | None = None,
    codes: tuple[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """qid, id_col, _score and _rank of the k best rows for each query, bounds (both inclusive) applied before the cut.

    lists: a whole-number column and, for each query, its values that may be searched (an inverted-list index).
    codes: with lists, a column of codes and the vectors that (codes, lists) stand for; rows are left out by the scores
    of these and a bound of what their distance to the rows' own vectors can change, the others are scored exactly.
    """
    if metric not in HIGHER:
        raise param(f"metric {metric!r}")
    q = np.asarray(queries)
    if q.ndim != 2 or not q.shape[1]:
        raise param("queries must be a list of vectors of one length")
    if metric != "Hamming" and not np.isfinite(q.astype(np.float64)).all():
        raise param("a query vector holds NaN or infinity")
    if k <= 0:
        raise param("limit must be above 0")
    d = data if where is None else data.where(where)
    low, high, up = -np.inf if min_score is None else min_score, np.inf if max_score is None else max_score, HIGHER[metric]
    kind = dict(data.dtypes)[id_col]
    cols = [id_col, vector, *([lists[0]] if lists else []), *([codes[0]] if codes else [])]
    out = None
    for first, block in query_blocks(q):
        probes = [np.array(sorted(x)) for x in lists[1][first : first + len(block)]] if lists else None
        part = d
        if lists and len(probed := sorted(set(np.concatenate(probes).tolist()))) <= 10_000:
            part = d.where(F.col(lists[0]).isin(probed))  # prunes lists that no query probes

        def run(batches: Iterator[pa.RecordBatch], first: int = first, block: np.ndarray = block, probes: list | None = probes) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, pa.Array]] = []
            sign = -1.0 if up else 1.0  # sign * score: less is better
            worst = np.full(len(block), np.inf)
            for b in batches:
                names = b.schema.names
                ids = b.column(names.index(id_col))
                if not best:
                    best = [(np.zeros(0), ids.slice(0, 0)) for _ in block]
                rows, x = matrix(b.column(names.index(vector)), block.shape[1], metric)
                own = b.column(names.index(lists[0])).take(pa.array(rows)).to_numpy(zero_copy_only=False) if lists else None
                near = codes[1](np.frombuffer(b"".join(b.column(names.index(codes[0])).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1), own) if codes and len(rows) else None
                step = max(1, CELLS // len(block))
                for r in range(0, len(rows), step):
                    part = x[r : r + step]
                    s, error = rough(metric, part if near is None else near[r : r + step], block)
                    if near is not None:
                        error = error + moved(metric, part, near[r : r + step], block, s)
                    may = (s + error >= low) & (s - error <= high) & (sign * s - error <= worst)
                    for i in np.flatnonzero(may.any(0)):
                        at = np.flatnonzero(may[:, i])
                        if own is not None:
                            at = at[np.isin(own[r + at], probes[i])]
                        e = error[at, i] if isinstance(error, np.ndarray) else np.full(len(at), error)
                        inside = (s[at, i] - e >= low) & (s[at, i] + e <= high)
                        if inside.sum() > k:  # the k best are among these, whatever the errors
                            at = at[sign * s[at, i] - e <= np.partition((sign * s[at, i] + e)[inside], k - 1)[k - 1]]
                        v = exact(metric, part[at], block[i])
                        ok = (v >= low) & (v <= high)
                        if not ok.any():
                            continue
                        val = np.r_[best[i][0], v[ok]]
                        who = pa.concat_arrays([best[i][1], ids.take(pa.array(rows[r + at[ok]]))])
                        if len(val) > k:  # all rows that tie with the k-th stay until ids decide
                            keep = np.flatnonzero(sign * val <= np.partition(sign * val, k - 1)[k - 1])
                            if len(keep) > k:
                                order = pc.sort_indices(pa.table({"s": sign * val[keep], "i": who.take(pa.array(keep))}), sort_keys=[("s", "ascending"), ("i", "ascending")])
                                keep = keep[order.to_numpy()[:k]]
                            val, who = val[keep], who.take(pa.array(keep))
                        best[i] = (val, who)
                        if len(val) >= k:
                            worst[i] = (sign * val).max()
            for i in range(0, len(best), step := max(1, ROWS // k)):
                vals, who = zip(*best[i : i + step], strict=True)
                qid = np.repeat(np.arange(first + i, first + i + len(vals)), [len(v) for v in vals])
                yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.concat_arrays(who), pa.array(np.concatenate(vals))], ["qid", id_col, "_score"])

        one = part.select(*cols).mapInArrow(run, f"qid long, `{id_col}` {kind}, _score double")
        out = one if out is None else out.unionAll(one)
    return ranked(out, k, up, id_col)


def ranked(found: DataFrame, k: int, higher: bool, id_col: str = "_id") -> DataFrame:
    """The k best of each qid with their _rank; ties by id."""
    w = Window.partitionBy("qid").orderBy(F.desc("_score") if higher else F.asc("_score"), id_col)
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def _query_blocks(queries: DataFrame, vector: str) -> list[DataFrame]:
    """A table of queries in parts of about QUERY_BYTES."""
    size = queries.agg(F.sum(F.size(vector).cast("long") * 8 + 32)).first()[0] or 0
    n = max(1, -(-size // QUERY_BYTES))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def top_k_columns(data: DataFrame, vector: str, queries: DataFrame, k: int, metric: str = "InnerProduct", id_col: str = "_id") -> DataFrame:
    """top_k_rows over queries (qid, q) of any lengths: each meets the rows of its length. One that is null or holds a null, NaN or infinity finds none."""
    bad = F.exists("q", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    asked = queries.where((F.size("q") > 0) & ~bad)
    out = None
    for (n,) in sorted(asked.select(F.size("q")).distinct().collect()):
        one = top_k_rows(data, vector, asked.where(F.size("q") == n), k, metric, id_col)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else top_k_rows(data, vector, asked, k, metric, id_col)


def top_k_rows(data: DataFrame, vector: str, queries: DataFrame, k: int, metric: str = "InnerProduct", id_col: str = "_id", **more) -> DataFrame:
    """top_k over a table of queries (qid, q) of any size: parts of about QUERY_BYTES come to the driver one at a time, and where there are several each one's result is written."""
    parts = _query_blocks(queries, "q")
    out = None
    for part in parts:
        rows = part.select("qid", "q").orderBy("qid").collect()
        if rows:
            names = data.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"qid long, _own {dict(queries.dtypes)['qid']}")
            one = top_k(data, vector, np.array([r[1] for r in rows]), k, metric, id_col, **more).join(F.broadcast(names), "qid")  # a row for each query of the part
            one = one.select(F.col("_own").alias("qid"), id_col, "_score", "_rank")
            one = written(one, "top-k") if len(parts) > 1 else one
            out = one if out is None else out.unionByName(one)
    return out if out is not None else data.sparkSession.createDataFrame([], f"qid long, `{id_col}` {dict(data.dtypes)[id_col]}, _score double, _rank int")


def paged(found: DataFrame, page_size: int, page_num: int) -> DataFrame:
    """A page (from 1) of each query's ranked rows; past the end is empty."""
    if page_size <= 0 or page_num <= 0:
        raise param("page_size and page_num must be above 0")
    return found.where(F.col("_rank").between((page_num - 1) * page_size + 1, page_num * page_size))


def weighted_ranker(fields: Sequence[str], ranker: dict | None) -> list[float]:
    """The weights of a WeightedRanker, 1 / n each by default."""
    if not ranker:
        return [1.0 / len(fields)] * len(fields)
    if ranker.get("type") != "WeightedRanker":
        raise param(f"ranker {ranker.get('type')!r}")
    weights = [float(w) for w in ranker.get("params") or []] or [1.0 / len(fields)] * len(fields)
    if len(weights) != len(fields):
        raise param("a weight is needed for each vector field")
    return weights


def fused(parts: Sequence[DataFrame], weights: Sequence[float], k: int, higher: bool, id_col: str = "_id") -> DataFrame:
    """Rows that every field's own list holds, by the weighted sum of their scores."""
    out = parts[0].select("qid", id_col, F.col("_score").alias("s0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select("qid", id_col, F.col("_score").alias(f"s{i}")), ["qid", id_col])
    total = sum((F.col(f"s{i}") * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    return ranked(out.select("qid", id_col, total.alias("_score")), k, higher, id_col)


def recall(found: DataFrame, truth: DataFrame, at: Sequence[int] = (1, 10, 100), id_col: str = "_id") -> DataFrame:
    """k, recall: the share of queries whose true nearest row is among the first k found."""
    nearest = truth.where("_rank = 1").select("qid", F.col(id_col).alias("_best"))
    j = nearest.join(found.select("qid", F.col(id_col).alias("_best"), "_rank"), ["qid", "_best"], "left")
    n = j.agg(*(F.avg(F.coalesce((F.col("_rank") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in at))
    return n.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in at))).alias("x")).select("x.*")
