"""The engine: requests in, DataFrames out.

Documents come as lists of dicts or as DataFrames; requests are dicts with the keys of the document API (filters,
vectors, fields, limit, offset, page_size, page_num, ranker, index_params, is_brute_search, sort, partition_names).
Nothing is collected: results are lazy DataFrames.

Where this differs on purpose from a per-shard server: offset counts over the whole result, filters are SQL's, sort may
name fields (`_score` is the default), ties go by _id, and a delete by filter without a limit takes 50 rows like query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import wraps
from time import perf_counter
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vekspar.errors import Code, EngineError, param
from vekspar.functions.distance import HIGHER, normalized
from vekspar.operators import ann
from vekspar.operators.documents import by_ids, check_ids, scroll
from vekspar.operators.filters import to_column
from vekspar.operators.partition import add_ranges, counts, drop_ranges
from vekspar.operators.search import fused, paged, recall, top_k, weighted_ranker
from vekspar.plans.catalog import Catalog
from vekspar.plans.indexes import Indexing, StoredIndex, enough_rows
from vekspar.schema import MAX_INDEXED_STRING, MAX_STRING, Index, Space, timestamp
from vekspar.sources.scratch import written
from vekspar.sources.store import Store
from vekspar.streaming.realtime import merged, stream_upserts

LIMIT = 50
UNTRAINED = 100
TOP_ROWS = 100_000


class Engine:
    """All spaces under a root folder, with their indexes, which are there again after a restart."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), Catalog(spark, root)
        spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", TOP_ROWS)  # a larger limit sorts instead of holding a heap of that size in each task
        self._calls: dict[str, list[float]] = {}
        self._models: dict[tuple[str, str], ann.VectorIndex] = {}

    def _stored(self, s: Store, index: Index) -> StoredIndex:
        out = StoredIndex(s, index)
        if out.trained:
            key = (out.root, out.state["model"])
            self._models = {k: v for k, v in self._models.items() if k[0] != out.root or k == key}
            out._model = self._models.setdefault(key, out.model) if key not in self._models else self._models[key]
        return out

    # spaces

    def create_space(self, db: str, request: Mapping[str, Any]) -> Space:
        space = Space.parse(dict(request))
        self.catalog.put_space(db, space, new=True)
        return space

    def drop_space(self, db: str, name: str) -> None:
        self.catalog.drop_space(db, name)
        self.store_files.delete(f"{self.root}/{db}/{name}")

    @property
    def store_files(self):
        return self.catalog.files

    def store(self, db: str, name: str) -> Store:
        space = self.catalog.space(db, name)
        return Store(self.spark, f"{self.root}/{db}/{space.name}", space)

    def add_fields(self, db: str, name: str, fields: list[dict[str, Any]]) -> Space:
        space = self.catalog.space(db, name).evolve(fields)
        self.catalog.put_space(db, space)
        return space

    def add_index(self, db: str, name: str, kind: str, fields: Sequence[str], index_name: str = "", **params) -> None:
        space = self.catalog.space(db, name)
        space.add_index(Index(kind, index_name or f"__idx__{'_'.join(fields)}_{kind}", list(fields), params))
        self.catalog.put_space(db, space)

    def remove_index(self, db: str, name: str, index_name: str) -> None:
        space = self.catalog.space(db, name)
        if not any(i.name == index_name for i in space.indexes):
            raise param(f"no index {index_name!r}")
        space.indexes = [i for i in space.indexes if i.name != index_name]
        self.catalog.put_space(db, space)
        self.store_files.delete(f"{self.root}/{db}/{space.name}/index/{index_name}")

    def indexes(self, db: str, name: str) -> DataFrame:
        """name, type, fields, status of each index: READY, BUILDING, FAILED, or UNTRAINED for a vector index that no build has fitted."""
        s = self.store(db, name)
        rows = [(i.name, i.type, i.fields, "UNTRAINED" if i.status == "READY" and i.type in ann.KINDS and i.type != "FLAT" and not StoredIndex(s, i).trained else i.status) for i in s.space.indexes]
        return self.spark.createDataFrame(rows, "name string, type string, fields array<string>, status string")

    def describe(self, db: str, name: str) -> DataFrame:
        rows = [(f.name, f.type, f.dimension, f.format) for f in self.catalog.space(db, name).fields.values()]
        return self.spark.createDataFrame(rows, "name string, type string, dimension int, format string")

    def status(self, db: str, name: str) -> DataFrame:
        """A row: space, version, buckets, doc_num, size (bytes), status (green, or yellow while an index has buckets to take, or red if one failed)."""
        s = self.store(db, name)
        kinds = [i for i in s.space.indexes if i.type in ann.KINDS and i.type != "FLAT"]
        late = any(StoredIndex(s, i).describe()["changed"] for i in kinds)
        color = "red" if any(i.status == "FAILED" for i in s.space.indexes) else "yellow" if late else "green"
        return self.spark.createDataFrame([(s.space.name, s.manifest["version"], s.manifest["n"], s.manifest["rows"], s.size(), color)], "space string, version long, buckets int, doc_num long, size long, status string")

    def stats(self, db: str, name: str) -> DataFrame:
        """doc_num for each range, or for the whole space."""
        s = self.store(db, name)
        if s.space.partition_rule:
            return counts(s.read())
        return s.read().agg(F.count("*").alias("doc_num"))

    def expand(self, db: str, name: str, partition_num: int) -> None:
        space = self.catalog.space(db, name)
        if partition_num <= space.partition_num:
            raise param("partition_num can only grow")
        self.store(db, name).repartition(partition_num)
        space.partition_num = partition_num
        self.catalog.put_space(db, space)

    def change_partitions(self, db: str, name: str, operator: str, ranges: Sequence[Any]) -> None:
        """ADD ranges (dicts of name and value), or DROP ranges by name with their rows."""
        s = self.store(db, name)
        if operator == "ADD":
            add_ranges(s.space, list(ranges))
        elif operator == "DROP":
            drop_ranges(s.space, list(ranges))
            s.delete_where(F.col("partition_name").isin(list(ranges)))
        else:
            raise param(f"operator_type {operator!r}")
        self.catalog.put_space(db, s.space)

    # documents

    def frame(self, space: Space, docs: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Documents, checked and typed: _id, fields (null where not supplied), _pos."""
        rows = []
        for pos, d in enumerate(docs):
            if unknown := [k for k in d if k not in space.fields and k != "_id"]:
                raise param(f"no fields {unknown}")
            rows.append((None if d.get("_id") in (None, "") else str(d["_id"]), *(self._value(space, n, d) for n in space.fields), pos))
        own = [T.StructField(f.name, f.dataType) for f in space.spark_schema().fields if f.name != "_docid"]
        df = self.spark.createDataFrame(rows, T.StructType([*own, T.StructField("_pos", T.LongType())]))
        return df.withColumn("_id", F.coalesce("_id", F.xxhash64(F.expr("uuid()")).cast("string")))  # a new key: 64 bits as text

    @staticmethod
    def _value(space: Space, name: str, doc: Mapping[str, Any]) -> Any:
        f = space.fields[name]
        if name not in doc:
            return None
        v = doc[name]
        try:
            if v is None:
                raise ValueError("null")
            if f.is_vector:
                x = np.asarray(v, np.float64)
                if space.is_binary(name):
                    if x.shape != (f.dimension // 8,) or ((x < 0) | (x > 255)).any():
                        raise ValueError("bytes")
                    return bytearray(x.astype(np.uint8).tobytes())
                if x.shape != (f.dimension,) or not np.isfinite(x).all():
                    raise ValueError("vector")
                if f.format == "normalization":
                    n = np.linalg.norm(x.astype(np.float32))
                    if not n > 0:
                        raise ValueError("zero vector")
                    x = x / n
                return [float(y) for y in x]
            if f.type in ("integer", "long"):
                if isinstance(v, bool):
                    raise ValueError("boolean")
                return int(v)
            if f.type in ("float", "double"):
                return float(v)
            if f.type == "date":
                return timestamp(v)
            if f.type == "boolean":
                return v if isinstance(v, bool) else {"true": True, "false": False}[str(v).lower()]
            if f.type == "string_array":
                if isinstance(v, str) or not all(isinstance(s, str) for s in v):
                    raise ValueError("strings")
                return list(v)
            if not isinstance(v, str):
                raise ValueError("string")
            if len(v.encode()) > (MAX_INDEXED_STRING if space.indexed(name) else MAX_STRING):
                raise ValueError("too long")
            return v
        except (ValueError, KeyError, TypeError) as e:
            raise param(f"field {name}: {str(v)[:60]!r} ({e})") from None

    def upsert(self, db: str, name: str, docs: Sequence[Mapping[str, Any]] | DataFrame, position: str | None = None) -> DataFrame:
        """Inserts or partly updates; returns _id, code, msg of each document. A new one must have all vectors; else it fails alone."""
        s = self.store(db, name)
        if isinstance(docs, DataFrame):
            unit = {f.name: normalized(F.col(f.name)).cast(s.schema[f.name].dataType) for f in s.space.fields.values() if f.format == "normalization" and f.name in docs.columns and not s.space.is_binary(f.name)}
            batch, pos = docs.withColumns(unit) if unit else docs, position
        elif not docs:
            raise EngineError(Code.UPSERT_INVALID_PARAMS, "no documents")
        else:
            batch, pos = self.frame(s.space, docs), "_pos"
        have = [v for v in s.space.vectors() if v in batch.columns]
        missing = F.lit(len(have) < len(s.space.vectors()))
        for v in have:
            missing = missing | F.col(v).isNull()
        known = s.read(s._touched(batch)).select("_id").withColumn("_known", F.lit(True))
        marked = batch.join(known, "_id", "left").withColumn("_bad", F.col("_known").isNull() & missing)
        result = marked.select("_id", F.when(F.col("_bad"), int(Code.UPSERT_INVALID_PARAMS)).otherwise(0).alias("code"), F.when(F.col("_bad"), "a new document needs all vector fields").otherwise("").alias("msg"))
        rows = result.collect() if not isinstance(docs, DataFrame) else None
        s.upsert(marked.where(~F.col("_bad")).drop("_known", "_bad"), pos)
        return self.spark.createDataFrame(rows, "_id string, code int, msg string") if rows is not None else result

    def _fields(self, space: Space, request: Mapping[str, Any]) -> list[str]:
        asked = request.get("fields")
        if asked:
            if bad := [f for f in asked if f not in space.fields and f != "_id"]:
                raise param(f"no fields {bad}")
            return [f for f in dict.fromkeys(asked) if f != "_id"]
        return [*space.scalars(), *(space.vectors() if request.get("vector_value") else [])]

    @staticmethod
    def _limit(request: Mapping[str, Any]) -> int:
        n = request.get("limit") or LIMIT
        if n <= 0:
            raise param(f"limit {n}")
        return int(n)

    @staticmethod
    def _in_partitions(df: DataFrame, request: Mapping[str, Any]) -> DataFrame:
        names = request.get("partition_names")
        return df.where(F.col("partition_name").isin(list(names))) if names else df

    def query(self, db: str, name: str, request: Mapping[str, Any]) -> DataFrame:
        """By document_ids (in their order) or by filters (in docid order), with fields, limit, offset or page."""
        s = self.store(db, name)
        ids, filters = request.get("document_ids"), request.get("filters")
        if request.get("vectors"):
            raise EngineError(Code.QUERY_INVALID_PARAMS_SHOULD_NOT_HAVE_VECTOR_FIELD, "vectors")
        if ids and filters:
            raise EngineError(Code.QUERY_INVALID_PARAMS_BOTH_DOCUMENT_IDS_AND_FILTER, "both")
        if not ids and not filters:
            raise EngineError(Code.QUERY_INVALID_PARAMS_SHOULD_HAVE_ONE_OF_DOCUMENT_IDS_OR_FILTER, "neither")
        fields = self._fields(s.space, request)
        if ids:
            check_ids(ids, Code.QUERY_INVALID_PARAMS_LENGTH_OF_DOCUMENT_IDS_BEYOND_500)
            if request.get("next"):
                own = s.get(ids[:1]).agg(F.max("_docid")).first()[0]
                return scroll(s.read(), -1 if own is None else own).select("_id", *fields, "_docid")
            return by_ids(s.get(ids), list(ids)).select("_id", *fields)
        d = self._in_partitions(s.read(), request).where(to_column(filters, s.space))
        order = self._sort(s.space, request.get("sort")) or ["_docid"]
        size, page = request.get("page_size"), request.get("page_num")
        if size and page:
            return d.orderBy(*order, "_docid").offset((page - 1) * size).limit(size).select("_id", *fields)
        offset, limit = int(request.get("offset") or 0), self._limit(request)
        if not offset and limit >= s.manifest["rows"]:  # all that match
            return (d.orderBy(*order, "_docid") if request.get("sort") else d).select("_id", *fields)
        return d.orderBy(*order, "_docid").offset(offset).limit(limit).select("_id", *fields)

    @staticmethod
    def _sort(space: Space, sort: Any) -> list:
        """A sort: a field, {field: asc | desc}, {field: {order, mode: min | max for arrays, missing: _first | _last}} or a list of them."""
        out = []
        for x in [] if not sort else sort if isinstance(sort, list) else [sort]:
            name, how = (x, "desc" if x == "_score" else "asc") if isinstance(x, str) else next(iter(x.items()))
            more = how if isinstance(how, dict) else {"order": how}
            how, mode, missing = more.get("order", "asc"), more.get("mode"), more.get("missing", "_last")
            if name not in space.fields and name not in ("_id", "_score"):
                raise param(f"cannot sort by {name!r}")
            if how not in ("asc", "desc") or mode not in (None, "min", "max") or missing not in ("_first", "_last"):
                raise param(f"sort {x!r}")
            c = F.col(name)
            if name in space.fields and space.fields[name].type == "string_array":  # by its least or greatest string
                c = F.array_max(c) if mode == "max" or mode is None and how == "desc" else F.array_min(c)
            out.append((c.desc_nulls_first() if missing == "_first" else c.desc_nulls_last()) if how == "desc" else c.asc_nulls_first() if missing == "_first" else c.asc_nulls_last())
        return out

    def search(self, db: str, name: str, request: Mapping[str, Any]) -> DataFrame:
        """qid, _id, _score, _rank and fields of the nearest documents of each query vector.

        vectors: [{field, feature (one or more vectors, flat), min_score, max_score, index_type}]; several fields are
        searched each and intersected under the ranker.
        """
        s = self.store(db, name)
        if not request.get("vectors"):
            raise EngineError(Code.SEARCH_INVALID_PARAMS_SHOULD_HAVE_VECTOR_FIELD, "vectors")
        fields, k = self._fields(s.space, request), self._limit(request)
        offset = int(request.get("offset") or 0)
        data = self._in_partitions(s.read(), request)
        where = to_column(request.get("filters"), s.space)
        parts, metrics, sizes = [], [], set()
        for v in request["vectors"]:
            f = s.space.fields.get(v.get("field", ""))
            if f is None or not f.is_vector:
                raise param(f"no vector field {v.get('field')!r}")
            q = self._queries(s.space, f.name, v.get("feature") or [])
            index = s.space.vector_index(f.name, v.get("index_type"))
            metric = (request.get("index_params") or {}).get("metric_type") or (index.params.get("metric_type") if index else None) or "InnerProduct"
            metric = "Hamming" if s.space.is_binary(f.name) else metric
            sizes.add(len(q))
            metrics.append(metric)
            low, high = self._bounds(v)
            parts.append(self._one(db, s, index, f.name, q, k + offset, metric, low, high, data, where, request))
        if len(sizes) > 1:
            raise param("vector fields need equally many query vectors")
        weights = weighted_ranker([v["field"] for v in request["vectors"]], request.get("ranker"))
        found = fused(parts, weights, k + offset, HIGHER[metrics[0]]) if len(parts) > 1 else parts[0]
        if offset:
            found = found.where(F.col("_rank") > offset).withColumn("_rank", F.col("_rank") - offset)
        if request.get("page_size") and request.get("page_num"):
            found = paged(found, request["page_size"], request["page_num"])
        out = found.join(data.select("_id", *fields), "_id") if fields else found
        if order := self._sort(s.space, request.get("sort")):
            out = out.drop("_rank").withColumn("_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order, "_id")))
        return out.select("qid", "_id", "_score", "_rank", *fields)

    def _queries(self, space: Space, name: str, feature: Sequence) -> np.ndarray:
        f, binary = space.fields[name], space.is_binary(name)
        dim = f.dimension // 8 if binary else f.dimension
        x = np.asarray(feature, np.float64).ravel()
        if not len(x) or len(x) % dim:
            raise param(f"{len(x)} numbers are not vectors of {dim}")
        x = x.reshape(-1, dim)
        if binary:
            return x.astype(np.uint8)
        if f.format == "normalization":
            n = np.linalg.norm(x, axis=1, keepdims=True)
            if not (np.isfinite(n) & (n > 0)).all():
                raise param("a zero or non-finite vector cannot be normalized")
            x = x / n
        return x

    @staticmethod
    def _bounds(v: Mapping[str, Any]) -> tuple[float | None, float | None]:
        """min_score and max_score, or symbol and value; both ends are inclusive whatever the symbol."""
        low, high = v.get("min_score"), v.get("max_score")
        if v.get("symbol"):
            if v["symbol"] not in ("<", "<=", ">", ">=", "="):
                raise param(f"symbol {v['symbol']!r}")
            if v["symbol"][0] in ">=":
                low = v.get("value")
            if v["symbol"][0] in "<=":
                high = v.get("value")
        return low, high

    def _one(self, db, s: Store, index: Index | None, field: str, q: np.ndarray, k: int, metric: str, low, high, data: DataFrame, where, request) -> DataFrame:
        brute = int(request.get("is_brute_search") or 0)
        bounds = {"min_score": low, "max_score": high}
        stored = self._stored(s, index) if index is not None and index.type != "FLAT" and not brute else None
        if stored is None or not stored.trained:
            if stored is not None and not s.space.realtime and s.manifest["rows"] > UNTRAINED:
                raise EngineError(Code.SEARCH_ENGINE_ERR, f"index {index.name} is not trained")
            return top_k(data, field, q, k, metric, where=where, **bounds)
        model, more = stored.model, request.get("index_params") or {}
        extra = {"recall_num": more.get("recall_num")} if isinstance(model, ann._Coded) else {"ef": more.get("efSearch") or more.get("l_search")} if isinstance(model, ann.GraphIndex) else {}
        rows, late = stored.rows(), stored.changed()
        found = None if rows is None else model.search(self._in_partitions(rows, request), q.tolist(), k, more.get("nprobe"), where=where, **bounds, **extra)
        if not late:
            return found if found is not None else top_k(data, field, q, k, metric, where=where, **bounds)
        fresh = top_k(self._in_partitions(s.read(late), request), field, q, k, metric, where=where, **bounds)  # what the index has not taken
        return fresh if found is None else merged(found, fresh, k, HIGHER[metric])

    def _vector_indexes(self, s: Store, index_name: str | None) -> list[Index]:
        return [i for i in s.space.indexes if i.type in ann.KINDS and i.type != "FLAT" and index_name in (None, i.name)]

    def _mark(self, db: str, name: str, index_name: str, status: str) -> None:
        space = self.catalog.space(db, name)
        for i in space.indexes:
            if i.name == index_name and i.status != status:
                i.status = status
                self.catalog.put_space(db, space)

    def rebuild_index(self, db: str, name: str, index_name: str | None = None, drop_before_rebuild: bool = False, describe: bool = False) -> DataFrame | None:
        """Fits and assigns the vector indexes of a space (or one); describe: only tells their state."""
        s = self.store(db, name)
        todo = self._vector_indexes(s, index_name)
        if describe:
            rows = [tuple(StoredIndex(s, i).describe().values()) for i in todo]
            return self.spark.createDataFrame(rows, "name string, trained boolean, buckets int, changed int")
        for i in todo:
            self._mark(db, name, i.name, "BUILDING")
            try:
                StoredIndex(s, i).build(drop_before_rebuild)
            except Exception:
                self._mark(db, name, i.name, "FAILED")
                raise
            self._mark(db, name, i.name, "READY")
        return None

    force_merge = rebuild_index

    def refresh_index(self, db: str, name: str, index_name: str | None = None) -> int:
        """Takes the rows of buckets that changed since into the fitted indexes, without fitting anew; how many buckets there were."""
        s = self.store(db, name)
        return sum(x.refresh() for i in self._vector_indexes(s, index_name) if (x := self._stored(s, i)).trained)

    def start_indexing(self, db: str, name: str) -> Indexing | None:
        """Builds and refreshes a space's indexes in the background each refresh_interval; below 0 it is off."""
        interval = self.catalog.space(db, name).refresh_interval

        def step() -> None:
            s = self.store(db, name)
            for i in self._vector_indexes(s, None):
                if not StoredIndex(s, i).trained and enough_rows(self.spark, s, i):
                    self.rebuild_index(db, name, i.name)
            self.refresh_index(db, name)

        return None if interval < 0 else Indexing(step, interval)

    def delete(self, db: str, name: str, request: Mapping[str, Any]) -> DataFrame:
        """By document_ids or filters (with limit); returns the ids that went."""
        s = self.store(db, name)
        if request.get("vectors"):
            raise EngineError(Code.DELETE_INVALID_PARAMS_SHOULD_NOT_HAVE_VECTOR_FIELD, "vectors")
        ids, filters = request.get("document_ids"), request.get("filters")
        if bool(ids) == bool(filters):
            raise EngineError(Code.DELETE_INVALID_PARAMS_SHOULD_HAVE_ONE_OF_DOCUMENT_IDS_OR_FILTER, "ids or filters")
        if ids:
            check_ids(ids, Code.DELETE_INVALID_PARAMS_LENGTH_OF_DOCUMENT_IDS_BEYOND_500)
            gone = self.spark.createDataFrame(s.get(ids).select("_id").collect(), "_id string")  # 499 at most
        else:
            found, limit = s.read().where(to_column(filters, s.space)), self._limit(request)
            gone = written((found if limit >= s.manifest["rows"] else found.orderBy("_docid").limit(limit)).select("_id"), "deleted")
        s.delete(gone)
        return gone

    def get(self, db: str, name: str, ids: Sequence[str], partition: int | None = None) -> DataFrame:
        s = self.store(db, name)
        if partition is not None:
            return by_ids(s.read([partition]), [int(i) for i in ids], "_docid")
        return by_ids(s.get(ids), list(ids))

    def stream(self, db: str, name: str, stream: DataFrame, checkpoint: str, position: str = "_pos"):
        """Upserts a stream; see vekspar.streaming.realtime."""
        return stream_upserts(stream, lambda b: self.store(db, name).upsert(b, position), checkpoint, self.catalog.space(db, name).refresh_interval, position)

    # versions

    def flush(self, db: str, name: str) -> int:
        """The version that readers see; writes are committed as they return."""
        return self.store(db, name).manifest["version"]

    def backup(self, db: str, name: str, target: str) -> int:
        """A new version of a backup of the space; its number."""
        return self.store(db, name).backup(target)

    def backups(self, target: str) -> DataFrame:
        """version, status, rows of each backup under a folder."""
        return self.spark.createDataFrame(Store.backups(self.spark, target), "version long, status string, rows long")

    def delete_backup(self, target: str, version: int) -> None:
        self.store_files.delete(f"{target}/{int(version)}")

    def restore(self, db: str, name: str, source: str, version: int | None = None) -> None:
        s = Store.restore(self.spark, source, f"{self.root}/{db}/{name}", version)
        s.space.name = name
        self.catalog.put_space(db, s.space, new=True)

    def metrics(self) -> DataFrame:
        """request, calls, failed, seconds: what this Engine was asked, and the time to plan it (results are lazy)."""
        return self.spark.createDataFrame([(k, int(v[0]), int(v[1]), v[2]) for k, v in sorted(self._calls.items())], "request string, calls long, failed long, seconds double")

    # adapters

    def similarity_search(self, db: str, name: str, field: str, vector: Sequence[float], k: int = 4, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self.search(db, name, {"vectors": [{"field": field, "feature": list(vector)}], "limit": k, "filters": filters, "is_brute_search": 2})

    def recall(self, found: DataFrame, truth: DataFrame, at: Sequence[int] = (1, 10, 100)) -> DataFrame:
        return recall(found, truth, at)


def _counted(name: str, f):
    @wraps(f)
    def call(self, *args, **kwargs):
        own, start = self._calls.setdefault(name, [0, 0, 0.0]), perf_counter()
        own[0] += 1
        try:
            return f(self, *args, **kwargs)
        except Exception:
            own[1] += 1
            raise
        finally:
            own[2] += perf_counter() - start

    return call


for _name in ("query", "search", "upsert", "delete", "get", "rebuild_index", "refresh_index"):
    setattr(Engine, _name, _counted(_name, getattr(Engine, _name)))
