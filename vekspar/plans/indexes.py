"""Vector indexes of a space on disk: a fitted model, and its rows in the store's buckets.

An index keeps, for each bucket, which folder of the store it was made from. A bucket whose folder is still the store's
is searched by the index; the others, which later writes replaced, are searched exactly until refresh() assigns their
rows. So a search never joins the index with the table, a refresh touches only changed buckets, and an index is there
again after a restart. States are committed like the store's manifests.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vekspar.errors import Code, EngineError
from vekspar.operators import ann
from vekspar.operators.partition import bucket
from vekspar.schema import Index, Space
from vekspar.sources.store import Store


def model_of(space: Space, index: Index, rows: int) -> ann.VectorIndex:
    """The unfitted model that an index's parameters ask for."""
    f = space.fields[index.fields[0]]
    params = {k: v for k, v in index.params.items() if k != "metric_type"}
    params.setdefault("ncentroids", max(1, rows // ann.SHARD) if index.type in ("HNSW", "DISKANN_STATIC") else ann.default_lists(rows))
    return ann.make(index.type, f.name, f.dimension // 8 if space.is_binary(f.name) else f.dimension, index.params.get("metric_type") or "InnerProduct", **params)


class StoredIndex:
    def __init__(self, store: Store, index: Index):
        self.store, self.index, self.spark, self.files = store, index, store.spark, store.files
        self.root = f"{store.root}/index/{index.name}"
        self.version, self.begun, self.state = self.files.newest(f"{self.root}/state")
        self._model: ann.VectorIndex | None = None

    @property
    def trained(self) -> bool:
        return bool(self.state)

    @property
    def model(self) -> ann.VectorIndex:
        if self._model is None:
            data = self.spark.read.parquet(f"{self.root}/{self.state['model']}").first()[0]  # one row: the fitted arrays
            self._model = ann.VectorIndex.load(bytes(data))
        return self._model

    def _commit(self, state: dict) -> None:
        try:
            self.files.commit(f"{self.root}/state", self.begun + 1, json.dumps(state))
        except FileExistsError:
            raise EngineError(Code.FORCE_MERGE_BUILD_INDEX_ERR, f"index {self.index.name} was changed by another session") from None
        self.begun += 1
        self.version, self.state = self.begun, state

    def _write(self, model: ann.VectorIndex, buckets: Sequence[int]) -> str:
        """The rows of some of the store's buckets, assigned; the folder's name."""
        name = f"rows-{uuid.uuid4().hex[:8]}"
        rows = self.store.read(buckets).withColumn("_bucket", bucket(self.store.manifest["n"]))
        rows = model.assign(rows)
        rows = rows.sortWithinPartitions("_bucket", *(["list_id"] if "list_id" in rows.columns else []))
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        return name

    def build(self, drop_before: bool = False) -> None:
        """Fits on the store's rows and assigns all; drop_before: searches fall back to exact ones until it is done."""
        if drop_before and self.state:
            self._commit({})
        model = model_of(self.store.space, self.index, self.store.manifest["rows"]).fit(self.store.read())
        name = f"model-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(bytearray(model.dump()),)], "model binary").write.parquet(f"{self.root}/{name}")
        buckets = self.store.manifest["buckets"]
        folder = self._write(model, [int(b) for b in buckets])
        self._commit({"model": name, "n": self.store.manifest["n"], "source": dict(buckets), "folders": dict.fromkeys(buckets, folder)})
        self._model = model

    def changed(self) -> list[int]:
        """The store's buckets that the index has not taken yet."""
        same = self.state.get("n") == self.store.manifest["n"]
        return [int(b) for b, f in self.store.manifest["buckets"].items() if not same or self.state["source"].get(b) != f]

    def refresh(self) -> int:
        """Assigns the rows of changed buckets with the fitted model; how many buckets there were."""
        todo = self.changed()
        if todo:
            folder = self._write(self.model, todo)
            kept = {} if self.state["n"] != self.store.manifest["n"] else self.state["folders"]
            folders = {b: folder if int(b) in todo else kept[b] for b in self.store.manifest["buckets"]}
            self._commit({**self.state, "n": self.store.manifest["n"], "source": dict(self.store.manifest["buckets"]), "folders": folders})
        return len(todo)

    def rows(self) -> DataFrame | None:
        """The assigned rows of the buckets that have not changed."""
        late = set(self.changed())
        by: dict[str, list[str]] = {}
        for b in self.store.manifest["buckets"]:
            if int(b) not in late:
                by.setdefault(self.state["folders"][b], []).append(b)
        out = None
        for folder, own in sorted(by.items()):
            base = f"{self.root}/{folder}"
            schema = T.StructType([*self.store.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("_bucket", T.IntegerType())])
            one = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/_bucket={b}" for b in own))
            out = one if out is None else out.unionByName(one)
        return out

    def describe(self) -> dict:
        return {"name": self.index.name, "trained": self.trained, "buckets": len(self.store.manifest["buckets"]), "changed": len(self.changed()) if self.trained else len(self.store.manifest["buckets"])}


class Indexing:
    """Refreshes a space's indexes in the background, each interval, until stop(); the first round builds those that are not trained and have rows enough."""

    def __init__(self, step, interval_ms: int):
        self.failed: Exception | None = None
        self._over, self._step, self._wait = threading.Event(), step, interval_ms / 1000
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._over.is_set():
            try:
                self._step()
            except Exception as e:  # told by status(); the next round tries again
                self.failed = e
            else:
                self.failed = None
            self._over.wait(self._wait)

    def stop(self) -> None:
        self._over.set()
        self._thread.join()


def enough_rows(spark: SparkSession, store: Store, index: Index) -> bool:
    n = store.manifest["rows"]
    return n >= max(1, int(index.params.get("training_threshold") or 0), int(index.params.get("ncentroids") or 0))
