"""A space's documents: versioned Parquet in hash buckets behind versioned manifests.

A write touches only the buckets of its ids: it joins and rewrites those, and the next manifest keeps the others' old
folders. So a small upsert reads and writes a few buckets, a get by ids opens only its buckets, and readers of an older
manifest see an unchanged snapshot. Within a bucket, rows are laid out by partition_name where the space has a rule.

A commit creates the next manifest file and never replaces or deletes one: a crash leaves the version before it, and of
two writers that began from one version the second gets an error and writes nothing that is read. The number of buckets
follows the rows (BUCKET_ROWS each), and a bucket is written by several tasks where it is large.

Rows are sorted within a file by the fields of the space's scalar indexes, the COMPOSITE ones first, so that row groups'
least and greatest values prune ranges; BITMAP and INVERTED fields get Bloom filters, which prune equality.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vekspar.errors import Code, EngineError
from vekspar.operators.documents import deleted, last_wins, upserted, with_docid
from vekspar.operators.partition import bucket, partition_name
from vekspar.schema import SCALAR_INDEXES, Space
from vekspar.sources.files import Files


#: Rows of a bucket above which the number of buckets doubles, and rows that a task writes.
BUCKET_ROWS, TASK_ROWS = 4_000_000, 500_000


class Store:
    def __init__(self, spark: SparkSession, root: str, space: Space, buckets: int | None = None):
        self.spark, self.root, self.space, self.files = spark, root.rstrip("/"), space, Files(spark)
        _, self.begun, found = self.files.newest(f"{self.root}/manifest")
        self.manifest = found or {"version": 0, "buckets": {}, "n": buckets or max(1, space.partition_num), "max_docid": -1, "rows": 0}

    @property
    def schema(self) -> T.StructType:
        own = self.space.spark_schema()
        return own.add("partition_name", T.StringType()) if self.space.partition_rule else own

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current snapshot, of some buckets only if asked."""
        by_folder: dict[str, list[str]] = {}
        for b, v in self.manifest["buckets"].items():
            if buckets is None or int(b) in buckets:
                by_folder.setdefault(v, []).append(b)
        out = None
        for v, own in sorted(by_folder.items()):
            base = f"{self.root}/{v}"
            one = self.spark.read.schema(self.schema.add("_bucket", T.IntegerType())).option("basePath", base).parquet(*(f"{base}/_bucket={b}" for b in own)).drop("_bucket")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def _slots(self, ids: Sequence[str]) -> list[int]:
        one = self.spark.createDataFrame([(i,) for i in ids], "_id string").select(bucket(self.manifest["n"]).alias("b")).distinct()
        return [r[0] for r in one.collect()]

    def get(self, ids: Sequence[str]) -> DataFrame:
        return self.read(self._slots(ids)).where(F.col("_id").isin(list(ids)))

    def _layout(self) -> list[str]:
        """The fields of scalar indexes, COMPOSITE ones first."""
        found = [f for i in sorted(self.space.indexes, key=lambda i: i.type != "COMPOSITE") if i.type in SCALAR_INDEXES for f in i.fields if self.space.fields[f].type != "string_array"]
        return list(dict.fromkeys(found))

    def _commit(self, rows: DataFrame, touched: Sequence[int], n: int | None = None) -> None:
        """rows are all that the touched buckets hold from now on."""
        v, n = self.begun + 1, n or self.manifest["n"]
        name = f"v{v}-{uuid.uuid4().hex[:8]}"  # a writer's own, whoever wins
        at = f"{self.root}/{name}"
        cols = ["_bucket", *(["partition_name"] if self.space.partition_rule else [])]
        tasks = max(1, -(-self.manifest["rows"] // (n * TASK_ROWS)))
        rows = rows.withColumn("_bucket", bucket(n)).repartition(*(F.col(c) for c in cols), *([F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(tasks))] if tasks > 1 else []))
        writer = rows.sortWithinPartitions(*cols, *self._layout()).write.partitionBy(*cols)
        for i in self.space.indexes:
            if i.type in ("INVERTED", "SCALAR", "BITMAP"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{i.fields[0]}", "true")
        writer.parquet(at)
        have = {int(x.split("=")[1]) for x in self.files.list(at) if x.startswith("_bucket=")}
        kept = {b: w for b, w in self.manifest["buckets"].items() if int(b) not in touched}
        top = self.spark.read.parquet(at).agg(F.max("_docid")).first()[0] if have else None
        new = {**self.manifest, "version": v, "n": n, "buckets": {**kept, **{str(b): name for b in have}}, "max_docid": max(self.manifest["max_docid"], -1 if top is None else top)}
        old, self.manifest = self.manifest, new
        new["rows"] = self.read().count()  # from the files' footers
        try:
            self.files.commit(f"{self.root}/manifest", v, json.dumps(new))
        except FileExistsError:
            self.manifest = old
            self.files.delete(at)
            raise EngineError(Code.INTERNAL_ERROR, f"version {v} was written by another session") from None
        self.begun = v
        if new["rows"] > n * BUCKET_ROWS and n < 4096:
            self.repartition(2 * n)

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r[0] for r in ids.select(bucket(self.manifest["n"]).alias("b")).distinct().collect()]  # at most the number of buckets

    def upsert(self, batch: DataFrame, position: str | None = None) -> None:
        """batch: _id and any of the fields; null means not supplied. Without position, an id must come once."""
        b = last_wins(batch, position).drop(position) if position else batch
        touched = self._touched(b)
        old = self.read(touched).drop("partition_name")
        known = old.select("_id", "_docid")
        new = with_docid(self.spark, b.join(known, "_id", "left_anti"), self.manifest["max_docid"]).unionByName(b.join(known, "_id"))
        empty = {"string": F.lit(""), "integer": F.lit(0), "long": F.lit(0), "float": F.lit(0.0), "double": F.lit(0.0)}
        rows = upserted(old, new).select("_id", *(F.coalesce(f.name, empty[f.type].cast(old.schema[f.name].dataType)).alias(f.name) if f.type in empty else F.col(f.name) for f in self.space.fields.values()), "_docid")
        if self.space.partition_rule:
            rows = rows.withColumn("partition_name", partition_name(self.space.partition_rule))
            rows = rows.withColumn("partition_name", F.coalesce("partition_name", F.raise_error(F.lit("a date is past the last range"))))
        self._commit(rows, touched)

    def delete(self, ids: DataFrame) -> None:
        touched = self._touched(ids)
        self._commit(deleted(self.read(touched), ids), touched)

    def delete_where(self, pred: Column) -> None:
        """Rewrites without the rows; used when a range is dropped."""
        self._commit(self.read().where(~F.coalesce(pred, F.lit(False))), [int(b) for b in self.manifest["buckets"]])

    def repartition(self, buckets: int) -> None:
        self._commit(self.read(), [int(b) for b in self.manifest["buckets"]], buckets)

    def compact(self, keep: int = 1) -> None:
        """Deletes folders that the last `keep` manifests don't use, and older manifests. No other session may be reading or writing an older version."""
        numbers = sorted((int(m[1]) for f in self.files.list(self.root) if (m := re.fullmatch(r"manifest-(\d+)\.json", f))), reverse=True)
        used = set(self.manifest["buckets"].values())
        for w in numbers[:keep]:
            try:
                used |= set(json.loads(self.files.read(f"{self.root}/manifest-{w}.json"))["buckets"].values())
            except ValueError:  # cut short by a crash
                continue
        for w in numbers[max(1, keep) :]:
            if w != self.manifest["version"]:
                self.files.delete(f"{self.root}/manifest-{w}.json")
        for name in self.files.list(self.root):
            if re.fullmatch(r"v\d+-[0-9a-f]+", name) and name not in used:
                self.files.delete(f"{self.root}/{name}")

    def size(self) -> int:
        """Bytes of the snapshot's files."""
        return sum(self.files.size(f"{self.root}/{v}/_bucket={b}") for b, v in self.manifest["buckets"].items())

    def backup(self, target: str) -> int:
        """A new version of a backup, (target)/<version>: copies by Spark tasks, its manifest last. Returns the version."""
        version = max([int(x) for x in self.files.list(target) if x.isdigit()], default=0) + 1
        at = f"{target}/{version}"
        rows = self.read().withColumn("_bucket", bucket(self.manifest["n"]))
        rows.write.partitionBy("_bucket", *(["partition_name"] if self.space.partition_rule else [])).parquet(f"{at}/v1-backup")
        self.files.write(f"{at}/space.json", json.dumps(self.space.to_json()))
        self.files.create(f"{at}/manifest.json", json.dumps({**self.manifest, "version": 1, "buckets": {x.split("=")[1]: "v1-backup" for x in self.files.list(f"{at}/v1-backup") if x.startswith("_bucket=")}}))
        return version

    @staticmethod
    def backups(spark: SparkSession, target: str) -> list[tuple[int, str, int]]:
        """(version, status, rows) of each backup: COMPLETED, or RUNNING while its manifest is missing (or its writer died)."""
        files, out = Files(spark), []
        for x in sorted(int(x) for x in files.list(target) if x.isdigit()):
            done = files.exists(f"{target}/{x}/manifest.json")
            out.append((x, "COMPLETED" if done else "RUNNING", json.loads(files.read(f"{target}/{x}/manifest.json"))["rows"] if done else 0))
        return out

    @classmethod
    def restore(cls, spark: SparkSession, source: str, root: str, version: int | None = None) -> Store:
        """A backup's version, by default the newest whole one, as a new store."""
        files = Files(spark)
        whole = [v for v, status, _ in cls.backups(spark, source) if status == "COMPLETED" and version in (None, v)]
        if not whole:
            raise EngineError(Code.PARAM_ERROR, f"no whole backup {version or ''} in {source}")
        at = f"{source}/{whole[-1]}"
        space, manifest = (json.loads(files.read(f"{at}/{x}.json")) for x in ("space", "manifest"))
        spark.read.parquet(f"{at}/v1-backup").write.partitionBy("_bucket", *(["partition_name"] if space["partition_rule"] else [])).parquet(f"{root}/v1-backup")
        files.commit(f"{root}/manifest", 1, json.dumps(manifest))
        return cls(spark, root, Space.from_json(space))

    def export_json(self, path: str) -> None:
        self.read().drop("_docid").write.json(path)

    def import_json(self, path: str) -> None:
        own = T.StructType([f for f in self.space.spark_schema().fields if f.name != "_docid"])
        self.upsert(self.spark.read.schema(own).json(path))
