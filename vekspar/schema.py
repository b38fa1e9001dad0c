"""Spaces: declared fields, indexes and partition rules, and the Spark schema that they give."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import types as T

from vekspar.errors import param

# Type names that requests use, parameter limits and defaults.
TYPES = {
    "integer": "integer", "int": "integer", "short": "integer", "byte": "integer", "long": "long", "float": "float", "double": "double",
    "string": "string", "text": "string", "keyword": "string", "stringarray": "string_array", "string_array": "string_array",
    "date": "date", "boolean": "boolean", "bool": "boolean", "vector": "vector",
}
SPARK = {
    "integer": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(),
    "string_array": T.ArrayType(T.StringType()), "date": T.TimestampType(), "boolean": T.BooleanType(), "vector": T.ArrayType(T.FloatType()),
}
SCALAR_INDEXES = ("SCALAR", "INVERTED", "BITMAP", "COMPOSITE")
VECTOR_INDEXES = ("FLAT", "IVFFLAT", "IVFPQ", "IVFPQFastScan", "IVFRABITQ", "BINARYIVF", "HNSW", "DISKANN_STATIC", "GPU_IVFFLAT", "GPU_IVFPQ")
RESERVED = ("_id", "_score", "_docid", "_bucket", "partition_name")
MAX_STRING, MAX_INDEXED_STRING = 65_535, 1024
MAX_PARTITIONS, MAX_TOTAL_PARTITIONS = 1024, 16_384
LIMITS = {"nlinks": (8, 96), "efConstruction": (16, 1024), "ncentroids": (1, 262_144)}
METRICS = ("InnerProduct", "L2")
_IVF = ("IVFFLAT", "IVFPQ", "IVFPQFastScan", "IVFRABITQ", "BINARYIVF", "GPU_IVFFLAT", "GPU_IVFPQ")
_BAD_NAME = re.compile(r"[\t\n\v\f\r \x85\xa0\\+\-!*/():^\[\]\"{}~%&'<>?]")


@dataclass
class Index:
    type: str
    name: str = ""
    fields: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    status: str = "READY"

    def validate(self) -> None:
        p = self.params
        if self.type not in (*SCALAR_INDEXES, *VECTOR_INDEXES):
            raise param(f"index type not supported: {self.type or 'null'}")
        if p.get("metric_type") and p["metric_type"] not in METRICS:
            raise param(f"metric_type {p['metric_type']} should be one of {METRICS}")
        keys = ("nlinks", "efConstruction") if self.type == "HNSW" else ("ncentroids",) if self.type in _IVF else ()
        for k in keys:
            low, high = LIMITS[k]
            if p.get(k) and not low <= p[k] <= high:
                raise param(f"{k} {p[k]} should be in [{low}, {high}]")
        if self.type in _IVF:
            n, t = p.get("ncentroids") or 0, p.get("training_threshold") or 0
            if t and t < max(256, n) or not t and n and 39 * n < 256:
                raise param(f"training_threshold {t} should be at least {max(256, n)}")
            if p.get("nprobe") and n and p["nprobe"] > n:
                raise param(f"nprobe {p['nprobe']} should be at most ncentroids {n}")


@dataclass
class Field:
    name: str
    type: str
    dimension: int = 0
    format: str = ""
    store_type: str = ""

    @property
    def is_vector(self) -> bool:
        return self.type == "vector"


@dataclass
class Space:
    name: str
    fields: dict[str, Field]
    indexes: list[Index] = field(default_factory=list)
    partition_num: int = 1
    replica_num: int = 1
    partition_rule: dict[str, Any] | None = None
    refresh_interval: int = 1000
    realtime: bool = False

    @classmethod
    def parse(cls, request: dict[str, Any]) -> Space:
        """From a create request: name, fields (list of name, type, dimension, format, index), indexes, partition_num, partition_rule."""
        name = request.get("name") or ""
        if not name:
            raise param("a space's name must not be empty")
        if name[0].isnumeric() or name[0] == "_" or _BAD_NAME.search(name):
            raise param(f"bad space name {name!r}")
        fields: dict[str, Field] = {}
        indexes: list[Index] = []
        for f in request.get("fields") or []:
            n, kind = f.get("name") or "", TYPES.get(str(f.get("type", "")).lower())
            if not n or n in fields or n in RESERVED:
                raise param(f"field name {n!r} is empty, reserved or there twice")
            if kind is None:
                raise param(f"field {n}: type {f.get('type')!r} is not supported")
            if kind == "vector" and not int(f.get("dimension") or 0) > 0:
                raise param(f"vector field {n} needs a dimension above 0")
            if f.get("format", "") not in ("", "no", "normal", "normalization"):
                raise param(f"field {n}: format {f['format']!r} is not supported")
            if f.get("store_type", "") not in ("", "MemoryOnly", "MemoryBuffer", "RocksDB"):
                raise param(f"field {n}: store_type {f['store_type']!r} is not supported")
            fields[n] = Field(n, kind, int(f.get("dimension") or 0), f.get("format", ""), f.get("store_type", ""))
            if i := f.get("index"):
                indexes.append(Index(i.get("type", ""), i.get("name") or f"__idx__{n}_{i.get('type', '')}", [n], i.get("params") or {}))
        if not any(f.is_vector for f in fields.values()):
            raise param("a space needs a vector field")
        for i in request.get("indexes") or []:
            if i.get("field_name") and i.get("field_names"):
                raise param("field_name and field_names must not both be set")
            indexes.append(Index(i.get("type", ""), i.get("name", ""), i.get("field_names") or [x for x in [i.get("field_name")] if x], i.get("params") or {}))
        out = cls(name, fields, [], int(request.get("partition_num") or 1), int(request.get("replica_num") or 1), request.get("partition_rule"), int(request.get("refresh_interval", 1000)), bool(request.get("enable_realtime")))
        for i in indexes:
            out.add_index(i)
        if out.partition_rule:
            check_rule(out, out.partition_rule)
        return out

    def add_index(self, i: Index) -> None:
        i.validate()
        if not i.name or any(x.name == i.name for x in self.indexes):
            raise param("an index's name must be set and unique")
        if missing := [f for f in i.fields if f not in self.fields]:
            raise param(f"index {i.name}: no field {missing}")
        if i.type == "COMPOSITE" and (len(i.fields) < 2 or len(set(i.fields)) < len(i.fields)):
            raise param(f"index {i.name}: COMPOSITE needs two different fields at least")
        if i.type != "COMPOSITE" and len(i.fields) != 1:
            raise param(f"index {i.name}: needs one field")
        if any(self.fields[f].is_vector == (i.type in SCALAR_INDEXES) for f in i.fields):
            raise param(f"index {i.name}: {i.type} does not fit {i.fields}")
        self.indexes.append(i)

    def indexed(self, name: str) -> bool:
        return any(name in i.fields for i in self.indexes)

    def vector_index(self, name: str, kind: str | None = None) -> Index | None:
        own = [i for i in self.indexes if i.fields == [name] and (kind is None or i.type == kind)]
        if len(own) > 1:
            raise param(f"field {name} has several indexes; say which index_type")
        return own[0] if own else None

    def scalars(self) -> list[str]:
        return [f.name for f in self.fields.values() if not f.is_vector]

    def vectors(self) -> list[str]:
        return [f.name for f in self.fields.values() if f.is_vector]

    def evolve(self, fields: list[dict[str, Any]]) -> Space:
        """This space with fields added; those that are there must stay as they are."""
        old = {f.name: f for f in self.fields.values()}
        new = Space.parse({"name": self.name, "fields": [{**asdict(f)} for f in old.values()] + [f for f in fields if f.get("name") not in old]})
        for f in fields:
            if (o := old.get(f.get("name", ""))) and (TYPES.get(str(f.get("type")).lower()), int(f.get("dimension") or 0)) != (o.type, o.dimension):
                raise param(f"field {o.name} cannot change")
        out = Space(**{**self.__dict__, "fields": new.fields, "indexes": list(self.indexes)})
        for i in new.indexes:
            out.add_index(i)
        return out

    def to_json(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_json(cls, x: dict[str, Any]) -> Space:
        return cls(**{**x, "fields": {k: Field(**v) for k, v in x["fields"].items()}, "indexes": [Index(**i) for i in x["indexes"]]})

    def spark_schema(self) -> T.StructType:
        own = [T.StructField(f.name, T.BinaryType() if self.is_binary(f.name) else SPARK[f.type], True, {"dimension": f.dimension, "format": f.format} if f.is_vector else {}) for f in self.fields.values()]
        return T.StructType([T.StructField("_id", T.StringType()), *own, T.StructField("_docid", T.LongType())])

    def is_binary(self, name: str) -> bool:
        return self.fields[name].is_vector and any(i.type == "BINARYIVF" and i.fields == [name] for i in self.indexes)


def timestamp(value: Any) -> datetime:
    """A date literal: whole seconds since the epoch, or a date string."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return datetime.fromtimestamp(value, UTC)
    try:
        got = datetime.fromisoformat(str(value).strip().replace("/", "-"))
    except ValueError:
        raise param(f"bad date {value!r}") from None
    return got if got.tzinfo else got.replace(tzinfo=UTC)


def check_rule(space: Space, rule: dict[str, Any]) -> None:
    """A partition rule: type RANGE over a date field, ranges with unique names and rising values (exclusive upper bounds)."""
    f = space.fields.get(rule.get("field") or "")
    if f is None or f.type != "date":
        raise param("a partition rule needs a date field")
    if rule.get("type") != "RANGE":
        raise param("only partition rules of type RANGE are supported")
    ranges = rule.get("ranges") or []
    if not ranges or len(ranges) > MAX_PARTITIONS or len(ranges) * space.partition_num > MAX_TOTAL_PARTITIONS:
        raise param(f"{len(ranges)} ranges of {space.partition_num} partitions")
    names = [r.get("name") or "" for r in ranges]
    if "" in names or len(set(names)) < len(names) or any(r.get("value") in (None, "") for r in ranges):
        raise param("ranges need unique names and values")
    values = [timestamp(r["value"]) for r in ranges]
    if any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise param("range values must rise")
