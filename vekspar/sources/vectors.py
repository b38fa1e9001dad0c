"""Readers of vector files: fvecs, ivecs and bvecs as binary files on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"fvecs": ("<f4", "array<float>", pa.float32()), "ivecs": ("<i4", "array<int>", pa.int32()), "bvecs": ("u1", "array<int>", pa.int32())}


def read_vecs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path (of the file), row, vector; a file is a series of (dimension as int32, components)."""
    dtype, spark_type, arrow = _KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not data:
                    continue
                d = int(np.frombuffer(data, "<i4", 1)[0])
                rows = np.frombuffer(data, np.uint8).reshape(-1, 4 + d * np.dtype(dtype).itemsize)[:, 4:]
                x = np.ascontiguousarray(rows).view(dtype)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()).cast(arrow), d).cast(pa.list_(arrow))], ["path", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, row long, vector {spark_type}")
