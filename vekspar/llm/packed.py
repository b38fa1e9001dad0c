"""Small fixed-width records, packed a few thousand to a row, on their way to the shard that their key names.

A map task packs what it has for each shard into one binary row, so a shuffle moves columns of numbers instead of tens
of millions of rows. The number of shards follows the input; over FAN of them are reached in several rounds, each
splitting its shards by FAN, so rows stay well filled at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vekspar.llm.common import by_group
from vekspar.llm.words import mix

FAN = 1024
SCHEMA = "shard long, dest long, kind int, data binary"
NAMES = ["shard", "dest", "kind", "data"]
SPLIT_ROWS = 4_000_000
MOST_TASKS = 16_384
Layout = list[tuple[str, str]]


def _planes(x: np.ndarray, kind: str) -> list[bytes]:
    """The first bytes of all numbers, then the second ones and so on: the bytes that are zero in all compress to next to nothing."""
    x = x.astype(kind)
    return [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()]


def _whole(data: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(-1), at + n * size


def pack(layout: Layout, cols: dict[str, np.ndarray], rows: np.ndarray | slice = slice(None)) -> bytes:
    """Columns one after the other, of types as follows; others are as numpy has them.

    id: a table of its values and an index into it. doc, which comes first if at all: rows are brought in its order;
    the steps from value to value, and how many rows each has. of: unsigned numbers of 32 bits, once for each value of
    doc where its rows all have the same. p4: the same in planes of bytes.
    """
    out, n = [], None
    for name, kind in layout:
        x = cols[name][rows]
        if kind == "id":
            seen, at = np.unique(x.astype(np.int64), return_inverse=True)
            narrow = np.uint16 if len(seen) <= 1 << 16 else np.uint32
            out += [np.array([len(x), len(seen)], np.int64).tobytes(), seen.tobytes(), at.astype(narrow).tobytes()]
        elif kind == "doc":
            x = x.astype(np.int64)
            if (x[1:] < x[:-1]).any():
                order = np.argsort(x, kind="stable")
                x, rows = x[order], np.arange(len(cols[name]))[rows][order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(x)])
            out += [np.array([len(x), len(first)], np.int64).tobytes(), *_planes(np.diff(x[first], prepend=0), "i8"), *_planes(n, "u4")]
        elif kind == "of":
            short = x[first]
            short = short if (np.repeat(short, n) == x).all() else x
            out += [np.array([len(x), len(short)], np.int64).tobytes(), *_planes(short, "u4")]
        elif kind == "p4":
            out += [np.array([len(x), -1], np.int64).tobytes(), *_planes(x, "u4")]
        else:
            out += [np.array([len(x), -1], np.int64).tobytes(), x.astype(kind).tobytes()]
    return b"".join(out)


def unpack(layout: Layout, blobs: Iterable[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {n: [np.zeros(0, np.int64 if k in ("id", "doc", "of") else "u4" if k == "p4" else k)] for n, k in layout}
    for data in blobs:
        at = 0
        for name, kind in layout:
            n, seen = np.frombuffer(data, np.int64, 2, at)
            at += 16
            if kind == "id":
                values = np.frombuffer(data, np.int64, seen, at)
                at += 8 * seen
                narrow = np.uint16 if seen <= 1 << 16 else np.uint32
                parts[name].append(values[np.frombuffer(data, narrow, n, at)])
                at += n * np.dtype(narrow).itemsize
            elif kind == "doc":
                steps, at = _whole(data, "i8", seen, at)
                each, at = _whole(data, "u4", seen, at)
                parts[name].append(np.repeat(np.cumsum(steps), each))
            elif kind == "of":
                x, at = _whole(data, "u4", seen, at)
                parts[name].append((x if seen == n else np.repeat(x, each)).astype(np.int64))
            elif kind == "p4":
                x, at = _whole(data, "u4", n, at)
                parts[name].append(x)
            else:
                parts[name].append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
    return {n: np.concatenate(x) for n, x in parts.items()}


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key.astype(np.uint64) ^ np.uint64(0xA5A5)) % np.uint64(shards)).astype(np.int64)


def first_width(shards: int) -> int:
    width = 1
    while ceil(shards / width) > FAN:
        width *= FAN
    return width


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    shard, dest, kind, data = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(dest, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], NAMES)


def deal(layout: Layout, cols: dict[str, np.ndarray], shard: np.ndarray, kind: int, width: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of the given kind, one for each shard (shards in groups of `width`) that has records."""
    shard = shard // width
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    rows = []
    for r in np.split(order, cuts) if len(order) else []:
        rows.append((int(shard[r[0]]), int(shard[r[0]]), kind, pack(layout, cols, r)))
        if len(rows) >= 256:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def regroup(df: DataFrame, layout: Layout, key: str, shards: int, kind: int = 0) -> DataFrame:
    """df, whose rows of that kind are dealt in groups of first_width(shards), dealt out to single shards; other rows pass."""
    width = first_width(shards)
    while width > 1:
        width //= FAN

        def split(g: dict, width: int = width) -> Iterable[pa.RecordBatch]:
            held, size = [], 0
            for k, row in zip(g["kind"].to_pylist(), zip(g["shard"].to_pylist(), g["dest"].to_pylist(), g["data"].to_pylist(), strict=True), strict=True):
                if k != kind:
                    yield batch([(row[1] // width, row[1], k, row[2])])
                    continue
                held.append(row[2])
                size += len(row[2])
                if size > 16 * SPLIT_ROWS:
                    cols = unpack(layout, held)
                    yield from deal(layout, cols, shard_of(cols[key], shards), kind, width)
                    held, size = [], 0
            if held:
                cols = unpack(layout, held)
                yield from deal(layout, cols, shard_of(cols[key], shards), kind, width)

        df = by_group(df, ["shard"], split, SCHEMA)
    return df


def by_shard(df: DataFrame, fn: Callable[[int, dict[int, list[bytes]]], Iterable[pa.RecordBatch]], schema: str = SCHEMA, shards: int = 1) -> DataFrame:
    """fn(shard, rows' data by kind) on each shard. shards: how many there are, so that a task's share does not grow with the input."""

    def run(g: dict) -> Iterable[pa.RecordBatch]:
        rows: dict[int, list[bytes]] = {}
        for k, data in zip(g["kind"].to_pylist(), g["data"].to_pylist(), strict=True):
            rows.setdefault(k, []).append(data)
        return fn(g["shard"][0].as_py(), rows)

    return by_group(df, ["shard"], run, schema, tasks=min(shards, MOST_TASKS))
