"""Mixing sources to target weights by Pfair scheduling (operator 5).

A source's j-th block, its target weight being w of a total of W, is released at slot floor(j W / w) and due at slot
ceil((j + 1) W / w). Earliest deadline first over those windows fills every slot and keeps each source's share of every
prefix within one block of its target. Weights are taken as they are, as whole numbers in exact proportion. One task
runs the schedule and writes a row for each block, which is all it holds or hands on besides a row for each source. When a
source runs dry the others go on with their own weights in a new phase: no row is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vekspar.llm.common import carried, unused, written

BLOCK = 32
SALT_ROWS = 8192
_NULL = "\0null"


def slots(weights: Mapping[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """The slots in order, without end: (source, j, release, deadline). Ties of deadlines go by source name."""
    q = sum(weights.values())
    wait = [(0, s, 0) for s in sorted(weights) if weights[s] > 0]
    ready: list[tuple[int, str, int, int]] = []
    t = 0
    while wait or ready:
        while wait and wait[0][0] <= t:
            r, s, j = heapq.heappop(wait)
            heapq.heappush(ready, (-(-(j + 1) * q // weights[s]), s, j, r))
        d, s, j, r = heapq.heappop(ready)
        yield s, j, r, d
        heapq.heappush(wait, ((j + 1) * q // weights[s], s, j + 1))
        t += 1


def period(weights: Mapping[str, int]) -> list[tuple[str, int, int, int]]:
    """The slots after which all sources are at their targets again."""
    return list(islice(slots(weights), sum(weights.values())))


def plan(weights: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """All blocks of all sources in slot order: (source, block, slot, release, deadline)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    at = 0
    while left:
        had = dict.fromkeys(left, 0)
        for t, (s, j, r, d) in enumerate(slots({s: weights[s] for s in left})):
            if j >= left[s]:  # a source has no block for its slot
                break
            had[s] = j + 1
            yield s, blocks[s] - left[s] + j, at + t, at + r, at + d
        at += t
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Target weights as whole numbers in exact proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    of = lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * of) for s, x in exact.items()}
    by = gcd(*whole.values())
    return {s: w // by for s, w in whole.items()}


def targets(counts: Mapping[str, int], weights: Mapping[str, float] | None, power: float) -> dict[str, float]:
    """Each source's target weight, as mix_sources says."""
    if weights is None:
        return {s: n**power for s, n in counts.items()}
    rest = sum(weights.values()) / len(weights) if weights else 1.0
    return {s: weights.get(s, rest) for s in counts}


def mix_sources(documents: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block: int = BLOCK) -> DataFrame:
    """documents in their mixing order: all rows and columns, with block, slot, release, deadline and position.

    weights: the target weight of each source, above 0; a source that is not named gets the mean of those that are.
    0 or less is an error. None: each source's count to the given power. A null source is a source of its own. Within
    a source, rows come in the order of the hashes of all their columns, so only rows that are equal in every column
    can change places. position = slot * block + the row's place in its block, so a source's last block may leave a
    gap. Where documents has a column of a new one's name, the new one gets underscores before its name.
    """
    if bad := [s for s, w in (weights or {}).items() if not w > 0]:
        raise ValueError(f"target weights of {bad} are not above 0")
    new = ["block", "slot", "release", "deadline", "position"]
    named = [unused(documents, n) for n in new]
    d = carried(documents, _s=F.coalesce(F.col("source").cast("string"), F.lit(_NULL)), _h=F.xxhash64(*documents.columns))
    sources = written(d.groupBy("_s").count(), "sources")

    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {s: n for b in batches for s, n in zip(b.column("_s").to_pylist(), b.column("count").to_pylist(), strict=True)}
        blocks = plan(whole_weights(targets(counts, weights, power)), {s: -(-n // block) for s, n in counts.items()})
        while rows := list(islice(blocks, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["_s", *new[:4]])

    lookup = written(sources.coalesce(1).mapInArrow(schedule, "_s string, block long, slot long, release long, deadline long"), "schedule")
    salts = max(1, -(-(sources.agg(F.max("count")).first()[0] or 1) // SALT_ROWS))
    salt = F.pmod("_h", F.lit(salts))
    many = written(d.groupBy("_s", "_h").agg(F.count("*").alias("_n")).where(F.col("_n") > SALT_ROWS).drop("_n"), "equal-rows")
    shape = ["row", "_s", "_h", "_salt"]
    if n := many.count():  # rows equal in all columns, over SALT_ROWS of each: any salt will do, if a row keeps it
        many = many.withColumn("_many", F.lit(True))
        d = d.join(F.broadcast(many) if n <= 100_000 else many, ["_s", "_h"], "left")
        dealt = written(d.where("_many").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).select(shape), "dealt")
        d = d.where("_many is null").withColumn("_salt", salt).select(shape).unionByName(dealt)
    else:
        d = d.withColumn("_salt", salt).select(shape)
    before = d.groupBy("_s", "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy("_s").orderBy("_salt")) - F.col("count")).drop("count")
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("_s", "_salt").orderBy("_h")) - 1)
    d = d.join(before, ["_s", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    d = d.withColumn("block", F.floor(F.col("_rank") / block)).join(lookup, ["_s", "block"])
    return d.withColumn("position", F.col("slot") * block + F.col("_rank") % block).select("row.*", *(F.col(n).alias(m) for n, m in zip(new, named, strict=True)))
