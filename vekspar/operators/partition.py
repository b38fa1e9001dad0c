"""Range partition rules and stable hash buckets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vekspar.errors import Code, EngineError, param
from vekspar.schema import Space, check_rule, timestamp


def partition_name(rule: dict[str, Any], column: str | None = None) -> Column:
    """The name of the first range whose value is above the row's date; null past the last range."""
    c = F.col(column or rule["field"])
    out = None
    for r in rule["ranges"]:
        hit = c < F.lit(timestamp(r["value"]))
        out = F.when(hit, r["name"]) if out is None else out.when(hit, r["name"])
    return out.alias("partition_name")


def bucket(n: int, column: str = "_id") -> Column:
    """The hash slot of a key; where a row lands is not part of any result."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("partition_name").agg(F.count("*").alias("doc_num"))


def add_ranges(space: Space, ranges: list[dict[str, str]]) -> None:
    """Adds ranges to the rule, which must still rise when sorted by value."""
    rule = space.partition_rule or {}
    names = {r["name"] for r in rule.get("ranges", [])}
    if any(r.get("name") in names for r in ranges):
        raise EngineError(Code.PARTITION_EXIST, "a range of that name exists")
    new = {**rule, "ranges": sorted([*rule.get("ranges", []), *ranges], key=lambda r: timestamp(r["value"]))}
    check_rule(space, new)
    space.partition_rule = new


def drop_ranges(space: Space, names: list[str]) -> None:
    """Drops ranges from the rule; the caller drops their rows."""
    rule = space.partition_rule or {"ranges": []}
    have = {r["name"] for r in rule["ranges"]}
    if missing := [n for n in names if n not in have]:
        raise EngineError(Code.PARTITION_NOT_EXIST, f"no range {missing}")
    left = [r for r in rule["ranges"] if r["name"] not in names]
    if not left:
        raise param("a rule needs a range")
    space.partition_rule = {**rule, "ranges": left}
