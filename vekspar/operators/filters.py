"""Filter requests as Columns.

A request is {"operator": "AND" | "OR", "conditions": [{"field", "operator", "value"}, ...]}, one level deep. Strings
and string arrays take IN and NOT IN (any element matches), numbers and dates take comparisons, booleans = and <>.
Semantics are those of SQL: a contradiction is empty and bounds are exact. Nulls match nothing, NOT IN included.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vekspar.errors import Code, EngineError, param
from vekspar.schema import Space, timestamp

_COMPARE = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v,
}


def condition(name: str, kind: str, op: str, value: Any) -> Column:
    """One condition on a field of the given type."""
    c = F.col(name)
    if op in ("IN", "NOT IN"):
        if kind not in ("string", "string_array"):
            raise param(f"{name}: {op} is for strings")
        values = [value] if isinstance(value, str) else list(value)
        if not values or not all(isinstance(v, str) for v in values):
            raise param(f"{name}: {op} needs strings")
        hit = c.isin(values) if kind == "string" else F.arrays_overlap(c, F.array(*map(F.lit, values)))
        return hit if op == "IN" else ~hit
    if op not in _COMPARE:
        raise EngineError(Code.FILTER_CONDITION_OPERATOR_TYPE_ERR, f"condition operator {op!r}")
    if kind in ("string", "string_array", "vector"):
        raise param(f"{name}: {op} is for numbers and dates")
    if kind == "boolean" and op not in ("=", "!=", "<>"):
        raise param(f"{name}: {op} is not for booleans")
    if kind == "date":
        value = timestamp(value)
    elif isinstance(value, str):
        try:
            value = float(value) if kind in ("float", "double") else int(value)
        except ValueError:
            raise param(f"{name}: {value!r} is not a number") from None
    literal = F.lit(value).cast("float") if kind == "float" else F.lit(value)
    return _COMPARE[op](c, literal)


def to_column(request: Mapping[str, Any] | None, space: Space | None = None, types: Mapping[str, str] | None = None) -> Column:
    """The request's Column; with a space, its fields must exist and be indexed. types: field types where there is no space."""
    if not request or not request.get("conditions"):
        return F.lit(True)
    how = request.get("operator")
    if how not in ("AND", "OR"):
        raise EngineError(Code.FILTER_OPERATOR_TYPE_ERR, f"filter operator {how!r}")
    found = []
    for c in request["conditions"]:
        name = c.get("field", "")
        if space is not None:
            if name not in space.fields:
                raise param(f"no field {name!r}")
            if not space.indexed(name):
                raise param(f"field {name} is not indexed")
            kind = space.fields[name].type
        else:
            kind = (types or {}).get(name, "")
        found.append(condition(name, kind, c.get("operator", ""), c.get("value")))
    return reduce(and_ if how == "AND" else or_, found)
