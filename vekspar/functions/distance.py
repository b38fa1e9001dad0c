"""Distances as Column expressions, and their NumPy twins for the Arrow kernel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics and whether a higher score is better.
HIGHER = {"InnerProduct": True, "Cosine": True, "L2": False, "Hamming": False}


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def normalized(a: Column) -> Column:
    """The vector over its norm; an error for a zero or non-finite norm, as for the same vector in a request."""
    n = norm(a)
    ok = (n > 0) & (n < float("inf"))
    return F.when(ok | a.isNull(), F.zip_with(_double(a), F.array_repeat(n, F.size(a)), lambda x, y: x / y)).otherwise(F.raise_error(F.lit("a zero or non-finite vector cannot be normalized")))


def cosine(a: Column, b: Column) -> Column:
    return inner_product(a, b) / (norm(a) * norm(b))


def packed_signs(name: str) -> Column:
    """The signs of a vector column's components as bits of longs, 32 to each."""
    bits = f"transform(slice({name}, w * 32 + 1, 32), (x, i) -> if(x > 0, shiftleft(1L, i), 0L))"
    return F.expr(f"transform(sequence(0, cast(floor((size({name}) - 1) / 32) as int)), w -> aggregate({bits}, 0L, (s, x) -> s + x))")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


COLUMNS: dict[str, Callable[[Column, Column], Column]] = {"InnerProduct": inner_product, "L2": squared_l2, "Cosine": cosine, "Hamming": hamming}


def significant(v: np.ndarray, digits: int = 15) -> np.ndarray:
    """v rounded to so many significant digits, at any magnitude, so that equal vectors tie on any plan."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        place = np.floor(np.log10(np.abs(v)))
        scale = 10.0 ** np.clip(digits - 1 - np.where(np.isfinite(place), place, 0), -300, 300)
        out = np.rint(v * scale) / scale
    return np.where(np.isfinite(out), out, v) + 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / np.abs(x).max(-1, keepdims=True)
        return x / np.sqrt((x * x).sum(-1, keepdims=True))


def rough(metric: str, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Scores of all rows of x against all of q by one matrix product, and a bound of their error; Hamming's are exact."""
    if metric == "Hamming":
        s = np.zeros((len(x), len(q)))
        for w in range(x.shape[1]):
            s += np.bitwise_count(x[:, w][:, None] ^ q[:, w])
        return s, 0.0
    x, q = x.astype(np.float64), q.astype(np.float64)
    eps = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps
    if metric == "Cosine":
        s = _unit(x) @ _unit(q).T
        return s, eps + 1e-11 * np.abs(s)  # the last term is exact()'s rounding
    xx, qq = np.sqrt((x * x).sum(1))[:, None], np.sqrt((q * q).sum(1))[None]
    if metric == "InnerProduct":
        s = x @ q.T
        return s, eps * xx * qq + 1e-11 * np.abs(s)
    s = xx * xx + qq * qq - 2 * (x @ q.T)
    return s, eps * (xx + qq) ** 2 + 1e-11 * np.abs(s)


def moved(metric: str, x: np.ndarray, near: np.ndarray, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How far the scores of rows of x against q may be from s, those of rows near them."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    away = np.sqrt(((x - near) ** 2).sum(1))[:, None]
    if metric == "L2":
        return away * (2 * np.sqrt(np.maximum(s, 0)) + away)
    if metric == "Cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.isfinite(s), 2 * away / np.sqrt((x * x).sum(1))[:, None], np.inf)
    return away * np.sqrt((q * q).sum(1))[None]


def exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of rows of x against the vector q in double precision, L2 by differences, whatever the vectors' scale; a zero vector's cosine is NaN."""
    if metric == "Hamming":
        return np.bitwise_count(x ^ q).sum(1).astype(np.float64)
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == "L2":
        return significant(((x - q) ** 2).sum(1))
    if metric == "Cosine":
        x, q = _unit(x), _unit(q)
    return significant((x * q).sum(1))
