"""Quality scores by Bradley-Terry pairwise ranking (operator 10).

Each preference pair is a labelled-good and a labelled-bad text; the model is the Bradley-Terry one with linear
strengths, so it learns by logistic loss on the difference of the pair's features. Raw strengths become scores by a
one-dimensional logistic fit, shifted so that a score of 0.3 is the strength quantile that best parts the two labels.

Fitting runs on the driver over at most `sample` labelled texts' feature rows (SAMPLE, a documented bound); scoring
covers every whole text on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vekspar.llm.common import chunks, unused
from vekspar.llm.words import per_text, shingles, words

SAMPLE = 20_000
PAIRS = 200_000
CUT = 0.3
_SYMBOLS = "!#$%&*|<>{}[]=+/\\^~@_.,;:?'\"()-\n"


def features(texts: list[str | None]) -> np.ndarray:
    """A row of bounded numbers for each text, from its characters, words and repetition; an empty text has zeros."""
    enc = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(x) for x in enc])
    seen = np.bincount(np.repeat(np.arange(len(enc)), size) * 256 + np.frombuffer(b"".join(enc), np.uint8), minlength=256 * len(enc)).reshape(-1, 256)
    share = seen / np.maximum(size, 1)[:, None]
    groups = [share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 32], share[:, 128:].sum(1), share[:, :32].sum(1), *(share[:, ord(c)] for c in _SYMBOLS)]
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=1)
    w, at = words(texts)
    n = np.diff(at)
    s, s_at = shingles(w, at)
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(w))
    if len(w) > 1:
        again[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    few = lambda x, o: _distinct(x, o) / np.maximum(np.diff(o), 1)
    lines = [(t or "").split("\n") for t in texts]
    repeated_lines = np.array([1 - len(set(x)) / len(x) for x in lines])
    some = np.maximum(n, 1)
    more = [
        spread / 8, np.log1p(size) / 12, np.log1p(n) / 10, (size / some).clip(0, 40) / 40, few(w, at), few(s, s_at), per_text(again, at, np.add) / some, repeated_lines,
        np.array([max(map(len, x)) for x in lines]).clip(0, 5000) / 5000, n / np.maximum([len(x) for x in lines], 1) / 100, (n == 0).astype(float),
    ]
    raw = np.stack([*groups, *more], axis=1)
    return np.concatenate([raw, np.log1p(100 * raw.clip(0)), few(w, at)[:, None] * np.log1p(n)[:, None] / 10], axis=1)


def _distinct(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=len(offsets) - 1)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 1) -> dict:
    """A model of the strengths; without both labels, one that gives every text 0.5."""
    pos, neg = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if not len(pos) or not len(neg):
        return {"mean": mean, "w": np.zeros(x.shape[1]), "slope": 0.0, "shift": 0.0}
    z = ((x - mean) / std).clip(-8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, 40 * max(len(pos), len(neg)))
    a, b = rng.choice(pos, n), rng.choice(neg, n)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        grad, hess = penalty * w, penalty * np.eye(len(w))
        for s in range(0, n, 20_000):
            d = z[a[s : s + 20_000]] - z[b[s : s + 20_000]]
            p = 1 / (1 + np.exp((d @ w).clip(-30, 30)))
            grad = grad - d.T @ p / n
            hess = hess + (d * (p * (1 - p))[:, None]).T @ d / n
        step = np.linalg.solve(hess + 1e-6 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    raw = z @ w
    quantiles = np.quantile(raw, np.linspace(0, 1, 401)[1:-1])
    parted = [(raw[pos] >= q).mean() + (raw[neg] < q).mean() for q in quantiles]
    best = quantiles[np.flatnonzero(np.array(parted) >= max(parted) - 1e-9)]
    cut = best[len(best) // 2]
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(slope * (raw - cut) + shift).clip(-30, 30)))
        h = p * (1 - p) + 1e-6
        g = np.array([((p - good) * (raw - cut)).sum() + 1e-2 * slope, (p - good).sum()])
        m = np.array([[(h * (raw - cut) ** 2).sum() + 1e-2, (h * (raw - cut)).sum()], [(h * (raw - cut)).sum(), h.sum()]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(m, g).clip(-2, 2)
    slope = max(slope, 0.05)
    return {"mean": mean, "std": std, "w": w, "slope": slope, "shift": np.log(CUT / (1 - CUT)) - slope * cut}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = ((x - model["mean"]) / model.get("std", 1.0)).clip(-8, 8)
    return 1 / (1 + np.exp(-(model["slope"] * (z @ model["w"]) + model["shift"]).clip(-30, 30)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits on the `sample` labelled rows with the lowest hashes that are not held out (rows with nulls don't count).

    Of rows that share a doc_id, those with the lowest hashes of their texts are taken, so that `sample` rows are never
    exceeded.
    """
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).select(F.col("doc_id").alias("_id"), "quality")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id"))  # at most `sample` rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = features(b.column("text").to_pylist()).astype("f4")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast("int64"), b.column("quality").cast("int32"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    if texts.groupBy("_id").count().where("count > 1").limit(1).count():  # an id of several rows: else the labels bound the rows
        texts = texts.orderBy(F.xxhash64("_id"), F.xxhash64("text"), "quality").limit(sample)
    got = texts.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("x", "ascending")])
    width = features([""]).shape[1]
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "f4").reshape(-1, width).astype("f8")
    return fit(x, got.column("quality").to_numpy())


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents with `score` (0 to 1) and `predicted` (score >= 0.3), all columns and rows kept.

    labels: doc_id, quality (0 or 1). A null text counts as an empty one; a null doc_id is scored and never trained on;
    without labels of both kinds every score is 0.5. Where documents has a column of such a name, the new one gets
    underscores before its name (common.unused). Rows that share a doc_id are scored each by its own text.
    """
    model = train(documents, labels, sample)
    new = [unused(documents, n) for n in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = score(model, features(b.column("text").to_pylist()).astype("f4").astype("f8"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype("i4"))], [*b.schema.names, *new])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())]))
