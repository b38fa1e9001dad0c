"""N-gram Jaccard join (operator 3): MinHash bands, Bayesian candidate pruning, exact verification.

1. Texts with equal shingle sets are one class; classes carry on, their copies are never expanded into pairs.
2. Classes whose MinHash values agree in a band of ROWS values meet. A pair's values are compared STEP at a time, and
   the pair is dropped once the posterior probability that its similarity reaches the threshold, the prior being
   uniform, is below TOLERANCE (Satuluri and Parthasarathy, Bayesian Locality Sensitive Hashing). In a band's bucket a
   search from class to class visits all that are reachable over pairs that were not dropped.
3. Within each group of classes so reached, pairs are compared by their MinHash values in the same way and those left
   are verified by their exact similarity. A group of up to BLOCK_BYTES of shingles is one task's. In a larger one the
   pairs that share a band meet in the band's part of the group, the first of their bands counting, so a long chain of
   groups costs as many comparisons as it has neighbours; parts are cut into blocks by bytes, so no task holds more
   than two. A task returns a count for each class and a spanning forest, never pairs.

A pair of similarity 0.8 meets in some band with probability 1 - (1 - 0.8**4)**16 > 0.9997.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vekspar.llm.common import Links, block_pairs, by_group, carried, chunks, components, written
from vekspar.llm.words import mix, per_text, shingles, words

SIMILARITY = 0.8
HASHES, ROWS, STEP, TOLERANCE = 64, 4, 16, 1e-6
BUCKET_ROWS = 16_384
BLOCK_BYTES = 12_000_000
TILE, COLUMNS = 256, 32_768
_MUL = np.random.default_rng(3).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(4).integers(1, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in rising order, and their offsets."""
    s, at = shingles(*words(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(texts)))]


def minhashes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits for each text; all ones for one without shingles."""
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = per_text(((s * _MUL[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), at, np.minimum, 2**32 - 1)
    return out


def least_matches(similarity: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For 16, 32, ... compared values, the fewest equal ones at which the pair stays."""

    def reaches(m: int, n: int) -> float:  # of a similarity with posterior Beta(m + 1, n - m + 1)
        return sum(comb(n + 1, i) * similarity**i * (1 - similarity) ** (n + 1 - i) for i in range(m + 1))

    return {n: next(m for m in range(n + 1) if reaches(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def _survivors(one: np.ndarray, many: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of many stay when compared with one, STEP values at a time."""
    left, same = np.arange(len(many)), np.zeros(len(many), np.int64)
    for n, m in least.items():
        same = same + (many[left, n - STEP : n] == one[n - STEP : n]).sum(1)
        left, same = left[same >= m], same[same >= m]
    return left


def _reach(ids: np.ndarray, sigs: np.ndarray, side: np.ndarray | None, least: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs of a spanning forest over the pairs that stay; side: pairs are between sides only."""
    todo = np.ones(len(ids), bool)
    for start in range(len(ids)):
        if not todo[start]:
            continue
        todo[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            others = np.flatnonzero(todo if side is None else todo & (side != side[i]))
            if not len(others):
                continue
            near = others[_survivors(sigs[i], sigs[others], least)]
            todo[near] = False
            stack += near.tolist()
            yield from ((int(ids[i]), int(ids[j])) for j in near)


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_key) of each row, and (set_key, rep, weight, n, sig) of each class with shingles: its smallest id, rows, shingles and MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s, at = shingle_sets(b.column("text").to_pylist())
            key = np.stack([per_text(mix(s + np.uint64(x)), at, np.add) for x in (1, 2)], axis=1)
            n = np.diff(at)
            sig = minhashes(s, at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast("int64"), pa.array([k.tobytes() if m else None for k, m in zip(key, n, strict=True)], pa.binary()), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "set_key", "n", "sig"])

    d = written(documents.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, n int, sig binary"), "sets")
    c = d.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return d.select("doc_id", "set_key"), written(c, "classes")


def _bands(sig: np.ndarray) -> np.ndarray:
    """The key of each band of each row of MinHash values."""
    parts = sig.reshape(len(sig), HASHES // ROWS, ROWS).astype(np.uint64)
    return mix((parts * _MUL[:ROWS]).sum(2, dtype=np.uint64) + np.arange(HASHES // ROWS, dtype=np.uint64))


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def candidates(c: DataFrame, similarity: float) -> DataFrame:
    """(id, root): classes of two or more that are connected over pairs left by Bayesian pruning."""
    least = least_matches(similarity)
    c = c.where("rep is not null")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = _bands(_sigs(b.column("sig")))
            rep = b.column("rep").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(rep, HASHES // ROWS))], ["band", "rep"])

    members = c.select("rep", "sig").mapInArrow(bands, "band long, rep long")
    shared = members.groupBy("band").count().where("count > 1")
    rows = members.join(shared, "band").join(c.select("rep", "sig"), "rep")
    rows = block_pairs(rows, "band", "rep", F.ceil(F.col("count") / BUCKET_ROWS)).drop("count")

    def pairs(g: dict) -> Iterable[pa.RecordBatch]:
        ids = g["rep"].to_numpy()
        sigs = _sigs(g["sig"])
        side = g["own"].to_numpy() if g["bi"][0] != g["bj"][0] else None
        if got := list(_reach(ids, sigs, side, least)):
            a, b = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return components(by_group(rows, ["band", "bi", "bj"], pairs, "a long, b long"))


def _verify(weights: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, own: np.ndarray, within: bool, similarity: float, band: int = -1) -> Links:
    """The exact links of a block pair, a tile at a time, among pairs that Bayesian pruning leaves; band: only those whose first shared band it is."""
    order = np.argsort(own, kind="stable")
    least = least_matches(similarity)
    size = np.array([len(s) for s in sets])[order]
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].astype(np.int32)
    at = np.r_[0, np.cumsum(size)]
    sigs = sigs[order]
    keys = _bands(sigs)[:, : band + 1]
    links, width, n = Links(weights), int(flat.max()) + 1 if len(flat) else 0, len(order)
    half = n if within else int((own == own[order[0]]).sum())
    rows = [(s, min(s + TILE, half)) for s in range(0, half, TILE)]
    cols = rows if within else [(s, min(s + TILE, n)) for s in range(half, n, TILE)]
    for a, (r0, r1) in enumerate(rows):
        for c0, c1 in cols[a if within else 0 :]:
            may = _alike(sigs[r0:r1], sigs[c0:c1], least)
            may &= (size[r0:r1][:, None] >= similarity * size[c0:c1] - 1e-4) & (size[c0:c1] >= similarity * size[r0:r1][:, None] - 1e-4)
            for b in range(band):
                may &= keys[r0:r1, b][:, None] != keys[c0:c1, b]
            if band >= 0:
                may &= keys[r0:r1, band][:, None] == keys[c0:c1, band]
            same = within and r0 == c0
            if same:
                np.fill_diagonal(may, False)
            r, c = r0 + np.flatnonzero(may.any(1)), c0 + np.flatnonzero(may.any(0))
            if not len(r):
                continue
            both = _shared(flat, at, r, c, width)
            union = size[r][:, None] + size[c][None] - both
            links.add((both >= similarity * union - 1e-4) & may[np.ix_(r - r0, c - c0)], order[r], order[c], same)
    return links


def _alike(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs Bayesian pruning leaves, STEP values at a time."""
    same = np.zeros((len(x), len(y)), np.int16)
    may = np.ones(same.shape, bool)
    for n, m in least.items():
        for i in range(n - STEP, n):
            same += x[:, i][:, None] == y[:, i]
        may &= same >= m
        if not may.any():
            break
    return may


def _shared(flat: np.ndarray, at: np.ndarray, r: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    """How many shingles each pair of rows r and c shares: the product of their membership matrices, COLUMNS shingles at a time."""
    mine, other = (np.concatenate([flat[at[i] : at[i + 1]] for i in x]) for x in (r, c))
    row, col = (np.repeat(np.arange(len(x)), at[x + 1] - at[x]) for x in (r, c))
    held = np.zeros(width, bool)
    held[mine] = True
    shared = np.unique(other[held[other]])
    number = np.full(width, -1, np.int32)
    number[shared] = np.arange(len(shared))
    mine, other = number[mine], number[other]
    both = np.zeros((len(r), len(c)), np.float32)
    for s in range(0, len(shared), COLUMNS):
        x, y = (np.zeros((len(k), min(COLUMNS, len(shared) - s)), np.float32) for k in (r, c))
        for z, who, what in ((x, row, mine), (y, col, other)):
            now = (what >= s) & (what < s + COLUMNS)
            z[who[now], what[now] - s] = 1
        both += x @ y.T
    return both


def similar_documents(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links for each row of documents (doc_id whole number, text).

    n_links: the other rows whose shingle sets have that Jaccard similarity or more; class_id: the smallest doc_id
    reachable over links. A text without words, null and empty ones too, links with nothing and is its own class. A
    null doc_id counts as a link of its copies' and gets its class; where all rows of a text have null ids they link
    with each other only and their class_id is null. Rows that share a doc_id and differ in text are taken as
    connected through it.
    """
    rows, c = classes(documents)
    groups = candidates(c, similarity)
    reps = groups.join(c.select(F.col("rep").alias("id"), "weight", "n", "sig"), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s, at = shingle_sets(b.column("text").to_pylist())
            cols = {k: b.column(k) for k in b.schema.names if k != "text"}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([s[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], [*cols, "set"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(HASHES // ROWS)
        for b in batches:
            if b.num_rows:
                key = _bands(_sigs(b.column("sig")))
                times = np.repeat(np.arange(len(key)), len(every))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(times)) for k in ("id", "root", "bytes")), pa.array(np.tile(every, len(key)), pa.int32()), pa.array(key.ravel().view(np.int64))], ["id", "root", "bytes", "band", "part"])

    reps = written(reps.withColumn("bytes", F.col("n").cast("long") * 8 + 400), "reached")
    total = reps.groupBy("root").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    reps = reps.join(total, "root")
    whole = reps.where("blocks = 1").select("id", "root", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("part"), "blocks")
    large = reps.where("blocks > 1").select("id", "root", "bytes", "sig").mapInArrow(parts, "id long, root long, bytes long, band int, part long")
    sizes = large.groupBy("root", "part").agg(F.count("*").alias("count"), F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks")).where("count > 1").drop("count")
    dealt = whole.unionByName(large.join(sizes, ["root", "part"]).drop("bytes"))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(reps.select("id", "weight", "sig"), "id")
    texts = texts.mapInArrow(sets, "id long, weight long, sig binary, set binary").join(dealt, "id")
    texts = block_pairs(texts, "root", "id", F.col("blocks")).drop("blocks")

    def verify(g: dict) -> Iterable[pa.RecordBatch]:
        ids, first = np.unique(g["id"].to_numpy(), return_index=True)
        sets_ = [np.frombuffer(x, np.uint64) for x in g["set"].take(pa.array(first)).to_pylist()]
        yield _verify(g["weight"].to_numpy()[first], sets_, _sigs(g["sig"].take(pa.array(first))), g["own"].to_numpy()[first], g["bi"][0] == g["bj"][0], similarity, g["band"][0].as_py()).rows(ids)

    found = written(by_group(texts, ["root", "part", "bi", "bj"], verify, "id long, links long, other long"), "links")
    comp = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")).join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = c.select("set_key", "rep", "weight").join(links, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(per_class, "set_key", "left")
    return out.select("doc_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents with one row of each class: that whose doc_id is the class_id (any one of rows that share it). Rows with a null doc_id, which no class can name, stay."""
    d = carried(documents, _id=F.col("doc_id").cast("long"))
    kept = similar_documents(documents, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("_id")).distinct()
    first = Window.partitionBy("_id").orderBy(F.xxhash64("row.text"))
    named = d.join(kept, "_id").withColumn("_turn", F.row_number().over(first)).where("_turn = 1")
    return named.select("row.*").unionAll(documents.where("doc_id is null"))
