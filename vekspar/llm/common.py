"""Shared plumbing: the shared folder, written tables, batches of texts and sorted groups."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds at once (a longer single text is held whole).
BATCH_CHARS = 1_500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark, "_vekspar_dir", None) or tempfile.mkdtemp(prefix="vekspar-")
        spark._vekspar_dir = root
    return root.rstrip("/")


class _Made(threading.local):
    """A thread's tables that written() has made and dropped() has not deleted yet, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def made() -> int:
    """How many tables of this thread there are; for dropped()."""
    return len(_made.paths)


def dropped(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes this thread's tables written since there were so many, but for those that keep reads."""
    files = keep.inputFiles() if keep is not None else []
    for path in _made.paths[since:]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _made.paths.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends here and a lost executor costs nothing.

    The table stays, as what is read from it may be computed at any time; dropped() deletes those no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vekspar/{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # else shuffle files stay until the driver collects garbage
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows whole, in a struct column `row`, beside the given columns: no name of df's can clash with them."""
    return df.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in columns.items()))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def released() -> None:
    """Gives back to the system what a Python worker's earlier tasks have freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about so many characters of text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.frombuffer(np.ascontiguousarray(b.column(text).fill_null("").to_pandas().str.len().to_numpy("i8")), "i8") + 16
        part = np.cumsum(size) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                yield b.slice(s, e - s)


def by_group(df: DataFrame, keys: list[str], fn: Callable[[dict], Iterable[pa.RecordBatch]], schema: str, order: list[str] = (), tasks: int = 1) -> DataFrame:
    """fn on each group of rows with equal keys (whole-number columns), as a dict of column name to Arrow array.

    Groups come as sorted runs of a partition, so thousands of small groups cost one Python call each and no
    start-up. A group must fit in memory; callers bound it with block_pairs or a shard count. tasks: how many there
    are at least, if more than spark.sql.shuffle.partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                now = tuple(k[s])
                if last is not None and now != last:
                    yield from fn(_columns(held))
                    held = []
                last = now
                held.append(pa.Table.from_batches([b.slice(s, e - s)]))
        if held:
            yield from fn(_columns(held))

    more = (tasks,) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    return df.repartition(*more, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _columns(held: list[pa.Table]) -> dict:
    t = pa.concat_tables(held) if len(held) > 1 else held[0]
    return {c: t.column(c).combine_chunks() for c in t.column_names}


def block_pairs(df: DataFrame, key: str, row: str, blocks: Column) -> DataFrame:
    """Rows dealt to the block pairs (bi <= bj) of their group, so that every pair of rows of a group meets.

    blocks: how many blocks the group is cut into. `own` tells the row's block; a pair inside one block meets in
    bi = bj, any other in (own, own'). A group's rows come `blocks` times, and no task holds over two blocks.
    """
    own = F.pmod(F.xxhash64(row), blocks).cast("int")
    return (
        df.withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        .withColumn("bi", F.least("own", "_other"))
        .withColumn("bj", F.greatest("own", "_other"))
        .drop("_other")
    )


#: A node with more than this share of all rows is joined by broadcast, so no task gets more of one node's rows.
HOT = 256


def _least(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) as (v, m), m being the least v or u of the row's u; and (u, m) of each u. Of total rows, HOT nodes at most have total / HOT or more."""
    low = written(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    hot = low.where(F.col("n") >= max(1024, -(-total // HOT)))
    if not hot.limit(1).count():
        return rows.join(low, "u").select("u", "v", "m"), low.select("u", "m")
    hot = F.broadcast(hot.select("u", "m", F.lit(True).alias("hot")))  # HOT rows at most
    marked = rows.join(hot, "u", "left")
    rest = marked.where("hot is null").select("u", "v").join(low.select("u", "m"), "u")
    return marked.where("hot").select("u", "v", "m").unionByName(rest), low.select("u", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the long pairs (a, b): a row (id, root) for each node, root the smallest id.

    Alternates large-star and small-star (Kiveris et al., Connected Components in MapReduce and Beyond); each step's
    rows are written to the shared folder, the step before's deleted, and only their number and checksum come to the
    driver. Written steps also keep the plans, which the driver holds, small.
    """
    at = made()
    e, seen = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        met, _ = _least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * now[0])
        large = written(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        met, low = _least(large, now[0])
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(edges.sparkSession, at, e)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


class Links:
    """Weighted link counts and a spanning forest of the rows of a task, from tiles of a boolean link matrix."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.parent = weights, np.zeros(len(weights), np.int64), list(range(len(weights)))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def add(self, hit: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
        """hit[a, b]: rows[a] and cols[b] are linked. same: rows and cols are the same, so each link comes twice."""
        if not hit.any():
            return
        self.count[rows] += hit @ self.weights[cols]
        if not same:
            self.count[cols] += hit.T @ self.weights[rows]
        none = len(rows)
        lab_r, lab_c = np.arange(none), np.full(len(cols), none)
        while True:  # the smallest label over the tile's links
            new_c = np.minimum(lab_c, np.where(hit, lab_r[:, None], none).min(0))
            new_r = np.minimum(lab_r, np.where(hit, new_c[None], none).min(1))
            if (new_r == lab_r).all() and (new_c == lab_c).all():
                break
            lab_r, lab_c = new_r, new_c
        for at, labels in ((rows, lab_r), (cols, lab_c)):
            for i in np.flatnonzero(labels < none):
                p, q = self.root(int(at[i])), self.root(int(rows[labels[i]]))
                if p != q:
                    self.parent[p] = q

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        """(id, links, other): each linked row's count here, and its root in the forest."""
        keep = np.flatnonzero(self.count > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(self.count[keep]), pa.array(ids[[self.root(int(i)) for i in keep]])], ["id", "links", "other"])
