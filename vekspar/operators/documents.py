"""Document writes as DataFrame algebra: partial upserts, deletes and ordered gets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vekspar.errors import Code, EngineError

MAX_IDS = 499


def last_wins(batch: DataFrame, position: str, id_col: str = "_id") -> DataFrame:
    """One row for each id: of each field the last value of the batch that is not null, as if rows were applied in order."""
    pick = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in batch.columns if c not in (id_col, position)]
    return batch.groupBy(id_col).agg(*pick, F.max(position).alias(position))


def upserted(old: DataFrame, new: DataFrame, id_col: str = "_id") -> DataFrame:
    """old with new's values where they are not null (null: not supplied) and new's further rows. new: a row for each id."""
    n = new.select(F.col(id_col).alias("_n_id"), *(F.col(c).alias(f"_n_{c}") for c in new.columns if c != id_col))
    j = old.join(n, F.col(id_col) == F.col("_n_id"), "full_outer")
    pick = lambda c: F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c)
    return j.select(F.coalesce("_n_id", id_col).alias(id_col), *(pick(c) for c in old.columns if c != id_col))


def deleted(old: DataFrame, ids: DataFrame, id_col: str = "_id") -> DataFrame:
    return old.join(ids.select(id_col), id_col, "left_anti")


def check_ids(ids: Sequence[str], code: Code) -> None:
    if len(ids) > MAX_IDS:
        raise EngineError(code, f"{len(ids)} ids; at most {MAX_IDS}")


def by_ids(data: DataFrame, ids: Sequence, id_col: str = "_id") -> DataFrame:
    """Rows of those ids in the order of the request (column _pos); ids that are not there are left out.

    At most 499 ids, so they are a literal filter that Parquet statistics prune by, and the order is a lookup.
    """
    check_ids(ids, Code.QUERY_INVALID_PARAMS_LENGTH_OF_DOCUMENT_IDS_BEYOND_500)
    kind = dict(data.dtypes)[id_col]
    pos = F.explode(F.array_compact(F.array(*(F.when(F.col(id_col) == F.lit(i).cast(kind), F.lit(n)) for n, i in enumerate(ids))))) if ids else F.lit(0)
    return data.where(F.col(id_col).isin(list(ids))).withColumn("_pos", pos).orderBy("_pos")


def scroll(data: DataFrame, after: int, n: int = 1, docid: str = "_docid", where: Column | None = None) -> DataFrame:
    """The next n live rows after a docid, in docid order."""
    d = data.where(F.col(docid) > after)
    return (d if where is None else d.where(where)).orderBy(docid).limit(n)


def with_docid(spark: SparkSession, rows: DataFrame, base: int) -> DataFrame:
    """Rows with a unique, rising _docid above base; gaps are allowed, as after deletes, so no global sort is needed."""
    return rows.withColumn("_docid", F.lit(base + 1).cast("long") + F.monotonically_increasing_id())
