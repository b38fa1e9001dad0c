"""Near-real-time ingest: streamed upserts in micro-batches, and search over the index and what it has not taken yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vekspar.operators.search import ranked


def stream_upserts(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, refresh_ms: int = 1000, position: str = "_pos") -> StreamingQuery | None:
    """Applies a stream of partial documents with write(batch) each refresh interval; below 0 ingest is off.

    position: a column that orders rows within the stream; of one id the last wins. An upsert is idempotent, so a batch
    that is replayed after a failure gives the same state.
    """
    if refresh_ms < 0:
        return None

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write(batch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=f"{refresh_ms} milliseconds").start()


def merged(indexed: DataFrame, buffered: DataFrame, k: int, higher: bool, id_col: str = "_id") -> DataFrame:
    """Top-k over an index's rows and a buffer's, an id once with its better score."""
    both = indexed.select("qid", id_col, "_score").unionByName(buffered.select("qid", id_col, "_score"))
    best = F.max("_score") if higher else F.min("_score")
    return ranked(both.groupBy("qid", id_col).agg(best.alias("_score")), k, higher, id_col)
