"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, then mixing to target weights.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame; run() writes
each one's rows as Parquet to the shared folder and hands them to the next.

- quality: documents that the ranking model rejects (score below its cut) go.
- near_duplicates: one document of each group of similar documents stays, the one with the smallest doc_id.
- decontamination: documents that hold a benchmark item go.
- secrets: all documents stay; secrets in their texts are masked and n_chars follows.
- mixing: all documents stay and get their places in the mixing order (block, slot, release, deadline, position).

Nulls: a null text is an empty one; a null doc_id never names a group, so such rows pass near_duplicates. Columns that
documents has beyond its five stay as they are, whatever their names: where one has the name of a column of the last
stage's, the stage's gets an underscore before it. Each stage's tables in the shared folder go once the next one's
rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vekspar.llm.common import dropped, made, table, unused, written
from vekspar.llm.decontaminate import drop_leaks
from vekspar.llm.jaccard import one_of_each
from vekspar.llm.mixing import mix_sources
from vekspar.llm.quality import quality_scores
from vekspar.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_scores(docs, table(spark, sf_dir, "labels")).where(f"{unused(docs, 'predicted')} = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: SQL can express neither the learned score nor the schedule; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(spark, since, docs)
    return docs
