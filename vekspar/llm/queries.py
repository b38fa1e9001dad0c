"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vekspar.llm import decontaminate, forest, jaccard, mixing, passages, pii, quality, secrets, sql, suffixes, warc
from vekspar.llm.common import table


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.record_types(table(spark, sf_dir, "pages")))
    got = warc.read_archives(archives)
    return got.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"), "record_id", "warc_date")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(_count(k) for k in secrets.KINDS[:3]), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"), _count("guess"))


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    out = pii.scan_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(_count(k) for k in pii.BASE), F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": sql.JACCARD, "op4_vector_forest": sql.VECTORS, "op6_warc_archives": sql.ARCHIVES, "op7_suffix_dedup": sql.REPEATS}
