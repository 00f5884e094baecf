"""Cleaning of a corpus in stages, each by one corpus operator.

Every stage takes the whole of what its predecessor kept. All but the last
return the columns of documents; a stage that decides on rows keeps or drops
them whole. Rows with a null doc_id are judged like others; an empty table
passes through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, near_dedup, packing, pii, quality
from tracewright.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compression margins leave open, or that have none."""
    labelled = docs.filter(~language_id.held_out()).select(F.col("doc_id").alias("key"), "text", "lang")
    return language_id.identified(docs, language_id.learned(labelled)).filter(~F.col("lang_rejected")).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or whose posterior quality is low."""
    return quality.judged(docs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near duplicates.

    Every row is judged by itself, whatever rows share its doc_id: it goes
    only if its words are those of a near duplicate that stays. A null doc_id
    comes after all others; rows without words are linked with nothing and
    stay. The row numbers are written down, so that all steps see the same."""
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_dedup.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("_row")
    kept = found.join(numbered.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first).select("_row")
    return numbered.join(kept, "_row", "left_semi").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; no document goes."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; its rows are the pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: Trained stages and packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
