"""Corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage reads what its predecessor wrote. All but the last return the columns of documents;
the last returns the pieces of documents with their places in packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm.common import Workspace, fresh, scan
from tideflow.llm.decontaminate import decontaminate
from tideflow.llm.line_dedup import dedup_lines
from tideflow.llm.near_dedup import keep_one
from tideflow.llm.packing import pack_documents
from tideflow.llm.quality import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the fences of their language and source reject."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that occur earlier; n_chars follows the text."""
    (info,) = fresh(docs, "_lines")
    out = dedup_lines(docs, info=info).drop(info)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    (info,) = fresh(docs, "_contamination")
    out = decontaminate(docs, scan(spark, sf_dir, "benchmark"), info=info)
    return out.where(F.col(f"{info}.n_hit") == 0).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing),
]
#: Near-dedup and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = scan(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
