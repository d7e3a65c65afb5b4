"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of documents, but for the last, which returns where
each piece of each document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfade.llm.decontaminate import decontaminate
from crossfade.llm.minhash_dedup import drop_near_duplicates
from crossfade.llm.packing import pack_documents
from crossfade.llm.quality_knn import fit_quality, held_out, keep_quality
from crossfade.llm.queries import LEAST_QUALITY, PACK_WORDS, table
from crossfade.llm.secret_scan import redact_secrets
from crossfade.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts score as the sample's mean and stay, repeated rows are judged alike, other columns play no part."""
    labels = table(spark, sf_dir, "labels")
    return keep_quality(docs, fit_quality(docs, labels.where(~held_out(F.col("doc_id")))), least=LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, a null id last, of repeated rows any one. Null and empty texts stay."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay, repeated rows are judged alike, other columns play no part."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), "drop")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows where a text changes. All rows stay, null and empty texts as they are."""
    return redact_secrets(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed: a row for each piece, and one without a bin for a text without words; repeated rows are packed apart."""
    return pack_documents(docs, PACK_WORDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("secrets", secrets), ("packing", packing)]

#: The classifier and the bins of a best-fit search have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has written goes once the next has written."""
    docs, before = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        now = Scratch(spark)
        docs = now.table(stage(spark, docs, sf_dir), name)
        before.clear()
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
