"""The corpus pipeline: toxic documents go, then repeated lines, near copies and long repeats; the rest is packed.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
table; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import table
from tickloom.llm.line_dedup import drop_lines
from tickloom.llm.packing import pack_documents
from tickloom.llm.run_index import cut_repeats
from tickloom.llm.token_join import keep_one
from tickloom.llm.toxicity import drop_toxic
from tickloom.session import cut_lineage, drop_written, prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a classifier chain fitted on `labels`."""
    return drop_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; documents without any line left go."""
    return drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return keep_one(docs, 5, 80)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start anywhere else."""
    return cut_repeats(docs, 200)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their sequence and place."""
    return pack_documents(docs, "byte_bpe_50k.json", 1024, 2, keep=False)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("long_repeats", long_repeats),
    ("packing", packing),
]

# a fitted classifier and a tokenizer aren't SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again; what a stage has read goes when it is written."""
    docs, read = table(prepare(spark), sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
