"""Queries of the operators over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import (
    collocations,
    edit_counts,
    line_dedup,
    multi_index,
    packing,
    pareto_mix,
    piece_codec,
    pivot_join,
    run_index,
    token_files,
    token_join,
    toxicity,
    whitening,
)
from tickloom.llm.common import table
from tickloom.session import prepare, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_run_index")
def repeats_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every text in strings of 200 bytes that also start elsewhere."""
    return run_index.repeat_digest(table(prepare(spark), sf, "documents"), 200)


@query("op2_multi_index")
def near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of every hundredth, by an inverted multi-index."""
    return multi_index.nearest(table(prepare(spark), sf, "embeddings"), 10, 100)


@query("op3_pivot_join")
def best_products(spark: SparkSession, sf: str) -> DataFrame:
    """Five best integer inner products of every fiftieth vector."""
    return pivot_join.top_products(table(prepare(spark), sf, "embeddings"), 5, 50)


@query("op4_line_dedup", line_dedup.REPORT_SQL)
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every text that an earlier line equals or differs from in one word."""
    return line_dedup.line_report(table(prepare(spark), sf, "documents"))


@query("op5_toxicity_chain")
def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of poor quality and toxicity of every document."""
    return toxicity.toxicity_scores(table(prepare(spark), sf, "documents"), table(spark, sf, "labels"))


@query("op6_token_files")
def token_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded, written as token files and read back."""
    path = shared_folder(prepare(spark), "token-files")
    token_files.write_token_files(table(spark, sf, "documents"), path, "word_bpe_49k.json", end_id=1)
    return token_files.read_token_files(spark, path)


@query("op7_token_join")
def linked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return token_join.linked_components(table(prepare(spark), sf, "documents"), 5, 80)


@query("op8_edit_counts")
def counts_under_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of every text before and after three edits."""
    docs = table(prepare(spark), sf, "documents")
    return edit_counts.edited_counts(docs, edit_counts.sample_edits(docs))


@query("op9_piece_codec")
def coded_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded to pieces and decoded again."""
    return piece_codec.coding_report(table(prepare(spark), sf, "documents"), "piece_bpe_32k.model")


@query("op10_packing")
def packed_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack_documents(table(prepare(spark), sf, "documents"), "byte_bpe_50k.json", 1024, 2)


@query("op11_collocations", collocations.REPORT_SQL)
def phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """First 2000 phrases of every language by the score of their weakest cut."""
    return collocations.collocations(table(prepare(spark), sf, "documents"), 4, 30, 2000, 80)


@query("op12_pareto_mix")
def mixed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return pareto_mix.mixed(table(prepare(spark), sf, "documents"), (5, 2, 1), 150, 2)


@query("op13_whitening")
def whitened_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """First four whitened components of every vector."""
    return whitening.whitened(table(prepare(spark), sf, "embeddings"), 4, 256)
