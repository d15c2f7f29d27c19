"""A corpus pipeline over ``documents``: classify, dedup lines, dedup documents, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's result to the
shared folder and reads it again, so a stage never recomputes those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralith.llm import lines, mixing, packing, perplexity, simhash
from terralith.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity exceeds their language's limit go (operator 9)."""
    return perplexity.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; emptied documents stay, empty (operator 2)."""
    return lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 6)."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the sources have their shares (operator 3)."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence (operator 7)."""
    return packing.packed_documents(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Fingerprints, language-model scores and tokens have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
