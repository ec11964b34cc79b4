"""From raw documents to a training mix: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all
but the last return the columns of documents, and the last returns the blocks of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import clean_of
from tessera.llm.line_dedup import drop_emptied, line_dedup
from tessera.llm.mixing import mixed_texts
from tessera.llm.near_dedup import one_of_each
from tessera.llm.quality import MIN_WORDS, keep_good
from tessera.llm.scratch import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go from the later; a document that this leaves shorter than the rules allow goes."""
    return drop_emptied(line_dedup(docs), least=MIN_WORDS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the mix: shard, slot, source, doc_ids, n_words, text."""
    return mixed_texts(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", leaks), ("mixing", mixture)]
#: Alignment, sketches and seeded draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
