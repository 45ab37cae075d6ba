"""Clean, deduplicate, mix and pack a corpus, stage by stage.

Each stage takes what the one before kept. Odd cases are the operators' own: documents with a null or empty text are
neither toxic nor duplicates and have no lines, so they stay up to packing, where they have no words and no rows; a null
id is judged like any other but takes no part in near-duplicate groups; rows that repeat an id are documents of their own
but in line and near deduplication, where they count as one; a null source is a source of its own; ties go to the least
id; an empty table gives an empty result; further columns pass unchanged up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import line_dedup, mixing, near_dedup, packing, toxicity
from quern.llm.scratch import keep, mark, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scan rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat stay in one document only; documents that had nothing else go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True, count_col=None)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as there are, sources weighing the square roots of their numbers."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Related documents share windows."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", line_dedup_stage), ("minhash_dedup", minhash_dedup), ("mixing", mix), ("packing", pack)]

#: Scores, sketches and the graph have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = keep(stage(spark, docs, sf_dir), name)
        release(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
