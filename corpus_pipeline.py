"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns is
written as Parquet and read back as the next one's ``docs``. All but the last keep the
columns of ``documents``. The last returns a row for each copy taken, with the shard it
goes to and the number of the copy.

Null texts fail the quality rules, so no later stage meets one. An empty table passes
through as an empty corpus. Extra columns are kept by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalog.llm import decontaminate, line_dedup, mixing, near, quality_rules
from annalog.llm.durable import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are probably bad go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand in an earlier document are deleted; a document left without words goes."""
    return line_dedup.drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents alike by 0.8 or more in five-word shingles the one with the least id stays."""
    return near.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights and dealt to shards."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing", mix),
]

#: SQL has no like for expectation-maximisation or the splitting tree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
