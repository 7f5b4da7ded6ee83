"""The corpus pipeline: stages over documents, each an operator of lumenfold.llm.

Quality rules drop what they reject; near-dedup keeps one document of each group of similar texts; decontamination drops
documents in which an item-sized window holds half of a benchmark item's words or more; the secret scan redacts the spans it
finds; mixing draws each source's documents, with their texts, to its target weight. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import discard, tidy, written
from lumenfold.llm.decontam import decontaminated
from lumenfold.llm.mixing import mixture
from lumenfold.llm.quality import filtered
from lumenfold.llm.secret_scan import redacted
from lumenfold.llm.simhash import deduplicated

#: SQL can't express SimHash components, covariance estimates or compressed sizes.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs, max_repeats=1.25, keep=("lang", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read again by the next.

    A stage's own tables go when it is written, and its input goes then too.
    """
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tidy() as keep:
            out = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if docs is not source:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
