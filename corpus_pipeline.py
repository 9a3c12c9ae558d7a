"""The corpus pipeline: raw documents in, token files out.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents (the last one the index of the token
files). ``run`` writes every stage's rows as Parquet in the shared folder and reads them again, so a
lost executor never costs more than the stage it worked on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohort_spark.core import checkpoint_root
from cohort_spark.llm import contamination, importance, mixing, similar, token_files
from cohort_spark.llm.registry import table
from cohort_spark.llm.token_query import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return importance.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its source's rate says."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; their places and checksums as read back."""
    path = tokenizer_path()
    root, parts = token_files.write_tokens(docs, path)
    return token_files.read_tokens(root, parts, path)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token files", tokens),
]

# No stage before the mix can be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last one."""
    rows = table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{root}/{number}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
