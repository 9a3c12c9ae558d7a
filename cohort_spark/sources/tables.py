"""Readers: tables by suffix, parts, file inventories, metric files and fingerprints."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohort_spark.core import ContractError


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, *, line_breaks: bool = False
) -> DataFrame:
    """A table by its suffix: csv, parquet, pq, json or jsonl; anything else is an error.

    ``line_breaks`` reads CSV fields that hold line breaks; a file is then one task, so convert large
    ones to Parquet once.
    """
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=line_breaks, escape='"')
    if suffix in {".parquet", ".pq"}:
        return reader.parquet(path)
    if suffix == ".jsonl":
        return reader.json(path)
    if suffix == ".json":
        return reader.json(path, multiLine=True)
    raise ContractError(f"unsupported table suffix: {suffix}")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out when it has fewer partitions than the session has cores.

    For costly per-row work on files of few, large row groups. A scan with enough partitions is
    returned as it is, without a shuffle. Counting partitions plans the scan and runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 4)


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    """All ``part-*.parquet`` files of an extraction as one table; missing columns become null."""
    try:
        return (
            spark.read.option("pathGlobFilter", "part-*.parquet")
            .option("mergeSchema", "true")
            .parquet(root)
        )
    except AnalysisException as error:
        if error.getCondition() not in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            raise
        raise ContractError(f"no parquet parts under {root}") from error


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Tables with different columns as one."""
    if not parts:
        raise ContractError("no parts to union")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file under a root: relative path and size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    resolved = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base)
    prefix = resolved.toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return files.select(
        F.substring_index(plain, prefix, -1).alias("path"), F.col("length").alias("file_size_bytes")
    )


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file; meant for artifacts, each of which fits in a task.

    Spark's readers pass over files without bytes, so those have no row.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def read_metric_files(spark: SparkSession, pattern: str, score: str = "macro_auc") -> DataFrame:
    """One JSON document per experiment; the experiment is named by its folder."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return spark.read.json(pattern, multiLine=True).select(
        name.alias("experiment"), F.col(score).cast("double").alias(score)
    )
