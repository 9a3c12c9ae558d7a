"""Resumable ingestion and running totals with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohort_spark.sources.records import failed_records, good_records, parse_json


def record_stream(
    spark: SparkSession, root: str, schema: T.StructType | str, *, files_per_trigger: int = 25
) -> DataFrame:
    """Parquet record files as a stream, a bounded number of files per batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(root)
    )


def ingest_stream(
    records: DataFrame,
    *,
    body: str,
    schema: T.StructType,
    output: str,
    ledger: str,
    manifest: str,
    checkpoint: str,
    keep: tuple[str, ...] = ("path",),
) -> StreamingQuery:
    """Parse every new record once: good rows, a failure ledger and one manifest row per batch.

    The checkpoint resumes after a stop. Each batch overwrites its own folder, so a batch that is
    retried after a failure leaves its rows exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_json(batch, body, schema).persist()
        try:
            good_records(parsed, keep).write.mode("overwrite").option("compression", "zstd").parquet(
                f"{output}/batch={number}"
            )
            failed_records(parsed, keep).write.mode("overwrite").json(f"{ledger}/batch={number}")
            counts = parsed.agg(
                F.count("*").alias("discovered"),
                F.count_if(F.col("error_type").isNull()).alias("readable"),
                F.count_if(F.col("error_type").isNotNull()).alias("failed"),
            )
            counts.write.mode("overwrite").parquet(f"{manifest}/batch={number}")
        finally:
            parsed.unpersist()

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_totals(records: DataFrame, *, body: str, schema: T.StructType) -> DataFrame:
    """Running totals of a record stream by outcome; state is one row per outcome."""
    parsed = parse_json(records, body, schema)
    outcome = F.when(parsed["error_type"].isNull(), "readable").otherwise("failed")
    return parsed.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def stream_dedup(records: DataFrame, key: str, *, event_time: str, late: str = "1 hour") -> DataFrame:
    """The first record of every identifier; state is dropped once it is later than ``late``."""
    return records.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
