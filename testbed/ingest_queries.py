"""Readers, typed records, ledgers, work units and streams."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.core import checkpoint_root, durable
from cohort_spark.functions.geometry import projected_coordinate
from cohort_spark.sources import headers as H
from cohort_spark.sources import records as R
from cohort_spark.sources import tables as S
from cohort_spark.sources import units as U
from cohort_spark.streaming import ingest as I
from cohort_spark.streaming.status import group_status, state_store
from testbed.image_files import image_file
from testbed.registry import query
from testbed.views import load, with_views

RECORD = T.StructType([T.StructField("k", T.LongType())])


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def scan_table(spark, sf_dir):
    table = S.read_table(spark, f"{sf_dir}/orders.parquet")
    return table.select("o_orderkey", "o_custkey", "o_orderpriority")


@query()
def file_inventory(spark, sf_dir):
    return S.file_inventory(spark, sf_dir)


@query(
    with_views(
        "tag_values",
        """SELECT event_id, AsText,
        CASE WHEN isfinite(TRY_CAST(AsInteger AS DOUBLE)) THEN CAST(trunc(TRY_CAST(AsInteger AS DOUBLE)) AS BIGINT) END AS AsInteger,
        CASE WHEN isfinite(TRY_CAST(AsFloat AS DOUBLE)) THEN TRY_CAST(AsFloat AS DOUBLE) END AS AsFloat,
        CAST(to_json(AsList) AS VARCHAR) AS AsList, round(Measured, 6) AS Measured FROM tag_values""",
    )
)
def typed_records(spark, sf_dir):
    typed = R.normalize_records(
        load(spark, sf_dir, "tag_values"),
        {"AsText": "text", "AsInteger": "integer", "AsFloat": "float", "AsList": "text", "Measured": "float"},
    )
    return typed.withColumn("Measured", F.round("Measured", 6))


GOOD_SQL = with_views(
    "raw_records",
    """SELECT path, CAST(regexp_extract(body, ':\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM raw_records WHERE body LIKE '%}'""",
)
FAILED_SQL = with_views(
    "raw_records",
    """SELECT path, 'MalformedRecord' AS error_type, 'malformed record: ' || body AS error FROM raw_records WHERE body NOT LIKE '%}'""",
)


@query(GOOD_SQL)
def ingest_good(spark, sf_dir):
    return R.good_records(R.parse_json(load(spark, sf_dir, "raw_records"), "body", RECORD))


@query(FAILED_SQL)
def ingest_failures(spark, sf_dir):
    return R.failed_records(R.parse_json(load(spark, sf_dir, "raw_records"), "body", RECORD))


@query(
    with_views(
        "raw_records",
        """SELECT count(*) AS discovered, count(*) FILTER (WHERE body LIKE '%}') AS readable,
        count(*) FILTER (WHERE body NOT LIKE '%}') AS failed FROM raw_records""",
    )
)
def ingest_counts(spark, sf_dir):
    return R.ingest_counts(R.parse_json(load(spark, sf_dir, "raw_records"), "body", RECORD))


@query(
    with_views(
        "requested completed",
        "SELECT DISTINCT unit FROM requested WHERE unit NOT IN (SELECT unit FROM completed)",
    )
)
def pending_units(spark, sf_dir):
    return U.pending_units(load(spark, sf_dir, "requested"), load(spark, sf_dir, "completed"))


@query(
    with_views(
        "requested completed",
        """SELECT DISTINCT unit, 'MissingUnit' AS error_type, 'no files for unit ' || unit AS error
        FROM requested WHERE unit NOT IN (SELECT unit FROM completed)""",
    )
)
def missing_units(spark, sf_dir):
    return U.missing_units(load(spark, sf_dir, "requested"), load(spark, sf_dir, "completed"))


@query(with_views("requested", "SELECT DISTINCT unit FROM requested ORDER BY unit LIMIT 10"))
def sample_units(spark, sf_dir):
    return U.sample_units(load(spark, sf_dir, "requested"), 10)


@query(
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"""
)
def union_parts(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    customer = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return S.union_parts([supplier, customer])


def event_stream(spark, sf_dir):
    """The event table as a stream of raw records."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )
    body = F.when(F.col("event_type") == "error", F.replace("props", F.lit("}"), F.lit(""))).otherwise(
        F.col("props")
    )
    path = F.concat(
        F.lit("events/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".json")
    )
    return events.select(path.alias("path"), body.alias("body"), "event_id", "ts")


@query(GOOD_SQL)
def stream_ingest(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    running = I.ingest_stream(
        event_stream(spark, sf_dir).select("path", "body"),
        body="body",
        schema=RECORD,
        output=f"{root}/good",
        ledger=f"{root}/failed",
        manifest=f"{root}/manifest",
        checkpoint=f"{root}/checkpoint",
    )
    running.awaitTermination()
    return spark.read.parquet(f"{root}/good").drop("batch")


@query(
    with_views(
        "raw_records",
        "SELECT CASE WHEN body LIKE '%}' THEN 'readable' ELSE 'failed' END AS outcome, count(*) AS n FROM raw_records GROUP BY 1",
    )
)
def stream_totals(spark, sf_dir):
    totals = I.stream_totals(event_stream(spark, sf_dir), body="body", schema=RECORD)
    # The totals are one row per outcome.
    name = f"totals_{uuid.uuid4().hex}"
    running = (
        totals.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", f"{checkpoint_root(spark)}/{name}")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.table(name)


@query("SELECT event_id, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/dedup-{uuid.uuid4().hex}"
    timed = event_stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    running = (
        I.stream_dedup(timed, "event_id", event_time="ts")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    kept = spark.read.parquet(f"{root}/out")
    return kept.groupBy("event_id").agg(F.count("*").alias("n"))


ORDER_LINES = """SELECT l_orderkey, l_linenumber, o_orderdate, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS declared
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(
    f"""WITH lines AS (SELECT *, o_orderdate + l_linenumber * INTERVAL 1 DAY AS seen FROM ({ORDER_LINES})),
    per AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS found, max(declared) AS expected, max(seen) AS newest FROM lines GROUP BY 1)
    SELECT l_orderkey, CASE WHEN found >= expected THEN 'complete' ELSE 'incomplete' END AS status, found, CAST(expected AS BIGINT) AS expected
    FROM per WHERE found >= expected OR newest + INTERVAL 30 DAY <= (SELECT max(seen) FROM lines) - INTERVAL 12 HOUR"""
)
def stream_series_status(spark, sf_dir):
    """Lines arrive in three runs of one stream, a line's number of days after its order."""
    root = f"{checkpoint_root(spark)}/status-{uuid.uuid4().hex}"
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    declared = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    at = F.timestamp_add("DAY", F.col("l_linenumber"), F.col("o_orderdate").cast("timestamp"))
    rows = durable(joined.select("l_orderkey", "l_linenumber", declared.alias("declared"), at.alias("at")))
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    edges = [first + (last - first) * k / 3 for k in range(1, 3)]
    run_of = sum((F.col("at") > F.lit(e)).cast("int") for e in edges)
    with state_store(spark):
        for number in range(3):
            # The runs follow event time, so no row is older than the watermark it meets.
            rows.where(run_of == number).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            found = group_status(
                stream,
                group=["l_orderkey"],
                member="l_linenumber",
                expected="declared",
                event_time="at",
                late="12 hours",
                wait=timedelta(days=30),
                keep=timedelta(days=60),
            )
            running = (
                found.writeStream.format("parquet")
                .option("path", f"{root}/out")
                .option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            running.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("l_orderkey", "status", "found", "expected")


@query(
    """SELECT s_suppkey AS file, CASE WHEN s_suppkey % 10 IN (3, 7) THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS number,
    CASE WHEN s_suppkey % 10 IN (3, 7) THEN NULL ELSE CAST(s_suppkey * 0.5 AS DOUBLE) END AS coordinate, s_suppkey % 10 NOT IN (3, 7) AS readable FROM supplier"""
)
def ordering_headers(spark, sf_dir):
    """One image file per supplier, some broken and some empty, read back by their leading bytes.

    What stands before the tags repeats in length, up to more than the first bytes read, so that the
    files grow in number only.
    """
    root = f"{checkpoint_root(spark)}/images-{uuid.uuid4().hex}"
    uri = root if "://" in root else f"file://{root.removeprefix('file:')}"

    def save(rows):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        for r in rows:
            body = image_file(r.s_nationkey, [0.0, 0.0, r.s_suppkey * 0.5], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], padding=r.s_suppkey % 200 * 100)
            body = {3: body[:150], 7: b""}.get(r.s_suppkey % 10, body)
            with system.open_output_stream(f"{folder}/{r.s_suppkey}.dcm") as out:
                out.write(body)

    load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").foreachPartition(save)
    headers = H.read_ordering_headers(spark, uri)
    coordinate = projected_coordinate(F.col("ImageOrientationPatient"), F.col("ImagePositionPatient"))
    return headers.select(
        F.regexp_extract("path", r"(\d+)\.dcm$", 1).cast("bigint").alias("file"),
        F.col("InstanceNumber").alias("number"),
        coordinate.alias("coordinate"),
        F.col("error_type").isNull().alias("readable"),
    )
