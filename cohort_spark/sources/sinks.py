"""Writers: tables by suffix, ledgers, audits and ordered deliveries."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import ContractError


def write_parts(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Compressed Parquet parts; the job's committer makes each write all or nothing."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A CSV or Parquet table by suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        df.write.mode(mode).option("header", "true").csv(path)
    elif suffix in {".parquet", ".pq"}:
        df.write.mode(mode).parquet(path)
    else:
        raise ContractError(f"unsupported table suffix: {suffix}")


def write_ledger(failures: DataFrame, path: str) -> None:
    """Append failures as JSON lines."""
    failures.write.mode("append").json(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """An assembled audit (``node, body`` rows) as one JSON document; NaN and infinities are refused.

    Every row is a line. The lines are range-sorted by node and body, so the files in name order are the
    document, and neither a task nor the driver holds a node.
    """
    bad = F.col("body").rlike(r"[:,\[]\"?-?(NaN|Infinity)\"?[,\]}]")
    refused = F.raise_error(F.lit("an audit may not hold NaN or infinite numbers")).cast("string")
    rows = audit.select("node", F.when(bad, refused).otherwise(F.col("body")).alias("body")).groupBy("node", "body").agg(F.count("*").alias("n"))
    # The first row of a node stands in its opening line; all others begin with a comma.
    opening = rows.groupBy("node").agg(F.min("body").alias("first"))
    start = rows.agg(F.min("node")).scalar()
    comma = F.when(F.col("node") == start, F.lit("")).otherwise(F.lit(","))
    quoted = F.to_json(F.array("node"))
    name = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    opened = F.concat(comma, name, F.lit(": ["), F.coalesce("first", F.lit("")))
    heads = opening.select("node", F.lit(1).alias("step"), F.lit("").alias("at"), opened.alias("value"))
    is_first = F.col("body") == F.col("first")
    joined = rows.where("body IS NOT NULL").join(opening, "node").withColumn("n", F.col("n") - is_first.cast("bigint")).where("n > 0")
    repeated = F.explode(F.array_repeat(F.concat(F.lit(","), F.col("body")), F.col("n").cast("int"))).alias("value")
    others = joined.select("node", F.lit(2).alias("step"), F.col("body").alias("at"), repeated)
    ends = opening.select("node", F.lit(3).alias("step"), F.lit("").alias("at"), F.lit("]").alias("value"))
    edges = audit.sparkSession.createDataFrame([("", 0, "", "{"), ("\U0010ffff", 4, "", "}")], "node string, step int, at string, value string")
    lines = edges.unionByName(heads).unionByName(others).unionByName(ends)
    lines.orderBy("node", "step", "at").select("value").write.mode("overwrite").text(path)


def write_delivery(delivered: DataFrame, path: str, *, position: str = "position") -> None:
    """The delivery in its declared order as CSV files whose names follow that order.

    The table is range-sorted; each file is one range, so concatenating the files in name order
    gives the whole delivery and no task holds all of it. The header is the first row in that order,
    so it is written exactly once.
    """
    columns = [c for c in delivered.columns if c != position]
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    spark = delivered.sparkSession
    header = spark.range(1).select(F.lit(0).alias("_part"), F.lit(None).cast("bigint").alias("_at"), *[F.lit(c).alias(c) for c in columns])
    rows = delivered.select(F.lit(1).alias("_part"), F.col(position).cast("bigint").alias("_at"), *texts)
    ordered = header.unionByName(rows).orderBy("_part", "_at").drop("_part", "_at")
    ordered.write.mode("overwrite").option("header", "false").csv(path)


def promote(winner: DataFrame, candidates: DataFrame, path: str, *, name: str = "experiment") -> None:
    """Write the rows of the winning experiment."""
    # The leaderboard has one winner.
    candidates.join(F.broadcast(winner.select(name)), name, "left_semi").write.mode("overwrite").parquet(path)
