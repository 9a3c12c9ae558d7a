"""Shared building blocks: null handling, wide/long reshaping, contracts and durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table broke a declared contract; the message lists check, count and example."""


# --- nulls ---------------------------------------------------------------------------------------


def finite(column: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    value = column.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def nullify_non_finite(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities of every float column into null, so that one kind of missing remains."""
    floats = [f for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({f.name: finite(F.col(f.name)).cast(f.dataType) for f in floats})


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN for float columns."""
    missing = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(column)
    return missing


# --- reshaping -----------------------------------------------------------------------------------


def to_long(
    df: DataFrame,
    targets: Sequence[str],
    fields: Mapping[str, str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (row, target); ``fields`` maps a new name to a pattern such as ``{target}__gold``.

    The fan-out is the number of configured targets and happens inside the task: no shuffle.
    """
    wanted = [pattern.format(target=t) for pattern in fields.values() for t in targets]
    require_columns(df, [*keep, *wanted])
    cells = [
        F.struct(
            F.lit(target).alias("target"),
            *[
                F.col(f"`{pattern.format(target=target)}`").cast("double").alias(name)
                for name, pattern in fields.items()
            ],
        )
        for target in targets
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def to_wide(
    long: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, str],
    targets: Sequence[str],
) -> DataFrame:
    """Inverse of ``to_long``: one row per key, columns named by the patterns in ``fields``."""
    cells = [
        F.max(F.when(F.col("target") == target, F.col(name))).alias(pattern.format(target=target))
        for target in targets
        for name, pattern in fields.items()
    ]
    return long.groupBy(*keys).agg(*cells)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed exactly once per row.

    The optimizer copies a column's expression into every later filter and single use, which repeats
    long text expressions without bound. As the output of a generator it is left alone.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.array(value)).alias(name))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small configured dimension as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of all keys where null equals null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


# --- contracts -----------------------------------------------------------------------------------


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise when a column is absent; needs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError("missing columns: " + ", ".join(missing))


def check_rows(df: DataFrame, checks: Mapping[str, Column], example: str | Column) -> DataFrame:
    """Evaluate row predicates in one pass; each ``checks`` value is true for a bad row.

    Returns ``check, violations, example`` with the smallest offending example.
    """
    sample = (F.col(example) if isinstance(example, str) else example).cast("string")
    aggregates = []
    for name, bad in checks.items():
        aggregates.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n::{name}"))
        aggregates.append(F.min(F.when(bad, sample)).alias(f"x::{name}"))
    cells = [
        F.struct(
            F.lit(name).alias("check"),
            F.col(f"`n::{name}`").alias("violations"),
            F.col(f"`x::{name}`").alias("example"),
        )
        for name in checks
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "unique") -> DataFrame:
    """Count rows that share a key with another row; null keys compare equal."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"),
        F.min(F.concat_ws("/", *[F.col(k).cast("string") for k in keys])).alias("example"),
    ).select(F.lit(name).alias("check"), "violations", "example")


def enforce(violations: DataFrame) -> None:
    """Fail closed: raise when any row of a ``check, violations, example`` table is not zero."""
    broken = violations.where("violations > 0").take(20)
    if broken:
        raise ContractError("; ".join(f"{r.check}: {r.violations} (e.g. {r.example})" for r in broken))


def guarded(value: Column, valid: Column, message: str) -> Column:
    """The value, or a failed job when ``valid`` does not hold; no extra pass over the data."""
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)))


# --- durable intermediates -----------------------------------------------------------------------


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local sessions without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
    created = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(created)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and continue from that table.

    Used where a later step must see exactly the same rows or partition numbers again, or where an
    iterative job would recompute its input; losing executors afterwards costs nothing.
    """
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
