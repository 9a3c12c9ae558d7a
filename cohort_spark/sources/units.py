"""Bookkeeping of work units: pending, missing and sampled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import strip


def _clean(df: DataFrame, unit: str) -> DataFrame:
    return df.select(strip(F.col(unit).cast("string")).alias(unit)).where(
        F.col(unit).isNotNull() & (F.col(unit) != "")
    )


def pending_units(requested: DataFrame, completed: DataFrame, unit: str = "unit") -> DataFrame:
    """Distinct, non-blank requested units that are not completed."""
    done = completed.select(F.col(unit).cast("string").alias(unit))
    return _clean(requested, unit).distinct().join(done, unit, "left_anti")


def missing_units(requested: DataFrame, inventory: DataFrame, unit: str = "unit") -> DataFrame:
    """Ledger rows for requested units that have no files."""
    return pending_units(requested, inventory, unit).select(
        unit,
        F.lit("MissingUnit").alias("error_type"),
        F.concat(F.lit("no files for unit "), F.col(unit)).alias("error"),
    )


def sample_units(df: DataFrame, n: int, unit: str = "unit") -> DataFrame:
    """The first ``n`` distinct units in order, for a smoke run of 1 to 20 units."""
    if not 1 <= n <= 20:
        raise ValueError("a smoke run takes 1 to 20 units")
    return _clean(df, unit).distinct().orderBy(unit).limit(n)
