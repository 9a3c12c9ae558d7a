"""Checked joins and fail-closed table contracts; violations are rows until they are enforced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import (
    ContractError,
    check_rows,
    check_unique,
    enforce,
    finite,
    is_missing,
    require_columns,
)
from cohort_spark.functions.probability import is_probability


def prediction_violations(
    df: DataFrame, identifier: str, columns: Sequence[str]
) -> DataFrame:
    """Missing or repeated identifiers, and cells that are not finite probabilities."""
    require_columns(df, [identifier, *columns])
    checks = {f"{identifier} is present": is_missing(df, identifier)}
    for c in columns:
        checks[f"{c} is finite"] = finite(F.col(f"`{c}`")).isNull()
        checks[f"{c} is in [0, 1]"] = (
            finite(F.col(f"`{c}`")).isNotNull() & ~is_probability(F.col(f"`{c}`"))
        )
    return check_rows(df, checks, identifier).unionByName(
        check_unique(df, [identifier], f"{identifier} is unique")
    )


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Identifiers that only one side has, with the side."""
    l = left.select(F.col(key).alias("id")).distinct().withColumn("in_left", F.lit(True))
    r = right.select(F.col(key).alias("other")).distinct().withColumn("in_right", F.lit(True))
    both = l.join(r, F.col("id").eqNullSafe(F.col("other")), "full")
    return both.where(F.col("in_left").isNull() | F.col("in_right").isNull()).select(
        F.coalesce("id", "other").alias("id"),
        F.when(F.col("in_left").isNull(), "extra").otherwise("missing").alias("status"),
    )


def same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless both sides hold the same set of identifiers."""
    odd = id_set_difference(left, right, key).take(5)
    if odd:
        raise ContractError("identifier sets differ: " + ", ".join(f"{r.id} ({r.status})" for r in odd))


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    how: str = "left",
    cardinality: str = "1:1",
    complete: bool = False,
) -> DataFrame:
    """Join whose key cardinality is checked first, so it can never multiply rows.

    The checks read key columns only and are combined before their shuffle; the join itself is left
    to the optimizer. ``complete`` also demands a partner for every left row.
    """
    on = list(on)
    require_columns(left, on)
    require_columns(right, on)
    if cardinality not in {"1:1", "n:1", "1:n"}:
        raise ValueError(f"unknown cardinality: {cardinality}")
    if cardinality in {"1:1", "1:n"}:
        enforce(check_unique(left.select(*on), on, "left keys are unique"))
    if cardinality in {"1:1", "n:1"}:
        enforce(check_unique(right.select(*on), on, "right keys are unique"))
    if complete:
        lacking = left.select(*on).join(right.select(*on), on, "left_anti").take(5)
        if lacking:
            raise ContractError(f"rows without a partner: {[tuple(r) for r in lacking]}")
    return left.join(right, on, how)


def binary_violations(long: DataFrame) -> DataFrame:
    """Known gold values other than 0 and 1, per target."""
    gold = finite(F.col("gold"))
    return (
        long.where(gold.isNotNull() & ~gold.isin(0.0, 1.0))
        .groupBy("target")
        .agg(F.count("*").alias("violations"))
    )


def fold_leaks(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that occur in more than one fold; folds of a group are combined before the shuffle."""
    return (
        df.where(F.col(fold).isNotNull())
        .groupBy(group)
        .agg(F.min(fold).alias("first_fold"), F.max(fold).alias("last_fold"))
        .where("first_fold <> last_fold")
    )


def assert_group_disjoint(df: DataFrame, group: str, fold: str = "fold") -> None:
    """Raise when a group spans folds, with up to five examples."""
    leaks = fold_leaks(df, group, fold).take(5)
    if leaks:
        raise ContractError("groups span validation folds: " + ", ".join(str(r[0]) for r in leaks))


def split_overlap(df: DataFrame, key: str, validation_fold: int, fold: str = "fold") -> DataFrame:
    """Identifiers found on both sides of one train/validation split; nulls are ignored.

    One aggregation by key instead of joining the two sides.
    """
    held = F.col(fold) == validation_fold
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(held).alias("_held"), F.min(held).alias("_all"))
        .where("_held AND NOT _all")
        .select(key)
    )


def assert_train_valid_disjoint(
    df: DataFrame, *, validation_fold: int, keys: Sequence[str], fold: str = "fold"
) -> None:
    """Raise when any of the keys occurs on both sides of the split."""
    for key in keys:
        shared = split_overlap(df, key, validation_fold, fold).take(5)
        if shared:
            raise ContractError(f"training and validation share {key}: {[r[0] for r in shared]}")


def completeness_gate(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs with their declared and found parts and whether they may be used.

    Usable: marked complete, and as many parts found as declared, and more than none.
    """
    require_columns(manifest, ["run", "declared_parts", "complete"])
    found = parts.groupBy(F.col("run").alias("_run")).agg(F.count_distinct("part").alias("found_parts"))
    joined = manifest.join(found, F.col("run").eqNullSafe(F.col("_run")), "left").drop("_run")
    counted = joined.withColumn("found_parts", F.coalesce("found_parts", F.lit(0)))
    usable = (
        F.coalesce(F.col("complete"), F.lit(False))
        & (F.col("found_parts") == F.col("declared_parts"))
        & (F.col("declared_parts") > 0)
    )
    return counted.withColumn("usable", usable)


def single_candidate(gated: DataFrame) -> str:
    """The one usable run; none or several is an error."""
    usable = gated.where("usable").select("run").take(2)
    if len(usable) != 1:
        raise ContractError("expected exactly one complete run")
    return usable[0].run


def valid_fraction(df: DataFrame, valid: str = "valid") -> DataFrame:
    """Rows, valid rows and their share."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(valid).alias("valid_rows"),
        F.avg(F.col(valid).cast("double")).alias("valid_fraction"),
    )


def enforce_valid_fraction(df: DataFrame, minimum: float = 0.9, valid: str = "valid") -> None:
    """Raise when too few rows are valid."""
    share = valid_fraction(df, valid).first().valid_fraction
    if share is None or share < minimum:
        raise ContractError(f"valid fraction {share} is below {minimum}")


def gold_mismatch(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("StudyInstanceUID", "target"),
    tolerance: float = 1e-8,
) -> DataFrame:
    """Cells whose gold differs between two tables; null equals null."""
    keys = list(keys)
    l = left.select(*keys, finite(F.col("gold")).alias("left_gold"))
    r = right.select(*keys, finite(F.col("gold")).alias("right_gold"))
    agree = F.col("left_gold").eqNullSafe(F.col("right_gold")) | F.coalesce(
        F.abs(F.col("left_gold") - F.col("right_gold")) <= tolerance, F.lit(False)
    )
    return l.join(r, keys).where(~agree)


def unsafe_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are absolute or climb out of their root."""
    p = F.col(path)
    return df.where(is_unsafe(p))


def is_unsafe(path: Column) -> Column:
    """True when following the path could leave the root."""
    parts = F.split(path, "/")
    # Depth after every component; it may never go below zero.
    step = F.transform(
        parts, lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    )
    walk = F.aggregate(
        step,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, s: F.struct(
            (acc["depth"] + s).alias("depth"), F.least(acc["lowest"], acc["depth"] + s).alias("lowest")
        ),
    )
    return path.startswith("/") | (walk["lowest"] < 0)
