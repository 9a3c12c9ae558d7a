"""Ordered work inside groups of any size.

A window or a list per group puts each group on one task. That is the cheapest plan while groups
are small, and it breaks when one group holds a third of the table. The helpers here measure the
largest group first (one pass over the key columns, combined before the shuffle) and switch to a
plan that cuts a group into ordered slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.core import durable

# Rows of one group that a single task may order. Beyond it the group is sliced.
GROUP_ROWS_PER_TASK = 2_000_000
# Buckets of keys that stand for the groups when their sizes are bounded.
BUCKETS = 1 << 16


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group, null keys kept."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    return group_sizes(df, keys).agg(F.max("n")).first()[0] or 0


def groups_within(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Whether no group has more than ``limit`` rows; one number reaches the driver.

    Rows are counted per bucket of the hashed keys first. The buckets are few enough to be combined
    before the shuffle, and only one with more than ``limit`` rows calls for the groups themselves.
    """
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    fullest = buckets.agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return fullest <= limit or largest_group(df, keys) <= limit


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    *,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add exclusive running sums per group, in ``order``, which must be total within a group.

    Sliced plan: range-partition by keys and order, number the slices, store them, sum per slice,
    and add the sum of earlier slices of the group. Only the first group of a slice can have
    started earlier, so the offsets are at most one row per slice and safe to broadcast.
    """
    rows_per_task = rows_per_task or GROUP_ROWS_PER_TASK
    names = list(totals)
    staged = df.withColumns({f"_add_{n}": c for n, c in totals.items()})
    if largest_group(df, keys) <= rows_per_task:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        summed = {n: F.coalesce(F.sum(f"_add_{n}").over(before), F.lit(0)) for n in names}
        return staged.withColumns(summed).drop(*[f"_add_{n}" for n in names])

    slices = _slice_count(df, rows_per_task)
    sliced = durable(
        staged.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    group = Window.partitionBy(*keys).orderBy("_slice")
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in names])
        .select(
            F.col("_slice").alias("_at"),
            *[F.col(k).alias(f"_at_{k}") for k in keys],
            F.row_number().over(group).alias("_nth"),
            *[
                F.sum(f"_sum_{n}")
                .over(group.rowsBetween(Window.unboundedPreceding, -1))
                .alias(f"_before_{n}")
                for n in names
            ],
        )
        .where("_nth > 1")
    )
    same_slice = F.col("_slice") == F.col("_at")
    for k in keys:
        same_slice = same_slice & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    joined = sliced.join(F.broadcast(offsets), same_slice, "left")
    within = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = {
        n: F.coalesce(F.sum(f"_add_{n}").over(within), F.lit(0))
        + F.coalesce(F.col(f"_before_{n}"), F.lit(0))
        for n in names
    }
    return joined.withColumns(summed).select(*df.columns, *names)


def _slice_count(df: DataFrame, rows_per_task: int) -> int:
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parallel, -(-df.count() // rows_per_task))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    *,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group; equal values are combined before ordering.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer; this form
    keeps none, whatever the size of the group.
    """
    keys = list(keys)
    counted = durable(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    )
    ranked = running_totals(
        counted, keys, [F.col(value)], {"_below": F.col("_c")}, rows_per_task=rows_per_task
    )
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    totals = totals.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    # One row per group on the right, null keys matching; a scalar without keys.
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    sized = ranked.join(totals, same) if keys else ranked.withColumn("_n", totals.scalar())
    picks = []
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("_n") - 1)
        for side, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            here = (F.col("_below") <= index) & (index < F.col("_below") + F.col("_c"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    grouped = sized.groupBy(*keys).agg(F.first("_n").alias("n"), *picks)
    return grouped.select(
        *keys,
        "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                * (F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1)))
            ).alias(name)
            for name, p in probabilities.items()
        ],
    )
