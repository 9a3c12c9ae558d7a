"""Ensembles over stacked predictions: one row per (model, row, target)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, guarded, require_columns
from cohort_spark.functions.probability import checked_probability
from cohort_spark.operators.metrics import auc, macro, percentile_ranks


def stack_models(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Prediction tables of equal schema as one table with a ``model`` column."""
    stacked = None
    columns = None
    for name, df in tables.items():
        if columns is not None and set(df.columns) != columns:
            raise ContractError(f"prediction schemas differ: {name}")
        columns = set(df.columns)
        tagged = df.withColumn("model", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    if stacked is None:
        raise ValueError("at least one prediction table is required")
    return stacked


def _normalised(models: Sequence[str], weights: Mapping[str, float] | None) -> list[float]:
    """One weight per model, summing to one."""
    values = [1.0 if weights is None else float(weights[m]) for m in models]
    if not models or len(set(models)) != len(models):
        raise ValueError("models must be named once each")
    if weights is not None and set(weights) != set(models):
        raise ValueError("one weight per model is required")
    if any(not (0 <= w < float("inf")) for w in values) or sum(values) <= 0:
        raise ValueError("ensemble weights must be non-negative with a positive sum")
    return [w / sum(values) for w in values]


def ensemble_mean(
    stacked: DataFrame,
    *,
    models: Sequence[str],
    weights: Mapping[str, float] | None = None,
    keys: Sequence[str] = ("StudyInstanceUID", "target"),
) -> DataFrame:
    """Weighted mean per row and target; a row without exactly one score of each model fails the job.

    All models are brought together in one aggregation instead of a chain of joins, and added in the
    order given, so equal inputs give equal sums whatever the order of rows.
    """
    require_columns(stacked, ["model", "score", *keys])
    shares = _normalised(models, weights)
    score = checked_probability(F.col("score"))
    staged = stacked.select(*keys, "model", score.alias("score"))
    wide = staged.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"_{i}") for i, m in enumerate(models)],
    )
    total, complete = F.lit(0.0), F.col("_rows") == len(models)
    for i, share in enumerate(shares):
        total = total + F.col(f"_{i}") * share
        complete = complete & F.col(f"_{i}").isNotNull()
    return wide.select(
        *keys,
        guarded(total, complete, "every row needs exactly one score of each model").alias("score"),
    )


def ensemble_rank(
    stacked: DataFrame,
    *,
    models: Sequence[str],
    weights: Mapping[str, float] | None = None,
    keys: Sequence[str] = ("StudyInstanceUID", "target"),
) -> DataFrame:
    """Weighted mean of the percentile ranks within each model and target."""
    ranked = percentile_ranks(stacked, ["model", "target"])
    return ensemble_mean(
        ranked.drop("score").withColumnRenamed("rank", "score"),
        models=models,
        weights=weights,
        keys=keys,
    )


def ensemble_compare(
    stacked: DataFrame,
    gold: DataFrame,
    *,
    models: Sequence[str],
    weights: Mapping[str, float] | None = None,
    keys: Sequence[str] = ("StudyInstanceUID", "target"),
) -> DataFrame:
    """Macro AUC of both ensemble methods against the same gold."""
    options = {"models": models, "weights": weights, "keys": keys}
    both = (
        ensemble_mean(stacked, **options)
        .withColumn("method", F.lit("probability"))
        .unionByName(ensemble_rank(stacked, **options).withColumn("method", F.lit("rank")))
    )
    scored = both.join(gold.select(*keys, "gold"), list(keys))
    return macro(auc(scored, ["method"]), ["method"])
