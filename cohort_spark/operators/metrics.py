"""Evaluation over long prediction tables: AUC, Brier, ranks, ranked errors, bootstrap.

The long form is one row per (row, target) with ``target``, ``gold`` (null when unknown) and
``score``, and any key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.core import durable, finite, guarded, require_columns
from cohort_spark.functions.probability import checked_probability, cross_entropy
from cohort_spark.operators.vector_auc import resampled_aucs
from cohort_spark.skew import exact_quantiles, running_totals


def binary(gold: Column) -> Column:
    """Gold that is 0, 1 or unknown; another value fails the job."""
    return guarded(gold, gold.isNull() | gold.isin(0, 1), "gold must be 0 or 1")


def score_counts(
    long: DataFrame,
    keys: Sequence[str] = (),
    *,
    weight: Column | None = None,
    check: bool = True,
) -> DataFrame:
    """Positives and negatives per (keys, target, score).

    Everything AUC needs, and no more rows than distinct scores of known cells: cells without gold
    fall into one row per target. Combined before the shuffle.
    """
    require_columns(long, [*keys, "target", "gold", "score"])
    gold = binary(finite(F.col("gold")))
    score = checked_probability(F.col("score")) if check else finite(F.col("score"))
    w = F.lit(1) if weight is None else weight
    # -0.0 and 0.0 are one score.
    known_score = F.when(gold.isNotNull(), score + F.lit(0.0))
    return (
        long.select(*keys, "target", known_score.alias("score"), gold.alias("gold"), w.alias("_w"))
        .groupBy(*keys, "target", "score")
        .agg(
            F.coalesce(F.sum(F.when(F.col("gold") == 1, F.col("_w"))), F.lit(0)).alias("positives"),
            F.coalesce(F.sum(F.when(F.col("gold") == 0, F.col("_w"))), F.lit(0)).alias("negatives"),
            F.coalesce(F.sum(F.when(F.col("gold").isNotNull(), F.col("_w"))), F.lit(0)).alias("known"),
        )
    )


def auc_of_counts(
    counts: DataFrame, keys: Sequence[str] = (), *, rows_per_task: int | None = None
) -> DataFrame:
    """Tie-aware ROC AUC per (keys, target) from ``score_counts``; null when a class is absent.

    The counts are stored: measuring the largest group must not repeat the pass that made them.
    """
    group = [*keys, "target"]
    below = running_totals(
        durable(counts),
        group,
        [F.col("score").asc_nulls_first()],
        {"_below": F.col("negatives")},
        rows_per_task=rows_per_task,
    )
    area = F.sum(F.col("positives") * (F.col("_below") + F.col("negatives") / 2.0))
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return below.groupBy(*group).agg(
        F.sum("known").alias("known"),
        F.sum("positives").alias("positives"),
        F.sum("negatives").alias("negatives"),
        F.when(pairs > 0, area / pairs).alias("auc"),
    )


def auc(
    long: DataFrame,
    keys: Sequence[str] = (),
    *,
    check: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    """ROC AUC per (keys, target) over cells with gold."""
    return auc_of_counts(score_counts(long, keys, check=check), keys, rows_per_task=rows_per_task)


def macro(aucs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the defined AUCs, with how many there are."""
    return aucs.groupBy(*keys).agg(
        F.avg("auc").alias("macro_auc"),
        F.count("auc").alias("valid_target_count"),
        F.count("*").alias("target_count"),
    )


def subgroup_auc(long: DataFrame, subgroup: str) -> DataFrame:
    """AUC per subgroup; rows without a subgroup form one of their own."""
    return auc(long, [subgroup])


def brier(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of known cells per (keys, target)."""
    gold = binary(finite(F.col("gold")))
    error = F.pow(gold - F.col("score"), 2)
    return long.groupBy(*keys, "target").agg(
        F.count(gold).alias("known"), F.avg(error).alias("brier")
    )


def oof_metrics(long: DataFrame) -> DataFrame:
    """AUC and Brier per target side by side."""
    scores = brier(long).select("target", "brier")
    return auc(long).join(scores, "target")


def fold_counts(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows per fold."""
    return df.groupBy(fold).agg(F.count("*").alias("n"))


def weighted_log_loss(
    long: DataFrame,
    *,
    gold_weight: float = 4.0,
    target_weights: dict[str, float] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Soft cross entropy with heavier gold cells; needs ``logit``, ``value`` and ``is_gold``."""
    require_columns(long, [*keys, "target", "logit", "value", "is_gold"])
    weight = F.when(F.col("is_gold"), gold_weight).otherwise(1.0)
    if target_weights is not None:
        scale = F.lit(None).cast("double")
        for name, value in target_weights.items():
            scale = F.when(F.col("target") == name, float(value)).otherwise(scale)
        weight = weight * scale
    value = checked_probability(F.col("value"), "target value")
    staged = long.select(
        *keys, weight.alias("_w"), cross_entropy(F.col("logit"), value).alias("_loss")
    )
    return staged.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("_loss")) / F.greatest(F.sum("_w"), F.lit(1.0))).alias("loss")
    )


def ranked_errors(
    long: DataFrame,
    *,
    k: int = 3,
    identifier: str = "StudyInstanceUID",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The k highest-scored negatives and the k lowest-scored positives of every target.

    A top-k filter that Spark applies before and after the shuffle; ties end on the identifier.
    """
    if k < 1:
        raise ValueError("k must be positive")
    known = long.where(F.col("gold").isin(0.0, 1.0)).withColumn(
        "score", checked_probability(F.col("score"))
    )
    worst = F.when(F.col("gold") == 0, -F.col("score")).otherwise(F.col("score"))
    place = Window.partitionBy("target", "gold").orderBy(worst, F.col(identifier))
    kind = F.when(F.col("gold") == 0, "highest_ranked_negative").otherwise("lowest_ranked_positive")
    return (
        known.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("target", kind.alias("kind"), "rank", identifier, *keep, "score")
    )


def percentile_ranks(
    scores: DataFrame,
    keys: Sequence[str] = ("target",),
    *,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Average rank of every score within its group, divided by the group's rows.

    Ranks are found on distinct scores and joined back, so a group is never ordered row by row.
    """
    keys = list(keys)
    # -0.0 and 0.0 are one score; a score that cannot be ranked fails the job.
    rankable = F.coalesce(finite(F.col("score")).isNotNull(), F.lit(False))
    score = guarded(F.col("score"), rankable, "ranks need finite scores") + F.lit(0.0)
    counted = durable(scores.groupBy(*keys, score.alias("score")).agg(F.count("*").alias("_c")))
    below = running_totals(
        counted, keys, [F.col("score")], {"_below": F.col("_c")}, rows_per_task=rows_per_task
    )
    size = counted.groupBy(*keys).agg(F.sum("_c").alias("_n")).withColumnsRenamed(
        {k: f"_of_{k}" for k in keys}
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    ranks = below.join(size, same).select(
        *keys, "score", ((F.col("_below") + (F.col("_c") + 1) / 2.0) / F.col("_n")).alias("rank")
    )
    return scores.withColumn("score", score).join(ranks, [*keys, "score"])


def bootstrap_auc(
    long: DataFrame,
    *,
    identifier: str = "StudyInstanceUID",
    iterations: int = 1000,
    seed: int = 20260812,
) -> DataFrame:
    """95 % interval of the macro AUC over resampled studies.

    A resample gives every study a Poisson(1) weight from a digest of study, replicate and seed: the
    same draw for all targets of a study and the same result on every run and engine. The known cells
    are shuffled once; the replicates are vectors that are added up along the order of the scores.
    """
    if iterations < 1:
        raise ValueError("iterations must be positive")
    gold = binary(finite(F.col("gold")))
    score = checked_probability(F.col("score"))
    known = long.select(F.col(identifier).alias("identifier"), "target", gold.alias("gold"), score.alias("score")).where("gold IS NOT NULL")
    resampled = macro(resampled_aucs(known, replicates=iterations, seed=seed), ["replicate"])
    interval = resampled.agg(
        F.percentile("macro_auc", 0.025).alias("lower_95"),
        F.percentile("macro_auc", 0.975).alias("upper_95"),
        F.count("macro_auc").alias("valid_bootstraps"),
        F.lit(iterations).alias("requested_bootstraps"),
    )
    point = macro(auc(long)).select("macro_auc")
    return interval.select(point.scalar().alias("point_estimate"), "*")


def score_quantiles(long: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles of the scores per group."""
    return exact_quantiles(long, keys, "score", probabilities)


def leaderboard(experiments: DataFrame, *, score: str = "macro_auc", name: str = "experiment") -> DataFrame:
    """The best experiment; equal scores go to the largest name."""
    return experiments.orderBy(F.col(score).desc_nulls_last(), F.col(name).desc()).limit(1)
