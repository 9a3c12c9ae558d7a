"""Monotone Platt calibration of many (fold, target) models at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import durable, finite, guarded, require_columns
from cohort_spark.functions.probability import apply_platt, logit
from cohort_spark.operators.blending import fold_numbers

# Penalty, parameter box and least class size of a fit (fixed values).
PENALTY = 0.01
SLOPE_BOX = (0.05, 10.0)
INTERCEPT_BOX = (-6.0, 6.0)
MIN_CLASS = 3

MAX_PASSES = 60
FULL_FIT = -1
# A fit has settled when its next point is this near; steps are halved down to the second number.
SETTLED, LEAST_SCALE = 1e-10, 1e-9


def _measured(counts: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loss, gradient and curvature of every model at its next point: one aggregation for all models."""
    at = points.select(*[F.col(f"`{k}`").alias(f"_of_{k}") for k in keys], "next_slope", "next_intercept")
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys])
    t = F.col("next_slope") * F.col("z") + F.col("next_intercept")
    p = 1.0 / (1.0 + F.exp(-t))
    softplus = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    slack, bend = F.col("n") * p - F.col("ones"), F.col("n") * p * (1.0 - p)
    mean = lambda x: F.sum(x) / F.sum("n")
    off_slope, off_intercept = F.col("next_slope") - 1.0, F.col("next_intercept")
    return (
        counts.join(at, same)
        .groupBy(*[f"_of_{k}" for k in keys], "next_slope", "next_intercept")
        .agg(
            mean(F.col("n") * softplus - F.col("ones") * t).alias("loss"),
            mean(slack * F.col("z")).alias("g0"),
            mean(slack).alias("g1"),
            mean(bend * F.col("z") * F.col("z")).alias("h0"),
            mean(bend * F.col("z")).alias("h1"),
            mean(bend).alias("h2"),
        )
        .select(
            *[f"_of_{k}" for k in keys],
            (F.col("loss") + PENALTY * (off_slope * off_slope + off_intercept * off_intercept)).alias("new_loss"),
            (F.col("g0") + 2 * PENALTY * off_slope).alias("new_g0"),
            (F.col("g1") + 2 * PENALTY * off_intercept).alias("new_g1"),
            (F.col("h0") + 2 * PENALTY).alias("new_h0"),
            F.col("h1").alias("new_h1"),
            (F.col("h2") + 2 * PENALTY).alias("new_h2"),
        )
    )


_POINT = ("slope", "intercept", "loss", "g0", "g1", "h0", "h1", "h2")


def _proposed(state: DataFrame) -> DataFrame:
    """The next point of every model: a Newton step, parameters that press against their box held there."""
    x, g = (F.col("slope"), F.col("intercept")), (F.col("g0"), F.col("g1"))
    boxes = (SLOPE_BOX, INTERCEPT_BOX)
    free = [~(((x[i] <= low) & (g[i] > 0)) | ((x[i] >= high) & (g[i] < 0))) for i, (low, high) in enumerate(boxes)]
    h0, h1, h2 = F.col("h0"), F.col("h1"), F.col("h2")
    det = h0 * h2 - h1 * h1
    both = (h1 * g[1] - h2 * g[0]) / det, (h1 * g[0] - h0 * g[1]) / det
    alone = -g[0] / h0, -g[1] / h2
    step = [F.when(free[0] & free[1], both[i]).when(free[i], alone[i]).otherwise(0.0) for i in range(2)]
    to = [F.least(F.greatest(x[i] + F.col("scale") * step[i], F.lit(low)), F.lit(high)) for i, (low, high) in enumerate(boxes)]
    far = F.greatest(F.abs(F.col("next_slope") - x[0]), F.abs(F.col("next_intercept") - x[1])) > SETTLED
    return state.withColumns({"next_slope": to[0], "next_intercept": to[1]}).withColumn("open", F.col("going") & far)


def _advanced(state: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One pass: a model takes its next point unless that is worse, else it halves its step."""
    measured = _measured(counts, state.where("open"), keys)
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys])
    joined = state.join(measured, same, "left")
    better = F.coalesce(F.col("new_loss") <= F.col("loss") + 1e-13, F.col("loss").isNull())
    new = {"slope": "next_slope", "intercept": "next_intercept", **{c: f"new_{c}" for c in _POINT[2:]}}
    taken = {c: F.when(F.col("open") & better, F.col(new[c])).otherwise(F.col(c)).alias(c) for c in _POINT}
    scale = F.when(F.col("open"), F.when(better, 1.0).otherwise(F.col("scale") / 2)).otherwise(F.col("scale"))
    going = F.col("open") & (scale > LEAST_SCALE)
    moved = joined.select(
        *keys, "known", *taken.values(), scale.alias("scale"), going.alias("going"), "next_slope", "next_intercept"
    )
    return _proposed(moved)


def _fit_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fit every model from its (logit, n, ones) rows, however many models there are.

    All models advance together. Their points are a table that each pass joins with the combined rows
    and stores anew; the driver only learns whether any model is still moving.
    """
    counts = durable(counts)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("known"), F.least(F.sum("ones"), F.sum("zeros")).alias("thin"))
    first = {c: F.lit(None).cast("double") for c in _POINT[2:]}
    state = sizes.select(
        *keys,
        F.col("known").cast("bigint").alias("known"),
        F.lit(1.0).alias("slope"),
        F.lit(0.0).alias("intercept"),
        *[v.alias(c) for c, v in first.items()],
        F.lit(1.0).alias("scale"),
        (F.col("thin") >= MIN_CLASS).alias("going"),
        F.lit(1.0).alias("next_slope"),
        F.lit(0.0).alias("next_intercept"),
        (F.col("thin") >= MIN_CLASS).alias("open"),
    )
    state = durable(state)
    for _ in range(MAX_PASSES):
        if state.where("open").isEmpty():
            break
        state = durable(_advanced(state, counts, keys))
    thin = F.col("loss").isNull()
    status = F.when(F.col("open"), "identity_optimizer_failure").when(thin, "identity_insufficient_classes").otherwise("fitted")
    return state.select(
        *keys,
        F.when(F.col("open"), 1.0).otherwise(F.col("slope")).alias("slope"),
        F.when(F.col("open"), 0.0).otherwise(F.col("intercept")).alias("intercept"),
        status.alias("status"),
        "known",
    )


def _combined(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with gold per (keys, logit), combined before the shuffle."""
    require_columns(long, [*keys, "gold", "score"])
    gold, score = finite(F.col("gold")), finite(F.col("score"))
    return (
        long.where(gold.isNotNull() & score.isNotNull())
        .select(*keys, logit(score).alias("z"), gold.alias("gold"))
        .groupBy(*keys, "z")
        .agg(
            F.count("*").alias("n"),
            F.sum("gold").alias("ones"),
            F.sum(1.0 - F.col("gold")).alias("zeros"),
        )
    )


def fit_platt(long: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Platt parameters per key: penalised, with a positive bounded slope; identity when a class is thin."""
    return _fit_counts(_combined(long, list(keys)), list(keys))


def cross_fit(long: DataFrame, folds: Sequence[int] | None = None) -> DataFrame:
    """Parameters per (held_out, target) from the other folds, plus the fit on all rows (held_out -1)."""
    if folds is None:
        folds = fold_numbers(long)
    counts = _combined(long, ["fold", "target"])
    used_by = F.filter(
        F.array(F.lit(FULL_FIT), *[F.lit(f) for f in folds]), lambda f: f != F.col("fold")
    )
    spread = (
        counts.withColumn("held_out", F.explode(used_by))
        .groupBy("held_out", "target", "z")
        .agg(*[F.sum(c).alias(c) for c in ("n", "ones", "zeros")])
    )
    return _fit_counts(spread, ["held_out", "target"])


def apply_calibration(
    long: DataFrame, parameters: DataFrame, keys: Sequence[str] = ("target",)
) -> DataFrame:
    """Calibrated scores; a row whose key has no parameters fails the job.

    ``parameters`` has one row per target (or fold and target); the join is the optimizer's choice.
    """
    keys = list(keys)
    joined = long.join(parameters.select(*keys, "slope", "intercept"), keys, "left")
    score = apply_platt(
        F.col("score"),
        guarded(F.col("slope"), F.col("slope").isNotNull(), "calibration is missing a target"),
        F.col("intercept"),
    )
    return joined.withColumn("score", score).drop("slope", "intercept")


def cross_fit_calibration(long: DataFrame) -> DataFrame:
    """Out-of-fold calibrated scores: every row uses the parameters fitted without its fold."""
    fitted = cross_fit(long).where(F.col("held_out") != FULL_FIT)
    return apply_calibration(long, fitted.withColumnRenamed("held_out", "fold"), ["fold", "target"])


def finite_parameters(slope: float, intercept: float) -> bool:
    """Whether stored parameters can be applied."""
    return math.isfinite(slope) and math.isfinite(intercept) and slope > 0
