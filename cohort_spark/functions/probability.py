"""Expressions on probabilities: validation, logit, Platt scaling, blending and loss terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort_spark.core import guarded

# Clip of probabilities before the logit, and of exponents (fixed values).
LOGIT_CLIP = 1e-5
EXPONENT_CLIP = 30.0


def clip(value: Column, low: float, high: float) -> Column:
    """The value limited to a range; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def is_probability(value: Column) -> Column:
    """True for a finite value in [0, 1]; false for null and NaN."""
    return F.coalesce(value.between(0.0, 1.0) & ~F.isnan(value.cast("double")), F.lit(False))


def checked_probability(value: Column, name: str = "score") -> Column:
    """The value, or a failed job when it is not a finite probability."""
    value = value.cast("double")
    return guarded(value, is_probability(value), f"{name} must be a finite probability in [0, 1]")


def finite_probability(value: Column) -> Column:
    """Clip a finite value to [0, 1]; a non-finite one fails the job."""
    value = value.cast("double")
    return guarded(
        clip(value, 0.0, 1.0),
        F.coalesce(F.abs(value) < float("inf"), F.lit(False)),
        "probability must be finite",
    )


def logit(probability: Column) -> Column:
    """Log odds of a clipped probability."""
    p = clip(probability, LOGIT_CLIP, 1.0 - LOGIT_CLIP)
    return F.log(p / (1.0 - p))


def sigmoid(value: Column) -> Column:
    """Logistic function with its exponent clipped."""
    return 1.0 / (1.0 + F.exp(-clip(value, -EXPONENT_CLIP, EXPONENT_CLIP)))


def apply_platt(probability: Column, slope: Column, intercept: Column) -> Column:
    """Calibrated probability for given Platt parameters."""
    return sigmoid(slope * logit(probability) + intercept)


def sigmoid_margin(margin: Column, scale: float = 10.0) -> Column:
    """Probability of a positive-minus-negative similarity margin."""
    return sigmoid(margin * scale)


def blend(rule: Column, semantic: Column, rule_weight: float) -> Column:
    """Weighted mean of two sources."""
    if not 0.0 <= rule_weight <= 1.0:
        raise ValueError("rule_weight must be between zero and one")
    return rule_weight * rule + (1.0 - rule_weight) * semantic


def cross_entropy(logits: Column, target: Column) -> Column:
    """Binary cross entropy of a soft target, from logits, in its overflow-free form."""
    return F.greatest(logits, F.lit(0.0)) - logits * target + F.log1p(F.exp(-F.abs(logits)))
