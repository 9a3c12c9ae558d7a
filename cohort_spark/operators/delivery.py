"""Alignment of predictions to a delivery sample and the output contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, check_rows, check_unique, enforce, require_columns
from cohort_spark.functions.probability import is_probability


def deliver(
    sample: DataFrame,
    predictions: DataFrame,
    *,
    identifier: str,
    targets: Sequence[str],
    position: str = "position",
) -> DataFrame:
    """Predictions in the sample's order, as ``position, identifier, targets``.

    The order is carried as a column; only the sink sorts by it.
    """
    require_columns(sample, [identifier, position])
    require_columns(predictions, [identifier, *targets])
    enforce(check_unique(predictions.select(identifier), [identifier], "prediction ids are unique"))
    return sample.select(identifier, position).join(
        predictions.select(identifier, *targets), identifier, "left"
    ).select(position, identifier, *targets)


def delivery_violations(
    sample: DataFrame,
    delivered: DataFrame,
    *,
    identifier: str,
    targets: Sequence[str],
    position: str = "position",
) -> DataFrame:
    """Breaches of the output contract: ids, order, duplicates, missing or out-of-range cells."""
    expected = [position, identifier, *targets]
    if list(delivered.columns) != expected:
        raise ContractError(f"delivery columns must be {expected}")
    other = sample.select(
        F.col(identifier).alias("_expected"), F.col(position).alias("_at")
    )
    aligned = delivered.join(other, F.col(position) == F.col("_at"), "full")
    checks = {
        "row count and order match the sample": ~F.col("_expected").eqNullSafe(F.col(identifier)),
        **{
            f"{t} is a probability": F.col(identifier).isNotNull() & ~is_probability(F.col(f"`{t}`"))
            for t in targets
        },
    }
    return check_rows(aligned, checks, F.coalesce(identifier, "_expected")).unionByName(
        check_unique(delivered.select(identifier), [identifier], f"{identifier} is unique")
    )


def validated_delivery(sample: DataFrame, delivered: DataFrame, **options) -> DataFrame:
    """The delivery, or an error that lists the breaches."""
    enforce(delivery_violations(sample, delivered, **options))
    return delivered
