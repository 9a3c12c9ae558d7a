"""Slice geometry from orientation (6 numbers) and position (3 numbers) arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort_spark.core import finite


def _at(array: Column, index: int) -> Column:
    return F.get(array, F.lit(index))


def _shaped(array: Column, length: int) -> Column:
    return array.isNotNull() & (F.size(array) == length)


def _all_finite(array: Column) -> Column:
    return F.forall(array, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))


def _cross(orientation: Column) -> tuple[Column, Column, Column]:
    r = [_at(orientation, i) for i in range(3)]
    c = [_at(orientation, i) for i in range(3, 6)]
    return (r[1] * c[2] - r[2] * c[1], r[2] * c[0] - r[0] * c[2], r[0] * c[1] - r[1] * c[0])


def _dot(vector: tuple[Column, ...], array: Column) -> Column:
    return vector[0] * _at(array, 0) + vector[1] * _at(array, 1) + vector[2] * _at(array, 2)


def projected_coordinate(orientation: Column, position: Column) -> Column:
    """Position along the (not normalised) slice normal; null for short, missing or non-finite input."""
    usable = _shaped(orientation, 6) & _shaped(position, 3)
    return F.when(usable, finite(_dot(_cross(orientation), position)))


def unit_normal(orientation: Column) -> Column:
    """Unit slice normal as an array of three, null when the two directions are parallel."""
    x, y, z = _cross(orientation)
    norm = F.sqrt(x * x + y * y + z * z)
    usable = _shaped(orientation, 6) & _all_finite(orientation) & (norm > 1e-8)
    return F.when(usable, F.array(x / norm, y / norm, z / norm))


def unit_coordinate(orientation: Column, position: Column) -> Column:
    """Position along the unit slice normal."""
    normal = unit_normal(orientation)
    along = _dot((_at(normal, 0), _at(normal, 1), _at(normal, 2)), position)
    return F.when(
        normal.isNotNull() & _shaped(position, 3) & _all_finite(position), along
    )


def infer_plane(orientation: Column, tolerance_degrees: float = 35.0) -> Column:
    """Plane of the nearest axis; Oblique beyond the tolerance, Unknown without a normal."""
    normal = unit_normal(orientation)
    s, c, a = (F.abs(_at(normal, i)) for i in range(3))
    best = F.greatest(s, c, a)
    return (
        F.when(normal.isNull(), "Unknown")
        .when(best < math.cos(math.radians(tolerance_degrees)), "Oblique")
        .when(s == best, "Sagittal")
        .when(c == best, "Coronal")
        .otherwise("Axial")
    )


def normalize_side(value: Column) -> Column:
    """L or R for an explicit side, else null."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text.isin("L", "LEFT"), "L").when(text.isin("R", "RIGHT"), "R")


def resolve_side(tags: dict[str, Column]) -> Column:
    """One agreed side with the tags that state it; conflicts and silence stay null."""
    stated = F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("tag"), normalize_side(value).alias("side"))
                for name, value in tags.items()
            ]
        ),
        lambda s: s["side"].isNotNull(),
    )
    sides = F.array_distinct(F.transform(stated, lambda s: s["side"]))
    agreed = F.size(sides) == 1
    source = (
        F.when(agreed, F.array_join(F.transform(stated, lambda s: s["tag"]), "+"))
        .when(F.size(sides) > 1, "conflicting_tags")
        .otherwise("unavailable")
    )
    return F.struct(F.when(agreed, F.get(sides, F.lit(0))).alias("side"), source.alias("source"))
