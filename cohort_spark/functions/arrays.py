"""Array expressions: fitting to a length, dot products and norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_length(values: Column, length: int, fill: Column | None = None) -> Column:
    """Crop around the center, or pad both ends, to an exact length."""
    if length < 1:
        raise ValueError("length must be positive")
    fill = F.lit(0.0) if fill is None else fill
    n = F.size(values)
    kept = F.least(n, F.lit(length))
    start = F.floor(F.greatest(n - length, F.lit(0)) / 2).cast("int")
    left = F.floor((length - kept) / 2).cast("int")
    right = length - kept - left
    return F.concat(
        F.array_repeat(fill, left), F.slice(values, start + 1, kept), F.array_repeat(fill, right)
    )


def fit_grid(rows: Column, height: int, width: int) -> Column:
    """The same in two dimensions, for an array of equally long arrays."""
    blank = F.array_repeat(F.lit(0.0), width)
    return fit_length(F.transform(rows, lambda r: fit_length(r, width)), height, blank)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equally long arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))
