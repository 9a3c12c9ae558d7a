"""Series attributes: category, selection score, and index plans for sampling slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLANES = ("Sagittal", "Coronal", "Axial")


def is_set(flag: Column) -> Column:
    """True for the number 1 and for the text ``1``; false for null."""
    return F.coalesce(
        (F.typeof(flag) == "string") & (flag.cast("string") == "1")
        | (F.typeof(flag) != "string") & (flag.try_cast("double") == 1.0),
        F.lit(False),
    )


def plane_name(plane: Column) -> Column:
    """Title-cased plane; null and empty become Unknown."""
    return F.initcap(F.coalesce(F.nullif(plane, F.lit("")), F.lit("Unknown")))


def categorize(plane: Column, fluid: Column, fat: Column) -> Column:
    """``plane_contrast_suppression`` with unknown planes folded together."""
    name = F.trim(plane_name(plane))
    known = F.when(name.isin(*PLANES), F.lower(name)).otherwise("unknown")
    return F.concat_ws(
        "_",
        known,
        F.when(is_set(fluid), "fluid").otherwise("nonfluid"),
        F.when(is_set(fat), "fs").otherwise("nonfs"),
    )


def score_series(
    plane: Column,
    fluid: Column,
    fat: Column,
    slice_count: Column,
    orderable: Column,
    preferred: Sequence[str] = PLANES,
) -> Column:
    """Selection score and the reasons for it, as a struct.

    A known plane is always one of the preferred ones here, so it always earns the plane bonus.
    """
    count = F.coalesce(slice_count.cast("bigint"), F.lit(0))
    rules = [
        (plane_name(plane).isin(*preferred), 3.0, "preferred_plane"),
        (is_set(fluid), 2.0, "fluid_sensitive"),
        (is_set(fat), 1.0, "fat_suppression"),
        (count.between(12, 96), 1.0, "typical_slice_count"),
        (count < 3, -5.0, "too_few_slices"),
        (F.coalesce(orderable, F.lit(False)), 1.0, "geometry_orderable"),
    ]
    total = F.lit(0.0)
    for applies, points, _ in rules:
        total = total + F.when(applies, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(applies, name) for applies, _, name in rules]))
    return F.struct(total.alias("score"), reasons.alias("reasons"))


def uniform_indices(length: Column, count: int) -> Column:
    """``count`` evenly spread indices in ``[0, length)``, halves rounded to even, ends included."""
    if count < 1:
        raise ValueError("count must be positive")
    if count == 1:
        return F.array(F.lit(0).cast("bigint"))
    step = (length - 1) / F.lit(float(count - 1))
    inner = F.transform(
        F.sequence(F.lit(0), F.lit(count - 2)), lambda i: F.rint(i * step).cast("bigint")
    )
    return F.concat(inner, F.array((length - 1).cast("bigint")))


def stratified_random_indices(length: Column, count: int, key: Column, seed: int) -> Column:
    """One index per equal-width bin; the draw is a hash of key, bin and seed, so it never changes."""
    if count < 1:
        raise ValueError("count must be positive")
    width = length / F.lit(float(count))

    def draw(i: Column) -> Column:
        start = F.least(F.floor(i * width), length - 1)
        stop = F.least(F.greatest(F.ceil((i + 1) * width), start + 1), length)
        return start + F.pmod(F.xxhash64(key, i, F.lit(seed)), stop - start)

    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), draw))


def neighborhood(center: Column, length: Column, offsets: Sequence[int] = (-1, 0, 1)) -> Column:
    """Indices around a center, clamped to the series."""
    return F.transform(
        F.array(*[F.lit(int(o)) for o in offsets]),
        lambda o: F.least(F.greatest(center + o, F.lit(0)), length - 1),
    )


def path_depth(path: Column) -> Column:
    """Number of components of a relative path."""
    return F.size(F.array_remove(F.array_remove(F.split(path, "/"), ""), "."))
