"""Ordering children inside groups, series manifests, inventories, selection and sampling plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.core import check_unique, durable, enforce, finite, require_columns
from cohort_spark.functions import series as S
from cohort_spark.skew import group_sizes, groups_within, running_totals

KEYS = ("StudyInstanceUID", "SeriesInstanceUID")

# Attributes carried from the headers to the series (fixed values).
SUMMARY_COLUMNS = (
    "PatientID",
    "AccessionNumber",
    "SeriesDescription",
    "ProtocolName",
    "SequenceName",
    "PatientPosition",
    "Laterality",
    "ImageLaterality",
    "Manufacturer",
    "ManufacturerModelName",
    "MagneticFieldStrength",
    "EchoTime",
    "RepetitionTime",
    "Rows",
    "Columns",
    "PixelSpacing",
    "SliceThickness",
    "SpacingBetweenSlices",
)

# Children held by one manifest row. A longer series continues in further rows (``chunk`` 1, 2, ...).
ROWS_PER_CHUNK = 100_000


def first_non_null(column: str, order: str) -> Column:
    """The value of the first row, by ``order``, that has one."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def _order_method(n: Column, located: Column, places: Column, numbered: Column, numbers: Column) -> Column:
    return (
        F.when((located == n) & (places == n), "geometry")
        .when((numbered == n) & (numbers == n), "instance_number")
        .otherwise("path_fallback")
    )


def _attributes(slices: DataFrame) -> list[Column]:
    present = [c for c in SUMMARY_COLUMNS if c in slices.columns]
    return [first_non_null(c, "dicom_path").alias(c) for c in present]


def _evidence_columns() -> list[Column]:
    n, located, numbered = F.col("slice_count"), F.col("_located"), F.col("_numbered")
    return [
        (located / n).alias("geometry_slice_fraction"),
        (numbered / n).alias("instance_number_fraction"),
        ((located == n) & (F.col("_places") == n)).alias("geometry_reliably_orderable"),
        ((numbered == n) & (F.col("_numbers") == n)).alias("instance_reliably_orderable"),
        _order_method(n, located, F.col("_places"), numbered, F.col("_numbers")).alias("order_method"),
    ]


def _listed(slices: DataFrame, keys: Sequence[str], distinct: Mapping[str, str]) -> DataFrame:
    """One aggregation: every group becomes a list that is sorted by the evidence it supports.

    The rows are dealt as they are: lists and first values of a few rows each would only make them wider.
    """
    child = F.struct(
        F.col("SpatialSliceCoordinate").alias("coordinate"),
        F.col("InstanceNumber").isNull().alias("unnumbered"),
        F.col("InstanceNumber").alias("instance"),
        F.col("dicom_path").alias("path"),
    )
    grouped = slices.repartition(*keys).groupBy(*keys).agg(
        F.count("*").alias("slice_count"),
        F.count("SpatialSliceCoordinate").alias("_located"),
        F.count("InstanceNumber").alias("_numbered"),
        F.collect_list(child).alias("_children"),
        *_attributes(slices),
        *[F.size(F.collect_set(c)).cast("bigint").alias(name) for name, c in distinct.items()],
    )

    def distinct_size(field: str) -> Column:
        return F.size(
            F.array_distinct(
                F.filter(
                    F.transform(F.col("_children"), lambda c: c[field]), lambda v: v.isNotNull()
                )
            )
        )

    measured = grouped.withColumns(
        {"_places": distinct_size("coordinate"), "_numbers": distinct_size("instance")}
    ).select("*", *_evidence_columns())
    by_instance = F.transform(
        F.array_sort(
            F.transform(
                F.col("_children"),
                lambda c: F.struct(c["unnumbered"], c["instance"], c["path"], c["coordinate"]),
            )
        ),
        lambda c: F.struct(c["coordinate"], c["unnumbered"], c["instance"], c["path"]),
    )
    by_path = F.transform(
        F.array_sort(
            F.transform(
                F.col("_children"),
                lambda c: F.struct(c["path"], c["unnumbered"], c["instance"], c["coordinate"]),
            )
        ),
        lambda c: F.struct(c["coordinate"], c["unnumbered"], c["instance"], c["path"]),
    )
    ordered = (
        F.when(F.col("order_method") == "geometry", F.array_sort("_children"))
        .when(F.col("order_method") == "instance_number", by_instance)
        .otherwise(by_path)
    )
    return measured.withColumns({"chunk": F.lit(0).cast("bigint"), "_children": ordered})


def _distinct_counts(slices: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values per group in two steps, so that a large group is spread by value first."""
    return (
        slices.groupBy(*keys, column)
        .agg(F.lit(1).alias("_one"))
        .groupBy(*keys)
        .agg(F.count(column).alias(name))
    )


def _matched(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    right = small.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return df.join(right, same, how).drop(*[f"_of_{k}" for k in keys])


def _sliced(
    slices: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], rows_per_task: int, rows_per_chunk: int
) -> DataFrame:
    """Large groups: rank the children across slices of the group, then list them chunk by chunk."""
    summary = slices.groupBy(*keys).agg(
        F.count("*").alias("slice_count"),
        F.count("SpatialSliceCoordinate").alias("_located"),
        F.count("InstanceNumber").alias("_numbered"),
        *_attributes(slices),
    )
    counted = {"_places": "SpatialSliceCoordinate", "_numbers": "InstanceNumber", **distinct}
    for name, column in counted.items():
        summary = _matched(summary, _distinct_counts(slices, keys, column, name), keys, "inner")
    # One row per large group, stored: both the ranking and the final rows use it.
    summary = durable(summary.select("*", *_evidence_columns()))
    method = summary.select(*keys, "order_method")
    core = slices.select(*keys, "SpatialSliceCoordinate", "InstanceNumber", "dicom_path")
    staged = _matched(core, method, keys, "inner").withColumns(
        {
            "_first": F.when(F.col("order_method") == "geometry", F.col("SpatialSliceCoordinate")),
            "_second": F.when(F.col("order_method") != "path_fallback", F.col("InstanceNumber")),
        }
    )
    order = [F.col("_first").asc_nulls_last(), F.col("_second").asc_nulls_last(), F.col("dicom_path")]
    placed = running_totals(
        staged, keys, order, {"_position": F.lit(1)}, rows_per_task=rows_per_task
    )
    listed = (
        placed.withColumn("chunk", F.floor(F.col("_position") / rows_per_chunk))
        .groupBy(*keys, "chunk")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "_position",
                        F.col("SpatialSliceCoordinate").alias("coordinate"),
                        F.col("InstanceNumber").isNull().alias("unnumbered"),
                        F.col("InstanceNumber").alias("instance"),
                        F.col("dicom_path").alias("path"),
                    )
                )
            ).alias("_children")
        )
        .withColumn(
            "_children",
            F.transform(
                "_children",
                lambda c: F.struct(c["coordinate"], c["unnumbered"], c["instance"], c["path"]),
            ),
        )
    )
    return _matched(listed, summary, keys, "inner")


def order_children(
    slices: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    distinct: Mapping[str, str] | None = None,
    rows_per_task: int = ROWS_PER_CHUNK,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Order the children of every group by the best evidence that is complete and unique in it.

    Evidence is coordinate, then instance number, then path. One row per (group, chunk): a group of
    up to ``rows_per_chunk`` children is one row, as in a plain list form; a larger one continues in
    further rows, so no row and no task ever holds an unbounded group. ``distinct`` names columns
    whose distinct values are counted along the way.
    """
    distinct = distinct or {}
    require_columns(
        slices, [*keys, "dicom_path", "SpatialSliceCoordinate", "InstanceNumber", *distinct.values()]
    )
    slices = slices.withColumn("SpatialSliceCoordinate", finite(F.col("SpatialSliceCoordinate")))
    limit = min(rows_per_task, rows_per_chunk)
    if groups_within(slices, keys, limit):
        listed = _listed(slices, keys, distinct)
    else:
        # At most total/limit groups are large; storing their keys fixes the split for both sides.
        large = durable(group_sizes(slices, keys).where(F.col("n") > limit).select(*keys))
        small_part = _listed(_matched(slices, large, keys, "left_anti"), keys, distinct)
        large_part = _sliced(_matched(slices, large, keys, "left_semi"), keys, distinct, limit, rows_per_chunk)
        listed = small_part.unionByName(large_part)
    children = F.col("_children")
    return listed.withColumns(
        {
            "ordered_dicom_paths": F.transform(children, lambda c: c["path"]),
            "ordered_slice_coordinates": F.transform(children, lambda c: c["coordinate"]),
            "ordered_instance_numbers": F.transform(children, lambda c: c["instance"]),
        }
    ).drop("_children", "_located", "_numbered", "_places", "_numbers")


def child_positions(ordered: DataFrame, keys: Sequence[str] = KEYS, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """One row per child with its position in the group."""
    return ordered.select(
        *keys,
        "order_method",
        "chunk",
        F.posexplode(
            F.arrays_zip("ordered_dicom_paths", "ordered_slice_coordinates", "ordered_instance_numbers")
        ).alias("_at", "_child"),
    ).select(
        *keys,
        "order_method",
        (F.col("chunk") * rows_per_chunk + F.col("_at")).alias("position"),
        F.col("_child.ordered_dicom_paths").alias("dicom_path"),
        F.col("_child.ordered_slice_coordinates").alias("SpatialSliceCoordinate"),
        F.col("_child.ordered_instance_numbers").alias("InstanceNumber"),
    )


def geometry_order(items: Column, coordinate: str = "coordinate", instance: str = "instance") -> Column:
    """Index form for one bounded list: the stable order of its items and the evidence used."""
    n = F.size(items)

    def complete(field: str) -> Column:
        values = F.filter(F.transform(items, lambda i: i[field]), lambda v: v.isNotNull())
        return (n > 0) & (F.size(values) == n) & (F.size(F.array_distinct(values)) == n)

    def order_by(field: str) -> Column:
        pairs = F.transform(items, lambda i, at: F.struct(i[field].alias("value"), at.alias("at")))
        return F.transform(F.array_sort(pairs), lambda p: p["at"])

    method = (
        F.when(complete(coordinate), "geometry")
        .when(complete(instance), "instance_number")
        .otherwise("input_fallback")
    )
    indices = (
        F.when(complete(coordinate), order_by(coordinate))
        .when(complete(instance), order_by(instance))
        .otherwise(F.transform(items, lambda _, at: at))
    )
    return F.struct(indices.alias("order"), method.alias("method"))


def series_manifest(
    slices: DataFrame,
    descriptors: DataFrame | None = None,
    **limits: int,
) -> DataFrame:
    """Ordered, auditable series rows with attributes and, when given, descriptors."""
    require_columns(slices, [*KEYS, "SOPInstanceUID"])
    ordered = order_children(slices, distinct={"unique_sop_count": "SOPInstanceUID"}, **limits)
    manifest = ordered.select(*[c for c in ordered.columns if c != "unique_sop_count"], "unique_sop_count")
    if descriptors is None:
        return manifest
    enforce(check_unique(descriptors, KEYS, "series descriptors are unique"))
    return manifest.join(descriptors, list(KEYS), "left")


def study_inventory(slices: DataFrame) -> DataFrame:
    """Series, slices, distinct instances and share of located slices per study."""
    require_columns(slices, [*KEYS, "SOPInstanceUID"])
    located = F.col("SpatialSliceCoordinate").isNotNull().cast("double")
    return slices.groupBy("StudyInstanceUID").agg(
        F.count_distinct("SeriesInstanceUID").alias("series_count"),
        F.count("*").alias("slice_count"),
        F.count_distinct("SOPInstanceUID").alias("unique_sop_count"),
        F.avg(located).alias("geometry_slice_fraction"),
    )


# Series attributes whose values are listed per study (fixed values).
VALUE_SETS = {
    "manufacturers": "Manufacturer",
    "manufacturer_models": "ManufacturerModelName",
    "field_strengths": "MagneticFieldStrength",
    "anatomical_planes": "Anatomical_Plane",
    "fluid_sensitive_values": "Fluid_Sensitive",
    "fat_suppression_values": "Fat_Suppression",
}


def extended_inventory(manifest: DataFrame) -> DataFrame:
    """Roll series up to studies; value sets become sorted JSON lists.

    Sets hold distinct attribute values and are combined before the shuffle, so a study with very
    many series costs no more than its vocabulary.
    """
    require_columns(manifest, [*KEYS, "slice_count"])
    series = manifest.where("chunk = 0") if "chunk" in manifest.columns else manifest

    def value_set(column: str) -> Column:
        if column not in series.columns:
            return F.lit("[]")
        return F.to_json(F.sort_array(F.collect_set(F.col(column).cast("string"))))

    def carried(column: str) -> Column:
        if column not in series.columns:
            return F.lit(None).cast("string")
        return first_non_null(column, "SeriesInstanceUID")

    return series.groupBy("StudyInstanceUID").agg(
        F.count_distinct("SeriesInstanceUID").alias("series_count"),
        F.sum("slice_count").cast("bigint").alias("slice_count"),
        F.avg(F.col("geometry_reliably_orderable").cast("double")).alias(
            "geometry_orderable_series_fraction"
        ),
        carried("PatientID").alias("PatientID"),
        carried("AccessionNumber").alias("AccessionNumber"),
        *[value_set(column).alias(name) for name, column in VALUE_SETS.items()],
    )


def manifest_audit(ordered: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Counts of an inference manifest: studies, series, slices, empty series, failed headers."""
    series = ordered.where("chunk = 0") if "chunk" in ordered.columns else ordered
    audit = series.agg(
        F.count_distinct("StudyInstanceUID").alias("study_count"),
        F.count("*").alias("series_count"),
        F.coalesce(F.sum("slice_count"), F.lit(0)).cast("bigint").alias("slice_count"),
        F.count_if(F.col("slice_count") == 0).alias("empty_series_count"),
        F.count_if("geometry_reliably_orderable").alias("geometry_ordered_series"),
    )
    if failures is None:
        return audit.withColumn("failed_header_count", F.lit(0).cast("bigint"))
    counted = failures.agg(F.count("*").alias("failed_header_count"))
    return audit.withColumn("failed_header_count", counted.scalar())


def score_children(series: DataFrame, preferred: Sequence[str] = S.PLANES) -> DataFrame:
    """Category, score and reasons for every series."""
    scored = S.score_series(
        F.col("Anatomical_Plane"),
        F.col("Fluid_Sensitive"),
        F.col("Fat_Suppression"),
        F.col("slice_count"),
        F.col("geometry_reliably_orderable"),
        preferred,
    )
    return series.withColumns(
        {
            "category": S.categorize(
                F.col("Anatomical_Plane"), F.col("Fluid_Sensitive"), F.col("Fat_Suppression")
            ),
            "_scored": scored,
        }
    ).select("*", "_scored.score", "_scored.reasons").drop("_scored")


def select_per_category(
    scored: DataFrame,
    *,
    max_series: int = 3,
    preferred: Sequence[str] = S.PLANES,
) -> DataFrame:
    """The best series of each preferred plane, then the best of the rest, up to ``max_series``.

    Both ranks are top-k filters, which Spark applies before the shuffle as well as after it. All
    chunks of a series rank alike and are kept together.
    """
    if max_series < 1:
        raise ValueError("max_series must be positive")
    study = "StudyInstanceUID"
    best_first = [F.col("score").desc(), F.col("SeriesInstanceUID").asc()]
    plane = F.initcap(F.coalesce(F.col("Anatomical_Plane"), F.lit("")))
    turn = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(preferred))):
        turn = F.when(plane == name, F.lit(i)).otherwise(turn)
    # A study's selection draws only on its top series overall and the top series of each plane.
    staged = scored.withColumn("_turn", turn)
    in_plane = Window.partitionBy(study, "_turn").orderBy(*best_first)
    shortlist = staged.withColumn("_rank", F.dense_rank().over(in_plane)).where(
        F.col("_rank") <= max_series
    )
    champion = F.col("_turn").isNotNull() & (F.col("_rank") == 1)
    slot = Window.partitionBy(study).orderBy(
        F.when(champion, F.col("_turn")).otherwise(len(preferred)), *best_first
    )
    return (
        shortlist.withColumn("slot", F.dense_rank().over(slot))
        .where(F.col("slot") <= max_series)
        .drop("_turn", "_rank")
    )


def sampling_plan(
    selected: DataFrame,
    *,
    max_series: int = 3,
    slices_per_series: int = 4,
    offsets: Sequence[int] = (-1, 0, 1),
    random_seed: int | None = None,
    keep_first_valid: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """One row per (study, slot): the paths to stack, the plane id and whether the slot is filled.

    ``selected`` has the chosen series, all chunks of each; slots follow the series' identifiers and
    every study is padded to ``max_series * slices_per_series`` slots. Positions come from the size
    of the whole series, and each chunk gives the paths that it holds.
    """
    chunked = "chunk" in selected.columns
    length = F.col("slice_count").cast("bigint") if chunked else F.size("ordered_dicom_paths").cast("bigint")
    start = F.col("chunk") * rows_per_chunk if chunked else F.lit(0)

    def path_at(i: Column) -> Column:
        # Outside of the chunk there is no element, and the place stays null.
        here = F.when(i >= start, (i - start).cast("int"))
        return F.get(F.col("ordered_dicom_paths"), here)

    centers = (
        S.uniform_indices(length, slices_per_series)
        if random_seed is None
        else S.stratified_random_indices(
            length, slices_per_series, F.col("SeriesInstanceUID"), random_seed
        )
    )
    plane_id = (
        F.when(F.col("Anatomical_Plane") == "Sagittal", 1)
        .when(F.col("Anatomical_Plane") == "Coronal", 2)
        .when(F.col("Anatomical_Plane") == "Axial", 3)
        .otherwise(0)
    )
    stacks = F.transform(
        centers,
        lambda c: F.struct(
            F.transform(
                S.neighborhood(c, length, offsets),
                path_at,
            ).alias("paths"),
            plane_id.alias("plane"),
        ),
    )
    expected = max_series * slices_per_series
    places = [F.max(F.get(F.col("_stack.paths"), F.lit(k))).alias(f"_path_{k}") for k in range(len(offsets))]
    # A stack's paths may come from several chunks.
    merged = (
        selected.select(*KEYS, F.posexplode_outer(F.when(length > 0, stacks)).alias("_nth", "_stack"))
        .groupBy(*KEYS, "_nth")
        .agg(F.max("_stack.plane").alias("plane"), *places)
    )
    stack = F.struct(F.array(*[f"_path_{k}" for k in range(len(offsets))]).alias("paths"), "plane")
    # At most max_series * slices_per_series rows per study reach this list.
    per_study = (
        merged.groupBy("StudyInstanceUID")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("_nth").isNotNull(), F.struct("SeriesInstanceUID", "_nth", stack.alias("_stack")))
                )
            ).alias("_series")
        )
        .select("StudyInstanceUID", F.transform("_series", lambda s: s["_stack"]).alias("_filled"))
    )
    filled = F.get(F.col("_filled"), F.col("slot"))
    valid = F.col("slot") < F.size("_filled")
    if keep_first_valid:
        valid = valid | ((F.size("_filled") == 0) & (F.col("slot") == 0))
    return per_study.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(expected - 1))).alias("slot")
    ).select(
        "StudyInstanceUID",
        "slot",
        F.coalesce(filled["paths"], F.array().cast("array<string>")).alias("paths"),
        F.coalesce(filled["plane"], F.lit(0)).alias("plane"),
        valid.alias("valid"),
    )


# Bytes per pixel of each stored representation (fixed values).
REPRESENTATIONS = {"fp32": 4, "fp16": 2, "uint16": 2, "uint8": 1}


def cache_estimate(
    manifest: DataFrame,
    *,
    slices_per_series: float,
    height: int,
    width: int,
    compression_ratio: float = 1.0,
) -> DataFrame:
    """Bytes a pixel cache of the manifest's studies would take, per representation."""
    if min(slices_per_series, height, width) <= 0 or not 0 < compression_ratio <= 1:
        raise ValueError("cache dimensions must be positive and the ratio in (0, 1]")
    series = manifest.where("chunk = 0") if "chunk" in manifest.columns else manifest
    sizes = series.agg(
        F.count_distinct("StudyInstanceUID").alias("studies"),
        F.count("*").alias("_series"),
    ).withColumn("series_per_study", F.col("_series") / F.col("studies"))
    choices = F.array(
        *[
            F.struct(F.lit(n).alias("representation"), F.lit(b).alias("bytes_per_pixel"))
            for n, b in REPRESENTATIONS.items()
        ]
    )
    raw = (
        F.col("studies") * F.col("series_per_study") * slices_per_series * height * width
        * F.col("bytes_per_pixel")
    )
    return (
        sizes.select("studies", "series_per_study", F.inline(choices))
        .withColumn("estimated_bytes", F.rint(raw * compression_ratio).cast("bigint"))
        .withColumn("estimated_gib", F.col("estimated_bytes") / float(1024**3))
    )
