"""Table and header audits: each node is a small DataFrame, assembled to one JSON row at the sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.core import ContractError, durable, is_missing, require_columns
from cohort_spark.functions.series import path_depth

# Header columns whose value counts are reported (fixed values).
CATEGORICAL_COLUMNS = (
    "SeriesDescription",
    "ProtocolName",
    "SequenceName",
    "PatientPosition",
    "Laterality",
    "ImageLaterality",
    "Manufacturer",
    "ManufacturerModelName",
    "MagneticFieldStrength",
    "PhotometricInterpretation",
    "Rows",
    "Columns",
)
# Column-name parts that mark an identifier, and name parts of report columns (fixed values).
IDENTIFIER_TOKENS = ("id", "uid", "study", "patient", "exam", "case", "instance")
REPORT_TOKENS = ("report", "text", "findings", "impression")


def _cells(columns: Sequence[str], cell) -> Column:
    return F.inline(F.array(*[cell(c) for c in columns]))


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (row, column) with the value as text."""
    return df.select(
        _cells(
            columns,
            lambda c: F.struct(
                F.lit(c).alias("column"),
                F.when(~is_missing(df, c), F.col(c).cast("string")).alias("value"),
            ),
        )
    )


def missingness(df: DataFrame) -> DataFrame:
    """Missing count and fraction of every column, from one aggregate over the table."""
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(is_missing(df, c)).alias(f"m::{c}") for c in df.columns],
    )
    return _missing_rows(counts, df.columns)


def _missing_rows(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column from one row of counts ``n, m::<column>``."""
    return counts.select(
        _cells(
            columns,
            lambda c: F.struct(
                F.lit(c).alias("column"),
                F.col(f"`m::{c}`").alias("missing_count"),
                F.when(F.col("n") > 0, F.col(f"`m::{c}`") / F.col("n")).otherwise(0.0).alias(
                    "missing_fraction"
                ),
            ),
        )
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value), nulls kept; combined before the shuffle."""
    return _values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def duplicate_ids(
    df: DataFrame,
    columns: Sequence[str] = ("StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID"),
) -> DataFrame:
    """Rows whose identifier occurs more than once, every occurrence counted."""
    return (
        value_counts(df, [c for c in columns if c in df.columns])
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias("duplicate_rows")
        )
    )


def grouping_audit(
    df: DataFrame, columns: Sequence[str] = ("PatientID", "AccessionNumber")
) -> DataFrame:
    """Whether grouping identifiers survive: values shared across studies and rows in shared groups."""
    known = F.col("value").isNotNull()
    shared = known & (F.col("n") > 1)
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).cast("bigint").alias("non_null_studies"),
            F.count_if(known).alias("unique_values"),
            F.count_if(shared).alias("values_shared_across_studies"),
            F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).cast("bigint").alias(
                "studies_in_shared_groups"
            ),
            F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("maximum_studies_per_value"),
        )
    )


def value_distributions(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS
) -> DataFrame:
    """Value counts of categorical columns with a ``<missing>`` bucket."""
    present = [c for c in columns if c in df.columns]
    return value_counts(df, present).select(
        "column", F.coalesce("value", F.lit("<missing>")).alias("value"), "n"
    )


def _group_frequency(df: DataFrame, group: str) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("frequency"))


def group_size_distribution(df: DataFrame, group: str = "SeriesInstanceUID") -> DataFrame:
    """Children per group: number of groups, smallest, median and largest.

    Sizes are reduced to (size, frequency) first, so the median sees distinct sizes only.
    """
    return _group_frequency(df, group).agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).cast("bigint").alias("series_count"),
        F.min("size").alias("min"),
        F.percentile("size", 0.5, F.col("frequency")).alias("median"),
        F.max("size").alias("max"),
    )


def group_size_frequency(df: DataFrame, group: str = "SeriesInstanceUID") -> DataFrame:
    """How many groups have each size."""
    return _group_frequency(df, group)


def ordering_reliability(
    df: DataFrame, group: str = "SeriesInstanceUID", coordinate: str = "SpatialSliceCoordinate"
) -> DataFrame:
    """Groups whose coordinates are complete, unique, both.

    Values are combined per (group, coordinate) first, which spreads a large group.
    """
    per_value = df.groupBy(group, coordinate).agg(F.count("*").alias("n"))
    per_group = per_value.groupBy(group).agg(
        F.sum("n").alias("size"),
        F.sum(F.when(F.col(coordinate).isNotNull(), F.col("n")).otherwise(0)).alias("present"),
        F.count(coordinate).alias("unique"),
    )
    complete = F.col("present") == F.col("size")
    distinct = F.col("unique") == F.col("size")
    return per_group.agg(
        F.count_if(complete).alias("series_with_all_coordinates"),
        F.count_if(distinct).alias("series_with_unique_coordinates"),
        F.count_if(complete & distinct).alias("series_reliably_orderable"),
        F.count("*").alias("series_total"),
    )


TOTAL_IDS = {
    "study_count": "StudyInstanceUID",
    "series_count": "SeriesInstanceUID",
    "sop_count": "SOPInstanceUID",
    "patient_count_if_recoverable": "PatientID",
}


def totals(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Rows and distinct identifiers of the header table; the patient count is null without any id.

    Study, series and patient are counted on their distinct combinations, of which there are few, and
    files on their own: no row is copied per identifier. ``approximate`` unites sketches instead.
    """
    if approximate:
        return united_totals(total_sketches(df))
    present = {n: c for n, c in TOTAL_IDS.items() if c in df.columns}
    coarse = [c for n, c in present.items() if n != "sop_count"]
    combined = durable(df.groupBy(*coarse).agg(F.count("*").alias("_rows")))
    counts = {"dicom_count": combined.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint"))}
    for name, column in TOTAL_IDS.items():
        if column not in df.columns:
            continue
        source = df if name == "sop_count" else combined
        counts[name] = source.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("one")).agg(F.count("*"))
    out = df.sparkSession.range(1).select(
        *[counts[n].scalar().alias(n) if n in counts else F.lit(None).cast("bigint").alias(n) for n in ("dicom_count", *TOTAL_IDS)]
    )
    patients = F.nullif("patient_count_if_recoverable", F.lit(0))
    return out.withColumn("patient_count_if_recoverable", patients)


def total_sketches(df: DataFrame, parts: Sequence[str] = (), *, precision: int = 14) -> DataFrame:
    """Per part, its rows and one mergeable sketch of the values of each identifier.

    Stored sketches of finished parts are united with those of new ones, so old parts are not read again.
    """
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(n) for n, c in TOTAL_IDS.items() if c in df.columns]
    return df.groupBy(*parts).agg(F.count("*").alias("dicom_count"), *sketches)


def united_totals(sketches: DataFrame) -> DataFrame:
    """Totals from the sketches of any parts; relative error about 1 / sqrt(2^precision)."""

    def number(name: str) -> Column:
        if name not in sketches.columns:
            return F.lit(None).cast("bigint")
        estimate = F.hll_sketch_estimate(F.hll_union_agg(name))
        return F.nullif(estimate, F.lit(0)) if name == "patient_count_if_recoverable" else F.coalesce(estimate, F.lit(0))

    rows = F.coalesce(F.sum("dicom_count"), F.lit(0)).cast("bigint").alias("dicom_count")
    return sketches.agg(rows, *[number(n).alias(n) for n in TOTAL_IDS])


def path_depths(df: DataFrame, path: str = "dicom_path") -> DataFrame:
    """Files per depth of their relative path."""
    return df.groupBy(path_depth(F.col(path)).alias("depth")).agg(F.count("*").alias("n"))


def order_methods(manifest: DataFrame) -> DataFrame:
    """Series per ordering method."""
    series = manifest.where("chunk = 0") if "chunk" in manifest.columns else manifest
    return series.groupBy("order_method").agg(F.count("*").alias("n"))


def descriptor_missingness(
    manifest: DataFrame,
    columns: Sequence[str] = ("Fluid_Sensitive", "Fat_Suppression", "Anatomical_Plane"),
) -> DataFrame:
    """Series without a descriptor, per descriptor column."""
    series = manifest.where("chunk = 0") if "chunk" in manifest.columns else manifest
    return missingness(series.select(*[c for c in columns if c in series.columns]))


# --- tabular schema ------------------------------------------------------------------------------


def column_catalog(df: DataFrame) -> DataFrame:
    """The columns of a table as rows: position, name, type and two name tests."""
    spark = df.sparkSession
    rows = [
        (i, f.name, f.dataType.simpleString(), isinstance(f.dataType, T.NumericType))
        for i, f in enumerate(df.schema.fields)
    ]
    catalog = spark.createDataFrame(rows, "position int, column string, type string, numeric boolean")
    plain = F.trim(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", " "))
    looks = F.arrays_overlap(
        F.split(plain, " "), F.array(*[F.lit(t) for t in IDENTIFIER_TOKENS])
    ) | plain.endswith("uid")
    report = F.lit(False)
    for token in REPORT_TOKENS:
        report = report | F.contains(F.lower("column"), F.lit(token))
    return catalog.withColumns({"identifier": looks, "report": report})


def infer_schema(sample: DataFrame) -> DataFrame:
    """Role of every sample column, ``identifier`` or ``target``; anything ambiguous is an error.

    The catalog has one row per column and needs no data, so its rows may be read on the driver.
    """
    columns = column_catalog(sample).orderBy("position").collect()
    if len(columns) < 2:
        raise ContractError("the sample needs an identifier and at least one target")
    named = [c for c in columns if c.identifier]
    targets = [c for c in columns if c.numeric and not c.identifier]
    if not named:
        named = [c for c in columns if not c.numeric]
    if len(named) != 1:
        raise ContractError("cannot infer exactly one identifier; configure it explicitly")
    if not targets:
        raise ContractError("cannot infer numeric target columns from the sample")
    role = {named[0].column: "identifier", **{t.column: "target" for t in targets}}
    unclassified = [c.column for c in columns if c.column not in role]
    if unclassified:
        raise ContractError("unclassified sample columns: " + ", ".join(unclassified))
    return sample.sparkSession.createDataFrame(
        [(c.position, c.column, role[c.column]) for c in columns],
        "position int, column string, role string",
    )


def identifier_columns(df: DataFrame) -> list[str]:
    """Names of the columns that look like identifiers, in table order."""
    found = column_catalog(df).where("identifier").orderBy("position").select("column").collect()
    return [r.column for r in found]


def identifier_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cardinality, missing and duplicated rows of candidate identifiers."""
    columns = [c for c in (columns or identifier_columns(df)) if c in df.columns]
    known = F.col("value").isNotNull()
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.sum("n").cast("bigint").alias("row_count"),
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).cast("bigint").alias("non_null_count"),
            F.count_if(known).alias("unique_non_null_count"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).cast("bigint").alias("missing_count"),
            F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias("duplicate_non_null_rows"),
        )
    )


def target_prevalence(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Known and missing counts, value domain, positives and rate among the known, per target."""
    require_columns(df, targets)
    cells = df.select(
        _cells(
            targets,
            lambda t: F.struct(
                F.lit(t).alias("target"),
                F.when(~is_missing(df, t), F.col(t).cast("double")).alias("value"),
            ),
        )
    )
    known, positive = F.col("value").isNotNull(), F.col("value") == 1
    return (
        cells.groupBy("target", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("target")
        .agg(
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).cast("bigint").alias("missing_count"),
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).cast("bigint").alias("known_count"),
            F.count_if(known).alias("distinct_values"),
            F.min("value").alias("smallest"),
            F.max("value").alias("largest"),
            F.coalesce(F.sum(F.when(positive, F.col("n"))), F.lit(0)).cast("bigint").alias("positive_count"),
            (
                F.coalesce(F.sum(F.when(positive, F.col("n"))), F.lit(0))
                / F.nullif(F.sum(F.when(known, F.col("n"))), F.lit(0))
            ).alias("positive_prevalence_among_known"),
        )
    )


def target_domain(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every distinct known value of every target with its row count."""
    return value_counts(df, targets).where(F.col("value").isNotNull()).withColumnRenamed("column", "target")


def cooccurrence(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows positive in both targets, for every ordered pair of targets.

    One aggregate with a conditional count per configured pair: no fan-out and no shuffle of rows.
    """
    require_columns(df, targets)
    if not targets:
        raise ValueError("at least one target is required")
    pairs = [(a, b) for a in targets for b in targets]
    both = df.agg(
        *[
            F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return both.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("target"), F.lit(b).alias("other"), F.col(f"`{i}`").alias("rows")
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Full rows that repeat an earlier one, nulls equal."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    )


def entity_counts(df: DataFrame, entities: Mapping[str, str | None]) -> DataFrame:
    """Distinct values per configured entity; null for an entity without a column."""
    counted = [
        (F.count_distinct(c) if c and c in df.columns else F.lit(None).cast("bigint")).alias(name)
        for name, c in entities.items()
    ]
    return df.agg(*counted)


def assemble_audit(spark: SparkSession, nodes: Mapping[str, DataFrame]) -> DataFrame:
    """``node, body`` rows: every row of every node as JSON, and one row without body per node.

    Nodes may have any number of rows; nothing is collected into a list.
    """
    out = spark.createDataFrame([(name, None) for name in nodes], "node string, body string")
    for name, df in nodes.items():
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        out = out.unionByName(df.select(F.lit(name).alias("node"), row.alias("body")))
    return out


def table_audit(
    train: DataFrame,
    sample: DataFrame,
    *,
    targets: Sequence[str] | None = None,
    identifier: str | None = None,
    entities: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Audit of a training table against its delivery sample as ``node, body`` rows."""
    schema = infer_schema(sample) if targets is None or identifier is None else None
    if schema is not None:
        roles = schema.orderBy("position").collect()
        identifier = identifier or next(r.column for r in roles if r.role == "identifier")
        targets = targets or [r.column for r in roles if r.role == "target"]
    present = [t for t in targets if t in train.columns]
    available = len(present) == len(targets)
    counts = train.agg(F.count("*").alias("train_row_count"))
    nodes = {
        "columns": column_catalog(train),
        "rows": counts,
        "sample_rows": sample.agg(F.count("*").alias("sample_row_count")),
        "entities": entity_counts(train, entities or {"row_identifier_count": identifier}),
        "identifiers": identifier_profile(train),
        "duplicate_train_rows": duplicate_rows(train),
        "duplicate_sample_rows": duplicate_rows(sample),
        "missingness": missingness(train),
    }
    if available:
        nodes["prevalence"] = target_prevalence(train, targets)
        nodes["cooccurrence"] = cooccurrence(train, targets)
    return assemble_audit(train.sparkSession, nodes)


def _header_cells(slices: DataFrame, series: str, coordinate: str, categories: Sequence[str]) -> DataFrame:
    """``part, column, value, place, n``: how often each value of a header table occurs, from one pass.

    Parts are identifiers (with the coordinate beside the series), categories, path depths, and which
    columns a row misses. Values are combined before the shuffle, and coordinates spread a large series.
    """
    place_type = slices.schema[coordinate].dataType
    text = lambda c: F.when(~is_missing(slices, c), F.col(c).cast("string"))

    def cell(part: str, column: str | None, value: Column, place: Column | None = None) -> Column:
        at = F.lit(None).cast(place_type) if place is None else place
        return F.struct(F.lit(part).alias("part"), F.lit(column).cast("string").alias("column"), value.alias("value"), at.alias("place"))

    identifiers = [c for c in TOTAL_IDS.values() if c in slices.columns]
    missing = F.concat(*[F.when(is_missing(slices, c), "1").otherwise("0") for c in slices.columns])
    cells = [cell("identifier", c, text(c), F.col(coordinate) if c == series else None) for c in identifiers]
    cells += [cell("category", c, text(c)) for c in categories]
    cells += [cell("depth", None, path_depth(F.col("dicom_path")).cast("string")), cell("missing", None, missing)]
    return slices.select(F.inline(F.array(*cells))).groupBy("part", "column", "value", "place").agg(F.count("*").alias("n"))


def _header_counts(slices: DataFrame, series: str, coordinate: str, categories: Sequence[str]) -> DataFrame:
    """The cells with identifiers reduced to ``n, known, groups``: how many values occur n times.

    Series meet once more, with the coordinates of each added up, and carry whether these are complete and distinct.
    """
    identifier, of_series = F.col("part") == "identifier", F.col("column") == series
    named = ~identifier | of_series
    lone = identifier & ~of_series
    known = F.col("value").isNotNull()
    # An identifier other than the series is whole here and leaves only its number of rows.
    per_value = (
        _header_cells(slices, series, coordinate, categories)
        .groupBy(
            "part", "column", known.alias("known"), F.when(named, F.col("value")).alias("value"), F.when(lone, F.col("n")).alias("times")
        )
        .agg(
            F.sum("n").alias("rows"),
            F.count("*").alias("cells"),
            F.sum(F.when(F.col("place").isNotNull(), F.col("n")).otherwise(0)).alias("present"),
            F.count("place").alias("unique"),
        )
    )
    within = identifier & of_series
    return per_value.groupBy(
        "part",
        "column",
        "known",
        F.when(~identifier, F.col("value")).alias("value"),
        F.when(within, F.col("rows")).otherwise(F.col("times")).alias("n"),
        F.when(within, F.col("present") == F.col("rows")).alias("complete"),
        F.when(within, F.col("unique") == F.col("rows")).alias("distinct"),
    ).agg(F.sum("rows").alias("rows"), F.sum(F.when(within, F.lit(1)).otherwise(F.col("cells"))).alias("groups"))


def header_audit(slices: DataFrame) -> DataFrame:
    """Audit of a header table as ``node, body`` rows.

    The nodes are those of the single audits; all are read from one stored table of counts, which one
    pass over the headers yields. Its rows are the categories' values and the sizes of groups that occur.
    """
    series, categories = "SeriesInstanceUID", [c for c in CATEGORICAL_COLUMNS if c in slices.columns]
    counts = durable(_header_counts(slices, series, "SpatialSliceCoordinate", categories))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    part = lambda name: F.col("part") == name
    named, of_series = lambda c: part("identifier") & (F.col("column") == c), counts.where(part("identifier") & (F.col("column") == series))

    def values_of(column: str) -> Column:
        if column not in slices.columns:
            return F.lit(None).cast("bigint")
        return whole(F.when(named(column) & F.col("known"), F.col("groups")))

    totals_row = counts.agg(
        whole(F.when(part("missing"), F.col("rows"))).alias("dicom_count"), *[values_of(c).alias(n) for n, c in TOTAL_IDS.items()]
    ).withColumn("patient_count_if_recoverable", F.nullif("patient_count_if_recoverable", F.lit(0)))
    missed = counts.where(part("missing")).agg(
        whole("rows").alias("n"),
        *[whole(F.when(F.substring("value", i + 1, 1) == "1", F.col("rows"))).alias(f"m::{c}") for i, c in enumerate(slices.columns)],
    )
    keys = [c for c in ("StudyInstanceUID", series, "SOPInstanceUID") if c in slices.columns]
    groups = lambda *flags: whole(F.when(flags[0] if len(flags) == 1 else flags[0] & flags[1], F.col("groups")))
    nodes = {
        "totals": totals_row,
        "missingness": _missing_rows(missed, slices.columns),
        "duplicate_identifier_rows": counts.where(part("identifier") & F.col("column").isin(keys))
        .groupBy("column")
        .agg(whole(F.when(F.col("known") & (F.col("n") > 1), F.col("rows"))).alias("duplicate_rows")),
        "series_slice_distribution": of_series.agg(
            whole("groups").alias("series_count"),
            F.min("n").alias("min"),
            F.percentile("n", 0.5, F.col("groups")).alias("median"),
            F.max("n").alias("max"),
        ),
        "series_slice_frequency": of_series.groupBy(F.col("n").alias("size")).agg(F.sum("groups").alias("frequency")),
        "geometry": of_series.agg(
            groups(F.col("complete")).alias("series_with_all_coordinates"),
            groups(F.col("distinct")).alias("series_with_unique_coordinates"),
            groups(F.col("complete"), F.col("distinct")).alias("series_reliably_orderable"),
            whole("groups").alias("series_total"),
        ),
        "categorical_distributions": counts.where(part("category")).select(
            "column", F.coalesce("value", F.lit("<missing>")).alias("value"), F.col("rows").alias("n")
        ),
        "relative_path_depth_distribution": counts.where(part("depth")).select(
            F.col("value").cast("int").alias("depth"), F.col("rows").alias("n")
        ),
    }
    return assemble_audit(slices.sparkSession, nodes)
