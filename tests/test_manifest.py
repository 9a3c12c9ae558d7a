from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohort_spark.core import ContractError
from cohort_spark.functions import arrays as R
from cohort_spark.functions import geometry as G
from cohort_spark.functions import series as S
from cohort_spark.operators import audit as A
from cohort_spark.operators import manifest as M
from cohort_spark.skew import exact_quantiles, running_totals

SCHEMA = (
    "StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, dicom_path string, "
    "SpatialSliceCoordinate double, InstanceNumber bigint, PatientID string, AccessionNumber string, "
    "Manufacturer string, ManufacturerModelName string, MagneticFieldStrength double"
)


@pytest.fixture(scope="module")
def slices(spark):
    rows = [
        ("study-1", "series-a", "s1", "b.dcm", 2.0, 1, "p", "acc1", None, "m", 1.5),
        ("study-1", "series-a", "s2", "a.dcm", 1.0, 2, "p", "acc1", "maker", "m", 1.5),
        ("study-1", "series-a", "s3", "c.dcm", 3.0, 3, "p", "acc1", "maker", "m", 1.5),
        ("study-2", "series-b", "s4", "d.dcm", None, 2, "p", "acc2", "maker", "n", 3.0),
        ("study-2", "series-b", "s5", "e.dcm", None, 1, "p", "acc2", "maker", "n", 3.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_series_are_ordered_by_the_best_evidence(spark, slices):
    descriptors = spark.createDataFrame(
        [("study-1", "series-a", 1, 0, "Sagittal")],
        "StudyInstanceUID string, SeriesInstanceUID string, Fluid_Sensitive int, Fat_Suppression int, Anatomical_Plane string",
    )
    manifest = M.series_manifest(slices, descriptors)
    rows = {r.SeriesInstanceUID: r for r in manifest.collect()}
    assert rows["series-a"].order_method == "geometry"
    assert rows["series-a"].ordered_dicom_paths == ["a.dcm", "b.dcm", "c.dcm"]
    assert rows["series-a"].Anatomical_Plane == "Sagittal"
    assert rows["series-a"].Manufacturer == "maker"
    assert rows["series-b"].order_method == "instance_number"
    assert rows["series-b"].ordered_dicom_paths == ["e.dcm", "d.dcm"]
    assert rows["series-b"].ordered_slice_coordinates == [None, None]
    inventory = M.extended_inventory(manifest)
    assert inventory.count() == 2
    shared = {r.column: r for r in A.grouping_audit(inventory).collect()}
    assert shared["PatientID"].values_shared_across_studies == 1
    assert shared["PatientID"].studies_in_shared_groups == 2
    twice = descriptors.union(descriptors)
    with pytest.raises(ContractError):
        M.series_manifest(slices, twice)


def _positions(df, rows_per_chunk):
    return {
        (r.SeriesInstanceUID, r.dicom_path): (r.order_method, r.position)
        for r in M.child_positions(df, rows_per_chunk=rows_per_chunk).collect()
    }


def test_large_groups_are_sliced_with_the_same_result(spark):
    key = F.col("id")
    table = spark.range(900).select(
        F.lit("study").alias("StudyInstanceUID"),
        F.when(key < 400, F.lit(None).cast("string"))
        .when(key < 700, "numbered")
        .when(key < 890, "paths")
        .otherwise("small")
        .alias("SeriesInstanceUID"),
        F.concat(F.lit("sop"), key.cast("string")).alias("SOPInstanceUID"),
        F.concat(F.md5(key.cast("string")), F.lit(".dcm")).alias("dicom_path"),
        F.when(key < 400, (key * 7919 % 1009).cast("double")).alias("SpatialSliceCoordinate"),
        F.when(key < 700, key * 31 % 997).otherwise(F.lit(3)).alias("InstanceNumber"),
        F.when(key % 2 == 0, F.concat(F.lit("p"), key.cast("string"))).alias("PatientID"),
    )
    plain = M.series_manifest(table)
    sliced = M.series_manifest(table, rows_per_task=50, rows_per_chunk=64)
    assert _positions(plain, M.ROWS_PER_CHUNK) == _positions(sliced, 64)
    assert sliced.agg(F.max(F.size("ordered_dicom_paths"))).first()[0] <= 64
    columns = ["SeriesInstanceUID", "slice_count", "unique_sop_count", "order_method", "PatientID", "geometry_slice_fraction"]
    assert sorted(map(str, plain.select(*columns).collect())) == sorted(
        map(str, sliced.where("chunk = 0").select(*columns).collect())
    )


def test_running_totals_agree_across_slices(spark):
    table = spark.range(1000).select(
        F.when(F.col("id") < 600, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("k"),
        (F.col("id") * 7919 % 1009).alias("v"),
    )
    options = {"keys": ["k"], "order": [F.col("v")], "totals": {"before": F.col("v")}}
    plain = running_totals(table, **options).collect()
    sliced = running_totals(table, **options, rows_per_task=40).collect()
    assert sorted(map(str, plain)) == sorted(map(str, sliced))
    assert len(plain) == 1000


def test_quantiles_are_exact_in_both_plans(spark):
    import numpy as np

    table = spark.range(501).select((F.col("id") * 37 % 101).cast("double").alias("x"))
    values = [r.x for r in table.collect()]
    want = [np.percentile(values, 2.5), np.percentile(values, 50)]
    for limit in (None, 10):
        got = exact_quantiles(table, [], "x", {"lo": 0.025, "mid": 0.5}, rows_per_task=limit).first()
        assert [got.lo, got.mid] == pytest.approx(want)


def test_geometry(spark):
    o = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)])
    short = F.array(F.lit(1.0))
    p = F.array(F.lit(0.0), F.lit(0.0), F.lit(7.5))
    row = spark.range(1).select(
        G.projected_coordinate(o, p).alias("c"),
        G.projected_coordinate(short, p).alias("none"),
        G.unit_normal(o).alias("n"),
        G.infer_plane(o).alias("plane"),
        G.infer_plane(F.lit(None).cast("array<double>")).alias("unknown"),
        G.unit_coordinate(o, F.array(F.lit(0.0), F.lit(float("nan")), F.lit(1.0))).alias("nan"),
    ).first()
    assert (row.c, row.none, row.n, row.plane, row.unknown, row.nan) == (7.5, None, [0.0, 0.0, 1.0], "Axial", "Unknown", None)


def test_geometry_order_index_form(spark):
    def items(*pairs):
        return F.array(
            *[F.struct(F.lit(c).cast("double").alias("coordinate"), F.lit(i).cast("int").alias("instance")) for c, i in pairs]
        )

    row = spark.range(1).select(
        M.geometry_order(items((3.0, 1), (1.0, 2), (2.0, 3))).alias("g"),
        M.geometry_order(items((None, 2), (1.0, 1))).alias("i"),
        M.geometry_order(items((None, 1), (1.0, 1))).alias("f"),
    ).first()
    assert (row.g.order, row.g.method) == ([1, 2, 0], "geometry")
    assert (row.i.order, row.i.method) == ([1, 0], "instance_number")
    assert (row.f.order, row.f.method) == ([0, 1], "input_fallback")


def test_selection_and_sampling(spark):
    rows = [
        ("st", "sag", "Sagittal", 1, 1, 20, True),
        ("st", "cor", "coronal", 1, 0, 20, True),
        ("st", "ax", "Axial", 0, 0, 20, True),
        ("st", "extra", "Sagittal", 1, 1, 1, True),
    ]
    table = spark.createDataFrame(
        rows,
        "StudyInstanceUID string, SeriesInstanceUID string, Anatomical_Plane string, Fluid_Sensitive int, Fat_Suppression int, slice_count int, geometry_reliably_orderable boolean",
    )
    scored = M.score_children(table)
    first = scored.where("SeriesInstanceUID = 'sag'").first()
    assert first.category == "sagittal_fluid_fs" and first.score == 8.0
    assert first.reasons == ["preferred_plane", "fluid_sensitive", "fat_suppression", "typical_slice_count", "geometry_orderable"]
    chosen = {r.SeriesInstanceUID: r.slot for r in M.select_per_category(scored).collect()}
    assert chosen == {"sag": 1, "cor": 2, "ax": 3}
    row = spark.range(1).select(
        S.uniform_indices(F.lit(2), 5).alias("u"),
        S.neighborhood(F.lit(0), F.lit(3)).alias("n"),
        S.stratified_random_indices(F.lit(9), 3, F.lit("k"), 1).alias("r"),
    ).first()
    assert row.u == [0, 0, 0, 1, 1] and row.n == [0, 0, 1]
    assert [v // 3 for v in row.r] == [0, 1, 2]


def test_cache_estimate_relations(spark):
    table = spark.range(20).select(
        (F.col("id") % 10).alias("StudyInstanceUID"), F.col("id").alias("SeriesInstanceUID")
    )
    got = {r.representation: r.estimated_bytes for r in M.cache_estimate(table, slices_per_series=16, height=224, width=224).collect()}
    assert got["fp16"] == 10 * 2 * 16 * 224 * 224 * 2
    assert got["fp32"] == 2 * got["fp16"] == 4 * got["uint8"]


def test_schema_inference_and_table_audit(spark):
    train = spark.createDataFrame(
        [("a", "text", 1, 1), ("b", "text", 0, 0), ("b", "more", 1, 1)], "StudyInstanceUID string, report string, target_x int, target_y int"
    )
    sample = spark.createDataFrame([("a", 0.5, 0.5)], "StudyInstanceUID string, target_y double, target_x double")
    roles = [(r.column, r.role) for r in A.infer_schema(sample).orderBy("position").collect()]
    assert roles == [("StudyInstanceUID", "identifier"), ("target_y", "target"), ("target_x", "target")]
    with pytest.raises(ContractError):
        A.infer_schema(sample.withColumn("patient_id", F.lit(1)))
    assert [r.column for r in A.column_catalog(train).where("report").collect()] == ["report"]
    pairs = {(r.target, r.other): r.rows for r in A.cooccurrence(train, ["target_x", "target_y"]).collect()}
    assert pairs[("target_x", "target_y")] == 2
    profile = A.identifier_profile(train).first()
    assert (profile.unique_non_null_count, profile.duplicate_non_null_rows) == (2, 2)
    assert {r.node for r in A.table_audit(train, sample).collect()} >= {"missingness", "prevalence"}


def test_fit_length(spark):
    values = F.array(*[F.lit(float(v)) for v in range(1, 6)])
    grid = F.array(values, values, values)
    row = spark.range(1).select(
        R.fit_length(values, 3).alias("crop"), R.fit_length(values, 8).alias("pad"), R.fit_grid(grid, 2, 6).alias("grid")
    ).first()
    assert row.crop == [2.0, 3.0, 4.0]
    assert row.pad == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0]
    assert row.grid == [[1.0, 2.0, 3.0, 4.0, 5.0, 0.0]] * 2


def test_chunked_series_serve_every_consumer_alike(spark):
    key = F.col("id")
    table = spark.range(90).select(
        F.concat(F.lit("study"), (key % 3).cast("string")).alias("StudyInstanceUID"),
        F.concat(F.lit("series"), (key % 3).cast("string"), (key % 9 > 5).cast("string"), (key % 2).cast("string")).alias("SeriesInstanceUID"),
        F.concat(F.lit("sop"), key.cast("string")).alias("SOPInstanceUID"),
        F.concat(F.md5(key.cast("string")), F.lit(".dcm")).alias("dicom_path"),
        F.when(key % 3 < 2, (key * 7919 % 1009).cast("double")).alias("SpatialSliceCoordinate"),
        key.alias("InstanceNumber"),
    )
    planes = F.when(F.col("SeriesInstanceUID").endswith("1"), "Axial").otherwise("Sagittal")

    def consumers(**limits):
        manifest = M.series_manifest(table, **limits).withColumn("Anatomical_Plane", planes)
        scored = manifest.withColumn("score", F.col("slice_count").cast("double"))
        chosen = M.select_per_category(scored, max_series=2)
        chunk = {k: v for k, v in limits.items() if k == "rows_per_chunk"}
        slots = chosen.select("StudyInstanceUID", "SeriesInstanceUID", "slot").distinct()
        plan = M.sampling_plan(chosen, max_series=2, **chunk)
        sizes = M.cache_estimate(manifest, slices_per_series=4, height=8, width=8)
        return [sorted(map(str, df.collect())) for df in (slots, plan, sizes, M.extended_inventory(manifest))]

    plain = consumers()
    assert plain == consumers(rows_per_task=4, rows_per_chunk=4)
    assert len(plain[0]) == 6 and len(plain[1]) == 24
