"""Geometry, series attributes, ordering, manifests, selection and header audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.functions import geometry as G
from cohort_spark.functions import series as S
from cohort_spark.operators import audit as A
from cohort_spark.operators import manifest as M
from testbed.registry import query
from testbed.views import load, with_views

ORDERED_SQL = """
ev AS (SELECT *, count(*) OVER s AS n, count(SpatialSliceCoordinate) OVER s AS located,
              count(InstanceNumber) OVER s AS numbered
       FROM slices WINDOW s AS (PARTITION BY StudyInstanceUID, SeriesInstanceUID)),
di AS (SELECT StudyInstanceUID AS st, SeriesInstanceUID AS se, count(DISTINCT SpatialSliceCoordinate) AS places,
              count(DISTINCT InstanceNumber) AS numbers, count(DISTINCT SOPInstanceUID) AS sops
       FROM slices GROUP BY 1, 2),
me AS (SELECT ev.*, places, numbers, sops,
              CASE WHEN located = n AND places = n THEN 'geometry'
                   WHEN numbered = n AND numbers = n THEN 'instance_number' ELSE 'path_fallback' END AS order_method
       FROM ev JOIN di ON StudyInstanceUID = st AND SeriesInstanceUID = se),
pos AS (SELECT *, row_number() OVER (PARTITION BY StudyInstanceUID, SeriesInstanceUID ORDER BY
              CASE WHEN order_method = 'geometry' THEN SpatialSliceCoordinate END NULLS LAST,
              CASE WHEN order_method <> 'path_fallback' THEN InstanceNumber END NULLS LAST,
              dicom_path) - 1 AS position FROM me)
"""
SERIES_SQL = ORDERED_SQL + """,
man AS (SELECT StudyInstanceUID, SeriesInstanceUID, CAST(max(n) AS BIGINT) AS slice_count,
    CAST(max(sops) AS BIGINT) AS unique_sop_count,
    round(max(located) / max(n), 6) AS geometry_slice_fraction,
    round(max(numbered) / max(n), 6) AS instance_number_fraction,
    bool_or(located = n AND places = n) AS geometry_reliably_orderable,
    bool_or(numbered = n AND numbers = n) AS instance_reliably_orderable,
    max(order_method) AS order_method,
    string_agg(dicom_path, '|' ORDER BY position) AS paths,
    string_agg(coalesce(CAST(InstanceNumber AS VARCHAR), '-'), '|' ORDER BY position) AS instances,
    arg_min(PatientID, dicom_path) FILTER (WHERE PatientID IS NOT NULL) AS PatientID,
    arg_min(AccessionNumber, dicom_path) AS AccessionNumber,
    arg_min(Manufacturer, dicom_path) FILTER (WHERE Manufacturer IS NOT NULL) AS Manufacturer,
    arg_min(ManufacturerModelName, dicom_path) AS ManufacturerModelName,
    arg_min(MagneticFieldStrength, dicom_path) AS MagneticFieldStrength
  FROM pos GROUP BY 1, 2),
manifest AS (SELECT man.*, Fluid_Sensitive, Fat_Suppression, Anatomical_Plane FROM man
  LEFT JOIN descriptors d ON man.StudyInstanceUID = d.StudyInstanceUID AND man.SeriesInstanceUID = d.SeriesInstanceUID)
"""


def slices(spark, sf_dir):
    return load(spark, sf_dir, "slices")


def manifest(spark, sf_dir):
    return M.series_manifest(slices(spark, sf_dir), load(spark, sf_dir, "descriptors"))


@query(
    with_views(
        "slices",
        "WITH " + ORDERED_SQL.strip()
        + " SELECT StudyInstanceUID, SeriesInstanceUID, dicom_path, order_method, CAST(position AS BIGINT) AS position FROM pos",
    )
)
def order_children(spark, sf_dir):
    ordered = M.order_children(slices(spark, sf_dir))
    return M.child_positions(ordered).select(*M.KEYS, "dicom_path", "order_method", "position")


@query(
    with_views(
        "slices descriptors",
        "WITH " + SERIES_SQL.strip() + """ SELECT StudyInstanceUID, SeriesInstanceUID, slice_count, unique_sop_count,
        geometry_slice_fraction, instance_number_fraction, geometry_reliably_orderable,
        instance_reliably_orderable, order_method, paths, instances, PatientID, AccessionNumber,
        Manufacturer, ManufacturerModelName, MagneticFieldStrength, Fluid_Sensitive, Fat_Suppression,
        Anatomical_Plane FROM manifest""",
    )
)
def series_manifest(spark, sf_dir):
    numbers = F.transform("ordered_instance_numbers", lambda v: F.coalesce(v.cast("string"), F.lit("-")))
    return (
        manifest(spark, sf_dir)
        .withColumns(
            {
                "paths": F.array_join("ordered_dicom_paths", "|"),
                "instances": F.array_join(numbers, "|"),
                "geometry_slice_fraction": F.round("geometry_slice_fraction", 6),
                "instance_number_fraction": F.round("instance_number_fraction", 6),
            }
        )
        .drop(
            "chunk", "ordered_dicom_paths", "ordered_slice_coordinates", "ordered_instance_numbers"
        )
    )


@query(
    with_views(
        "slices",
        """SELECT StudyInstanceUID, count(DISTINCT SeriesInstanceUID) AS series_count, count(*) AS slice_count,
        count(DISTINCT SOPInstanceUID) AS unique_sop_count,
        round(avg(CASE WHEN SpatialSliceCoordinate IS NULL THEN 0 ELSE 1 END), 6) AS geometry_slice_fraction
        FROM slices GROUP BY 1""",
    )
)
def study_inventory(spark, sf_dir):
    return M.study_inventory(slices(spark, sf_dir)).withColumn(
        "geometry_slice_fraction", F.round("geometry_slice_fraction", 6)
    )


def _json_set(column):
    text = f"CAST({column} AS VARCHAR)"
    return (
        f"'[' || coalesce(string_agg(DISTINCT '\"' || {text} || '\"', ',' ORDER BY '\"' || {text} || '\"')"
        f" FILTER (WHERE {column} IS NOT NULL), '') || ']'"
    )


@query(
    with_views(
        "slices descriptors",
        "WITH " + SERIES_SQL.strip() + f""" SELECT StudyInstanceUID, count(DISTINCT SeriesInstanceUID) AS series_count,
        CAST(sum(slice_count) AS BIGINT) AS slice_count,
        round(avg(CASE WHEN geometry_reliably_orderable THEN 1 ELSE 0 END), 6) AS geometry_orderable_series_fraction,
        arg_min(PatientID, SeriesInstanceUID) FILTER (WHERE PatientID IS NOT NULL) AS PatientID,
        arg_min(AccessionNumber, SeriesInstanceUID) AS AccessionNumber,
        {_json_set("Manufacturer")} AS manufacturers, {_json_set("ManufacturerModelName")} AS manufacturer_models,
        {_json_set("MagneticFieldStrength")} AS field_strengths, {_json_set("Anatomical_Plane")} AS anatomical_planes,
        {_json_set("Fluid_Sensitive")} AS fluid_sensitive_values, {_json_set("Fat_Suppression")} AS fat_suppression_values
        FROM manifest GROUP BY 1""",
    )
)
def extended_inventory(spark, sf_dir):
    return M.extended_inventory(manifest(spark, sf_dir)).withColumn(
        "geometry_orderable_series_fraction", F.round("geometry_orderable_series_fraction", 6)
    )


@query(
    with_views(
        "slices",
        """WITH s AS (SELECT 'PatientID' AS "column", PatientID AS value FROM slices
                      UNION ALL SELECT 'AccessionNumber', AccessionNumber FROM slices),
        c AS (SELECT "column", value, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT "column", CAST(sum(n) FILTER (WHERE value IS NOT NULL) AS BIGINT) AS non_null_studies,
        count(value) AS unique_values,
        count(*) FILTER (WHERE value IS NOT NULL AND n > 1) AS values_shared_across_studies,
        CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL AND n > 1), 0) AS BIGINT) AS studies_in_shared_groups,
        max(n) FILTER (WHERE value IS NOT NULL) AS maximum_studies_per_value FROM c GROUP BY 1""",
    )
)
def grouping_audit(spark, sf_dir):
    return A.grouping_audit(slices(spark, sf_dir))


@query(
    with_views(
        "slices",
        """WITH s AS (SELECT 'StudyInstanceUID' AS "column", StudyInstanceUID AS value FROM slices
            UNION ALL SELECT 'SeriesInstanceUID', SeriesInstanceUID FROM slices
            UNION ALL SELECT 'SOPInstanceUID', SOPInstanceUID FROM slices),
        c AS (SELECT "column", value, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT "column", CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows FROM c GROUP BY 1""",
    )
)
def duplicate_ids(spark, sf_dir):
    return A.duplicate_ids(slices(spark, sf_dir))


SLICE_COLUMNS = (
    "StudyInstanceUID SeriesInstanceUID SOPInstanceUID dicom_path file_size_bytes InstanceNumber "
    "SpatialSliceCoordinate PatientID AccessionNumber Manufacturer ManufacturerModelName "
    "MagneticFieldStrength"
).split()


@query(
    with_views(
        "slices",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
            round((count(*) - count({c})) / count(*), 6) AS missing_fraction FROM slices"""
            for c in SLICE_COLUMNS
        ),
    )
)
def missingness(spark, sf_dir):
    return A.missingness(slices(spark, sf_dir)).withColumn(
        "missing_fraction", F.round("missing_fraction", 6)
    )


@query(
    with_views(
        "slices",
        """WITH c AS (SELECT SeriesInstanceUID, count(*) AS n FROM slices GROUP BY 1)
        SELECT count(*) AS series_count, min(n) AS min, quantile_cont(n, 0.5) AS median, max(n) AS max FROM c""",
    )
)
def group_size_distribution(spark, sf_dir):
    return A.group_size_distribution(slices(spark, sf_dir))


@query(
    with_views(
        "slices",
        """WITH c AS (SELECT SeriesInstanceUID, count(*) AS size FROM slices GROUP BY 1)
        SELECT size, count(*) AS frequency FROM c GROUP BY 1""",
    )
)
def group_size_frequency(spark, sf_dir):
    return A.group_size_frequency(slices(spark, sf_dir))


@query(
    with_views(
        "slices",
        """WITH s AS (SELECT 'Manufacturer' AS "column", Manufacturer AS value FROM slices
            UNION ALL SELECT 'ManufacturerModelName', ManufacturerModelName FROM slices
            UNION ALL SELECT 'MagneticFieldStrength', CAST(MagneticFieldStrength AS VARCHAR) FROM slices)
        SELECT "column", coalesce(value, '<missing>') AS value, count(*) AS n FROM s GROUP BY 1, 2""",
    )
)
def value_distributions(spark, sf_dir):
    return A.value_distributions(slices(spark, sf_dir))


@query(
    with_views(
        "slices",
        """WITH g AS (SELECT SeriesInstanceUID, count(*) AS n, count(SpatialSliceCoordinate) AS p,
                      count(DISTINCT SpatialSliceCoordinate) AS u FROM slices GROUP BY 1)
        SELECT count(*) FILTER (WHERE p = n) AS series_with_all_coordinates,
               count(*) FILTER (WHERE u = n) AS series_with_unique_coordinates,
               count(*) FILTER (WHERE p = n AND u = n) AS series_reliably_orderable,
               count(*) AS series_total FROM g""",
    )
)
def ordering_reliability(spark, sf_dir):
    return A.ordering_reliability(slices(spark, sf_dir))


@query(
    with_views(
        "slices",
        """SELECT count(*) AS dicom_count, count(DISTINCT StudyInstanceUID) AS study_count,
        count(DISTINCT SeriesInstanceUID) AS series_count, count(DISTINCT SOPInstanceUID) AS sop_count,
        count(DISTINCT PatientID) AS patient_count_if_recoverable FROM slices""",
    )
)
def totals(spark, sf_dir):
    return A.totals(slices(spark, sf_dir))


@query(
    with_views(
        "slices",
        """SELECT CAST(len(string_split(dicom_path, '/')) AS INT) AS depth, count(*) AS n FROM slices GROUP BY 1""",
    )
)
def path_depth(spark, sf_dir):
    return A.path_depths(slices(spark, sf_dir))


@query(
    with_views(
        "slices descriptors",
        "WITH " + SERIES_SQL.strip() + " SELECT order_method, count(*) AS n FROM manifest GROUP BY 1",
    )
)
def order_methods(spark, sf_dir):
    return A.order_methods(M.order_children(slices(spark, sf_dir)))


@query(
    with_views(
        "slices descriptors",
        "WITH " + SERIES_SQL.strip() + " "
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
            round((count(*) - count({c})) / count(*), 6) AS missing_fraction FROM manifest"""
            for c in ("Fluid_Sensitive", "Fat_Suppression", "Anatomical_Plane")
        ),
    )
)
def descriptor_missingness(spark, sf_dir):
    return A.descriptor_missingness(manifest(spark, sf_dir)).withColumn(
        "missing_fraction", F.round("missing_fraction", 6)
    )


@query(
    with_views(
        "slices",
        "WITH " + ORDERED_SQL.strip()
        + """ SELECT count(DISTINCT StudyInstanceUID) AS study_count,
        count(DISTINCT StudyInstanceUID || '/' || SeriesInstanceUID) AS series_count, count(*) AS slice_count,
        CAST(0 AS BIGINT) AS empty_series_count,
        count(DISTINCT CASE WHEN order_method = 'geometry' THEN StudyInstanceUID || '/' || SeriesInstanceUID END)
          AS geometry_ordered_series, CAST(0 AS BIGINT) AS failed_header_count FROM pos""",
    )
)
def manifest_audit(spark, sf_dir):
    return M.manifest_audit(M.order_children(slices(spark, sf_dir)))


@query(
    with_views(
        "geometry",
        """SELECT SeriesInstanceUID,
        round((orientation[2]*orientation[6]-orientation[3]*orientation[5])*position[1]
            + (orientation[3]*orientation[4]-orientation[1]*orientation[6])*position[2]
            + (orientation[1]*orientation[5]-orientation[2]*orientation[4])*position[3], 6) AS projected FROM geometry""",
    )
)
def projected_coordinate(spark, sf_dir):
    return load(spark, sf_dir, "geometry").select(
        "SeriesInstanceUID",
        F.round(G.projected_coordinate(F.col("orientation"), F.col("position")), 6).alias("projected"),
    )


NORMAL_SQL = """
n AS (SELECT SeriesInstanceUID, position,
        orientation[2]*orientation[6]-orientation[3]*orientation[5] AS x,
        orientation[3]*orientation[4]-orientation[1]*orientation[6] AS y,
        orientation[1]*orientation[5]-orientation[2]*orientation[4] AS z FROM geometry),
u AS (SELECT *, sqrt(x*x+y*y+z*z) AS norm FROM n)
"""


@query(
    with_views(
        "geometry",
        "WITH " + NORMAL_SQL.strip() + """ SELECT SeriesInstanceUID, round(x/norm, 6) AS nx, round(y/norm, 6) AS ny,
        round(z/norm, 6) AS nz, round((x*position[1]+y*position[2]+z*position[3])/norm, 6) AS along FROM u""",
    )
)
def unit_normal(spark, sf_dir):
    normal = G.unit_normal(F.col("orientation"))
    return load(spark, sf_dir, "geometry").select(
        "SeriesInstanceUID",
        *[F.round(F.get(normal, F.lit(i)), 6).alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
        F.round(G.unit_coordinate(F.col("orientation"), F.col("position")), 6).alias("along"),
    )


@query(
    with_views(
        "geometry",
        "WITH " + NORMAL_SQL.strip() + """, s AS (SELECT SeriesInstanceUID, abs(x/norm) AS s, abs(y/norm) AS c, abs(z/norm) AS a FROM u)
        SELECT SeriesInstanceUID, CASE WHEN s IS NULL THEN 'Unknown' WHEN greatest(s,c,a) < cos(radians(35)) THEN 'Oblique'
        WHEN s = greatest(s,c,a) THEN 'Sagittal' WHEN c = greatest(s,c,a) THEN 'Coronal' ELSE 'Axial' END AS plane FROM s""",
    )
)
def infer_plane(spark, sf_dir):
    return load(spark, sf_dir, "geometry").select(
        "SeriesInstanceUID", G.infer_plane(F.col("orientation")).alias("plane")
    )


@query(
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' left' WHEN 1 THEN 'R' WHEN 2 THEN o_orderstatus END AS image,
         CASE o_orderkey % 3 WHEN 0 THEN 'L ' WHEN 1 THEN 'RIGHT' END AS lat FROM orders),
       n AS (SELECT o_orderkey, CASE WHEN upper(trim(image)) IN ('L','LEFT') THEN 'L' WHEN upper(trim(image)) IN ('R','RIGHT') THEN 'R' END AS a,
         CASE WHEN upper(trim(lat)) IN ('L','LEFT') THEN 'L' WHEN upper(trim(lat)) IN ('R','RIGHT') THEN 'R' END AS b FROM t)
       SELECT o_orderkey, CASE WHEN a <> b THEN NULL ELSE coalesce(a, b) END AS side,
         CASE WHEN a <> b THEN 'conflicting_tags' WHEN a = b THEN 'ImageLaterality+Laterality'
              WHEN a IS NOT NULL THEN 'ImageLaterality' WHEN b IS NOT NULL THEN 'Laterality' ELSE 'unavailable' END AS source
       FROM n"""
)
def resolve_side(spark, sf_dir):
    key = F.col("o_orderkey")
    tags = {
        "ImageLaterality": F.when(key % 4 == 0, " left").when(key % 4 == 1, "R").when(
            key % 4 == 2, F.col("o_orderstatus")
        ),
        "Laterality": F.when(key % 3 == 0, "L ").when(key % 3 == 1, "RIGHT"),
    }
    return (
        load(spark, sf_dir, "orders")
        .select("o_orderkey", G.resolve_side(tags).alias("r"))
        .select("o_orderkey", "r.side", "r.source")
    )


@query(
    with_views(
        "descriptors",
        """SELECT StudyInstanceUID, SeriesInstanceUID, lower(coalesce(Anatomical_Plane, 'unknown'))
        || CASE WHEN Fluid_Sensitive = 1 THEN '_fluid' ELSE '_nonfluid' END
        || CASE WHEN Fat_Suppression = 1 THEN '_fs' ELSE '_nonfs' END AS category FROM descriptors""",
    )
)
def categorize(spark, sf_dir):
    return load(spark, sf_dir, "descriptors").select(
        *M.KEYS,
        S.categorize(F.col("Anatomical_Plane"), F.col("Fluid_Sensitive"), F.col("Fat_Suppression")).alias(
            "category"
        ),
    )


SCORED_SQL = SERIES_SQL + """,
scored AS (SELECT *, 0.0
   + CASE WHEN Anatomical_Plane IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN Fluid_Sensitive = 1 THEN 2 ELSE 0 END
   + CASE WHEN Fat_Suppression = 1 THEN 1 ELSE 0 END + CASE WHEN slice_count BETWEEN 12 AND 96 THEN 1 ELSE 0 END
   - CASE WHEN slice_count < 3 THEN 5 ELSE 0 END + CASE WHEN geometry_reliably_orderable THEN 1 ELSE 0 END AS score,
   concat_ws('+', CASE WHEN Anatomical_Plane IS NOT NULL THEN 'preferred_plane' END,
     CASE WHEN Fluid_Sensitive = 1 THEN 'fluid_sensitive' END, CASE WHEN Fat_Suppression = 1 THEN 'fat_suppression' END,
     CASE WHEN slice_count BETWEEN 12 AND 96 THEN 'typical_slice_count' END,
     CASE WHEN slice_count < 3 THEN 'too_few_slices' END,
     CASE WHEN geometry_reliably_orderable THEN 'geometry_orderable' END) AS reasons FROM manifest)
"""


@query(
    with_views(
        "slices descriptors",
        "WITH " + SCORED_SQL.strip()
        + " SELECT StudyInstanceUID, SeriesInstanceUID, CAST(score AS DOUBLE) AS score, reasons FROM scored",
    )
)
def score_children(spark, sf_dir):
    return M.score_children(manifest(spark, sf_dir)).select(
        *M.KEYS, "score", F.array_join("reasons", "+").alias("reasons")
    )


SELECTED_SQL = SCORED_SQL + """,
pl AS (SELECT *, CASE Anatomical_Plane WHEN 'Sagittal' THEN 0 WHEN 'Coronal' THEN 1 WHEN 'Axial' THEN 2 END AS turn FROM scored),
rk AS (SELECT *, row_number() OVER (PARTITION BY StudyInstanceUID, turn ORDER BY score DESC, SeriesInstanceUID) AS rk FROM pl),
sl AS (SELECT *, row_number() OVER (PARTITION BY StudyInstanceUID ORDER BY
        CASE WHEN turn IS NOT NULL AND rk = 1 THEN turn ELSE 3 END, score DESC, SeriesInstanceUID) AS slot FROM rk),
selected AS (SELECT * FROM sl WHERE slot <= 3)
"""


@query(
    with_views(
        "slices descriptors",
        "WITH " + SELECTED_SQL.strip()
        + " SELECT StudyInstanceUID, SeriesInstanceUID, CAST(score AS DOUBLE) AS score, CAST(slot AS INT) AS slot FROM selected",
    )
)
def select_children(spark, sf_dir):
    scored = M.score_children(manifest(spark, sf_dir))
    return M.select_per_category(scored).select(*M.KEYS, "score", "slot")


@query(
    with_views(
        "slices descriptors",
        "WITH " + SELECTED_SQL.strip() + """,
        ctr AS (SELECT s.StudyInstanceUID, s.SeriesInstanceUID, s.Anatomical_Plane, slice_count, string_split(paths, '|') AS p, i,
              CASE WHEN i = 3 THEN slice_count - 1 ELSE CAST(round_even(i * ((slice_count - 1) / 3.0), 0) AS BIGINT) END AS c
            FROM selected s, range(4) r(i)),
        st AS (SELECT *, row_number() OVER (PARTITION BY StudyInstanceUID ORDER BY SeriesInstanceUID, i) - 1 AS slot FROM ctr),
        pad AS (SELECT StudyInstanceUID, k AS slot FROM (SELECT DISTINCT StudyInstanceUID FROM selected) x, range(12) y(k))
        SELECT pad.StudyInstanceUID, CAST(pad.slot AS INT) AS slot,
          coalesce(p[greatest(c-1,0)+1] || '|' || p[c+1] || '|' || p[least(c+1,slice_count-1)+1], '') AS paths,
          CASE Anatomical_Plane WHEN 'Sagittal' THEN 1 WHEN 'Coronal' THEN 2 WHEN 'Axial' THEN 3 ELSE 0 END AS plane,
          st.slot IS NOT NULL AS valid
        FROM pad LEFT JOIN st ON pad.StudyInstanceUID = st.StudyInstanceUID AND pad.slot = st.slot""",
    )
)
def sampling_plan(spark, sf_dir):
    chosen = M.select_per_category(M.score_children(manifest(spark, sf_dir)))
    return M.sampling_plan(chosen).withColumn("paths", F.array_join("paths", "|"))


@query()
def sampling_plan_random(spark, sf_dir):
    chosen = M.select_per_category(M.score_children(manifest(spark, sf_dir)))
    return M.sampling_plan(chosen, random_seed=20260812).withColumn(
        "paths", F.array_join("paths", "|")
    )


@query(
    with_views(
        "slices",
        """WITH m AS (SELECT count(DISTINCT StudyInstanceUID) AS studies, count(DISTINCT StudyInstanceUID || '/' || SeriesInstanceUID) AS series FROM slices),
        r(representation, bytes_per_pixel) AS (VALUES ('fp32', 4), ('fp16', 2), ('uint16', 2), ('uint8', 1))
        SELECT representation, studies, round(series / studies, 6) AS series_per_study, bytes_per_pixel,
          CAST(series * 16 * 224 * 224 * bytes_per_pixel AS BIGINT) AS estimated_bytes,
          round(series * 16 * 224 * 224 * bytes_per_pixel / 1073741824.0, 6) AS estimated_gib FROM m, r""",
    )
)
def cache_estimate(spark, sf_dir):
    ordered = slices(spark, sf_dir).select(*M.KEYS).distinct()
    return M.cache_estimate(ordered, slices_per_series=16, height=224, width=224).withColumns(
        {
            "series_per_study": F.round("series_per_study", 6),
            "estimated_gib": F.round("estimated_gib", 6),
        }
    )
