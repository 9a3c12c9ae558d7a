"""Views over the driver's tables.

Each view is one SQL text that both engines run, so a query and its SQL twin start from the same
rows. Array literals are written ``array(...)`` and turned into DuckDB's ``list_value(...)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cohort_spark.functions.lexicon import TERMS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TERMS = [term for terms in TERMS.values() for term in terms]
_FORMS = ("{} tear of the knee and the joint", "no {} in the knee joint and the rest", "the {} of the knee is intact and the joint", "possible {} of the knee and the joint",
    "{} of the knee and the joint, findings", "sin {} de la rodilla, hallazgos", "{} rupture; {} again, the knee and the joint", "knee{} and joint, the findings of the knee")


def _clinical(number: str) -> str:
    """A sentence with one of the default terms, by number, in one of some forms."""
    plain = lambda text: "concat('" + text.replace("'", "', chr(39), '") + "', '')"
    terms = " ".join(f"WHEN {i} THEN {plain(t)}" for i, t in enumerate(_TERMS))
    forms = " ".join(f"WHEN {i} THEN '{f.replace('{}', '%')}'" for i, f in enumerate(_FORMS))
    term = f"CASE {number} % {len(_TERMS)} {terms} END"
    form = f"CASE CAST(floor({number} / {len(_TERMS)}) AS BIGINT) % {len(_FORMS)} {forms} END"
    return f"replace({form}, '%', {term})"


VIEWS: dict[str, str] = {
    # Texts of one line, each with a sentence that has a term of the default lexicon.
    "knee_reports": f"""
        SELECT doc_id, lang, source, concat(coalesce(text, ''), chr(10), {_clinical("doc_id")}, '.') AS text FROM documents""",
    # One row per file header.
    "slices": """
        SELECT concat('study-', CAST(o_custkey AS STRING)) AS StudyInstanceUID,
               concat('series-', CAST(l_orderkey AS STRING)) AS SeriesInstanceUID,
               concat('sop-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
                      CAST(l_partkey AS STRING)) AS SOPInstanceUID,
               concat('study-', CAST(o_custkey AS STRING), '/series-', CAST(l_orderkey AS STRING), '/',
                      CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
                      CAST(l_linenumber AS STRING), '-',
                      CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), '.dcm') AS dicom_path,
               CAST(round(l_extendedprice) AS BIGINT) AS file_size_bytes,
               CASE WHEN l_quantity > 48 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS InstanceNumber,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS SpatialSliceCoordinate,
               CASE WHEN o_custkey % 11 = 0 THEN NULL
                    ELSE concat('patient-', CAST(o_custkey % 700 AS STRING)) END AS PatientID,
               concat('acc-', CAST(o_custkey AS STRING)) AS AccessionNumber,
               CASE WHEN l_quantity < 3 THEN NULL ELSE p_brand END AS Manufacturer,
               p_type AS ManufacturerModelName,
               CASE WHEN p_size % 2 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(3.0 AS DOUBLE) END
                    AS MagneticFieldStrength
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    # One row per (study, series); some series have no slices.
    "descriptors": """
        SELECT concat('study-', CAST(o_custkey AS STRING)) AS StudyInstanceUID,
               concat('series-', CAST(o_orderkey AS STRING)) AS SeriesInstanceUID,
               CASE o_orderkey % 5 WHEN 0 THEN 'Sagittal' WHEN 1 THEN 'Coronal' WHEN 2 THEN 'Axial'
                    WHEN 3 THEN 'Sagittal' ELSE NULL END AS Anatomical_Plane,
               CAST(o_orderkey % 2 AS INT) AS Fluid_Sensitive,
               CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS Fat_Suppression
        FROM orders""",
    # Orientation and position arrays, with oblique and missing ones.
    "geometry": """
        SELECT concat('series-', CAST(o_orderkey AS STRING)) AS SeriesInstanceUID,
               CASE o_orderkey % 5
                    WHEN 0 THEN array(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
                                      CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE))
                    WHEN 1 THEN array(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE),
                                      CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE))
                    WHEN 2 THEN array(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
                                      CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE))
                    WHEN 3 THEN array(CAST(0.7071 AS DOUBLE), CAST(0.7071 AS DOUBLE), CAST(0 AS DOUBLE),
                                      CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE))
                    ELSE NULL END AS orientation,
               array(o_totalprice / CAST(1000 AS DOUBLE), CAST(o_orderkey % 97 AS DOUBLE),
                     CAST(7.5 AS DOUBLE)) AS position
        FROM orders""",
    # Wide predictions with sparse gold; quality scores nearly unique, toxic heavily tied.
    "oof": """
        SELECT concat('doc-', CAST(d.doc_id AS STRING)) AS StudyInstanceUID,
               CAST(d.doc_id % 5 AS INT) AS fold,
               CASE d.doc_id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE NULL END AS PatientSex,
               concat('group-', CAST(d.doc_id % 173 AS STRING)) AS leakage_group,
               CAST(l.quality AS DOUBLE) AS quality__gold,
               CAST(l.toxic AS DOUBLE) AS toxic__gold,
               ((d.doc_id * 37 + 11) % 997) / CAST(996 AS DOUBLE) AS quality__prediction,
               ((d.doc_id * 53 + 7) % 89) / CAST(88 AS DOUBLE) AS toxic__prediction
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # Two weak sources per target.
    "semantic_labels": """
        SELECT concat('doc-', CAST(doc_id AS STRING)) AS StudyInstanceUID, lang AS language,
               ((doc_id * 29 + 3) % 101) / CAST(100 AS DOUBLE) AS quality__semantic_probability,
               CASE doc_id % 4 WHEN 0 THEN CAST(0.05 AS DOUBLE) WHEN 1 THEN CAST(0.95 AS DOUBLE)
                    ELSE CAST(0.5 AS DOUBLE) END AS quality__rule_probability,
               ((doc_id * 31 + 5) % 103) / CAST(102 AS DOUBLE) AS toxic__semantic_probability,
               CASE doc_id % 7 WHEN 0 THEN CAST(0.95 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE)
                    ELSE CAST(0.05 AS DOUBLE) END AS toxic__rule_probability
        FROM documents""",
    # Gold table of the cohort: one row per study with sparse labels.
    "train": """
        SELECT concat('doc-', CAST(d.doc_id AS STRING)) AS StudyInstanceUID,
               CASE d.doc_id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE NULL END AS PatientSex,
               d.text AS Report,
               CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # Study inventory of the cohort; patients are shared, blank or missing.
    "inventory": """
        SELECT concat('doc-', CAST(doc_id AS STRING)) AS StudyInstanceUID,
               CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN ' '
                    ELSE concat('patient-', CAST(doc_id % 157 AS STRING)) END AS PatientID,
               n_chars AS slice_count
        FROM documents""",
    # Three models' scores, one row per (model, study, target).
    "models": """
        SELECT 'a' AS model, concat('doc-', CAST(doc_id AS STRING)) AS StudyInstanceUID, 'quality' AS target,
               ((doc_id * 37 + 11) % 997) / CAST(996 AS DOUBLE) AS score FROM documents
        UNION ALL SELECT 'b', concat('doc-', CAST(doc_id AS STRING)), 'quality',
               ((doc_id * 41 + 5) % 499) / CAST(498 AS DOUBLE) FROM documents
        UNION ALL SELECT 'c', concat('doc-', CAST(doc_id AS STRING)), 'quality',
               ((doc_id * 17 + 3) % 61) / CAST(60 AS DOUBLE) FROM documents
        UNION ALL SELECT 'a', concat('doc-', CAST(doc_id AS STRING)), 'toxic',
               ((doc_id * 53 + 7) % 89) / CAST(88 AS DOUBLE) FROM documents
        UNION ALL SELECT 'b', concat('doc-', CAST(doc_id AS STRING)), 'toxic',
               ((doc_id * 59 + 2) % 701) / CAST(700 AS DOUBLE) FROM documents
        UNION ALL SELECT 'c', concat('doc-', CAST(doc_id AS STRING)), 'toxic',
               ((doc_id * 23 + 9) % 113) / CAST(112 AS DOUBLE) FROM documents""",
    # Gold in long form for the same studies.
    "gold": """
        SELECT concat('doc-', CAST(d.doc_id AS STRING)) AS StudyInstanceUID, CAST(d.doc_id % 5 AS INT) AS fold,
               'quality' AS target, CAST(l.quality AS DOUBLE) AS gold
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT concat('doc-', CAST(d.doc_id AS STRING)), CAST(d.doc_id % 5 AS INT), 'toxic', CAST(l.toxic AS DOUBLE)
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # Raw record text, one JSON object each; the records of one event type lost their end.
    "raw_records": """
        SELECT concat('events/', event_type, '/', CAST(event_id AS STRING), '.json') AS path,
               CASE WHEN event_type = 'error' THEN replace(props, '}', '') ELSE props END AS body
        FROM events""",
    # Values of mixed form for typed ingestion.
    "tag_values": """
        SELECT event_id, event_type AS AsText,
               CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '-3.9' WHEN 2 THEN 'Infinity'
                    WHEN 3 THEN event_type ELSE CAST(event_id AS STRING) END AS AsInteger,
               CASE event_id % 5 WHEN 0 THEN '-Infinity' WHEN 1 THEN event_type
                    WHEN 2 THEN NULL ELSE CAST(event_id AS STRING) END AS AsFloat,
               array(event_id % 7, event_id % 3) AS AsList,
               value AS Measured
        FROM events""",
    # Sentence vectors per report, and two prompts per target.
    "sentence_vectors": """
        SELECT concat('report-', CAST(vec_id % 50 AS STRING)) AS StudyInstanceUID,
               vec_id AS sentence, embedding AS vector
        FROM embeddings""",
    "prompts": """
        SELECT concat('target-', CAST(e.label AS STRING)) AS target,
               CASE WHEN e.vec_id = f.lo THEN 'positive' ELSE 'negative' END AS polarity, e.embedding AS vector
        FROM embeddings e
        JOIN (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label) f
          ON e.label = f.label AND (e.vec_id = f.lo OR e.vec_id = f.hi)""",
    # Feature slots per study, with invalid ones.
    "feature_slots": """
        SELECT concat('doc-', CAST(vec_id % 100 AS STRING)) AS StudyInstanceUID,
               CAST(floor(vec_id / 100) AS INT) AS slot, CAST(label % 4 AS INT) AS plane,
               (vec_id % 9 <> 0) AS valid, embedding AS feature
        FROM embeddings""",
    # Reports with two explicit section headers around the whole text.
    "reports": """
        SELECT doc_id, lang, source,
               concat(lang, ' findings : ', text, chr(10), chr(10), 'Impression:', chr(9), source) AS text
        FROM documents""",
    "measurements": """
        SELECT concat('user-', CAST(user_id AS STRING)) AS unit, event_id,
               CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
        FROM events""",
    # Units asked for and units with files.
    "requested": "SELECT concat('study-', CAST(doc_id AS STRING)) AS unit FROM documents",
    "completed": "SELECT concat('study-', CAST(doc_id AS STRING)) AS unit FROM labels",
    # Parts of one extraction run: declared and found row counts per market segment.
    "run_manifest": """
        SELECT c_mktsegment AS run, count(*) AS declared_parts,
               min(c_acctbal) < -990 AS complete
        FROM customer GROUP BY c_mktsegment""",
    "run_parts": """
        SELECT c_mktsegment AS run, concat('part-', CAST(c_custkey AS STRING), '.parquet') AS part
        FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
           OR c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    # Delivery: the sample's order is not the predictions' order.
    "sample": """
        SELECT concat('doc-', CAST(doc_id AS STRING)) AS StudyInstanceUID,
               (doc_id * 7919) % 1000003 AS position FROM documents""",
    # Leaderboard: one score per experiment, with ties.
    "experiments": """
        SELECT source AS experiment, round(avg(n_chars % 10), 0) / 10 AS macro_auc
        FROM documents GROUP BY source""",
    # External labels for the cohort's studies, in their own order and naming.
    "external": """
        SELECT concat('doc-', CAST(doc_id AS STRING)) AS uid,
               ((doc_id * 29 + 3) % 101) / CAST(100 AS DOUBLE) AS quality,
               ((doc_id * 31 + 5) % 103) / CAST(102 AS DOUBLE) AS toxic FROM documents""",
}

# Views that use other views.
DEPENDS: dict[str, tuple[str, ...]] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over the driver tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for table in used:
        text = re.sub(rf"(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)
    frames = {t: load(spark, sf_dir, t) for t in used if f"{{{t}}}" in text}
    return spark.sql(text, **frames)


def duck(name: str) -> str:
    """The view as a DuckDB common table expression body."""
    return re.sub(r"\barray\(", "list_value(", VIEWS[name]).replace("AS STRING", "AS VARCHAR")


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views, then the body; a body may itself start with further CTEs."""
    ctes = ",\n".join(f"{n} AS ({duck(n)})" for n in names.split())
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
