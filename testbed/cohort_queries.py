"""Cohort construction, folds, calibration, vectors and table audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.core import durable, to_long, to_wide
from cohort_spark.functions import arrays as R
from cohort_spark.operators import audit as A
from cohort_spark.operators import blending as B
from cohort_spark.operators import calibration as P
from cohort_spark.operators import cohort as C
from cohort_spark.operators import features as V
from cohort_spark.operators import folds as K
from testbed.evaluation_queries import FUSION_SQL, ID, TARGETS, fusion_rows, predictions, rounded
from testbed.registry import query
from testbed.views import load, with_views

WEAK_SQL = """
wk AS (SELECT t.StudyInstanceUID, 'quality' AS target, t.quality AS gold, s.quality__semantic_probability AS semantic,
         s.quality__rule_probability AS rule FROM train t JOIN semantic_labels s ON t.StudyInstanceUID = s.StudyInstanceUID
       UNION ALL SELECT t.StudyInstanceUID, 'toxic', t.toxic, s.toxic__semantic_probability, s.toxic__rule_probability
         FROM train t JOIN semantic_labels s ON t.StudyInstanceUID = s.StudyInstanceUID),
wm AS (SELECT *, 0.5 * semantic + 0.5 * rule AS weak FROM wk),
sh AS (SELECT target AS tg, count(*) AS n, least(greatest(coalesce(avg(gold), 0.5), 0.02), 0.98) AS share FROM wm GROUP BY 1),
pr AS (SELECT wm.*, coalesce(gold, weak) AS train_value,
   coalesce(CAST(gold AS INT), CASE WHEN row_number() OVER (PARTITION BY target ORDER BY weak, StudyInstanceUID) / CAST(n AS DOUBLE) >= 1.0 - share THEN 1 ELSE 0 END) AS proxy
   FROM wm JOIN sh ON target = tg)
"""


def weak(spark, sf_dir):
    train = load(spark, sf_dir, "train").drop("Report")
    return C.weak_rows(train, load(spark, sf_dir, "semantic_labels"), TARGETS)


@query(
    with_views(
        "train semantic_labels",
        "WITH " + WEAK_SQL.strip()
        + " SELECT StudyInstanceUID, target, gold, round(weak, 6) AS weak, round(train_value, 6) AS train, proxy FROM pr",
    )
)
def stratify_proxy(spark, sf_dir):
    marked = C.stratify_proxy(weak(spark, sf_dir))
    return rounded(marked.select(ID, "target", "gold", "weak", "train", "proxy"), "weak", "train")


GROUP_SQL = r"""
iv AS (SELECT *, nullif(trim(PatientID), '') AS p FROM inventory),
ig AS (SELECT *, coalesce(p, 'study::' || StudyInstanceUID) AS g FROM iv),
dc AS (SELECT max(c) > 1 AND count(*) >= 5 AS by_patient FROM (SELECT g, count(p) AS c FROM ig GROUP BY 1)),
gp AS (SELECT ig.*, CASE WHEN by_patient THEN g ELSE StudyInstanceUID END AS leakage_group,
   CASE WHEN by_patient THEN 'PatientID' ELSE 'StudyInstanceUID' END AS group_source FROM ig, dc)
"""


@query(
    with_views(
        "inventory",
        "WITH " + GROUP_SQL.strip() + " SELECT StudyInstanceUID, leakage_group, group_source FROM gp",
    )
)
def leakage_group(spark, sf_dir):
    grouped = C.leakage_group(load(spark, sf_dir, "inventory"), min_groups=5)
    return grouped.select(ID, "leakage_group", "group_source")


@query(
    with_views(
        "oof",
        """SELECT leakage_group AS "group", CAST(count(*) AS DOUBLE) AS size, CAST(count(*) FILTER (WHERE quality__gold = 1) AS DOUBLE) AS quality_positive,
        CAST(count(*) FILTER (WHERE toxic__gold = 1) AS DOUBLE) AS toxic_positive, CAST(count(quality__gold) AS DOUBLE) AS quality_observed,
        CAST(count(toxic__gold) AS DOUBLE) AS toxic_observed FROM oof GROUP BY 1""",
    )
)
def group_matrix(spark, sf_dir):
    matrix = K.group_matrix(load(spark, sf_dir, "oof"), "leakage_group", ["quality__gold", "toxic__gold"])
    names = ["quality_positive", "toxic_positive", "quality_observed", "toxic_observed"]
    return matrix.select(
        "group", "size", *[F.get("labels", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


@query()
def assign_folds(spark, sf_dir):
    oof = load(spark, sf_dir, "oof").drop("fold")
    return K.assign_folds(
        oof, group="leakage_group", targets=["quality__gold", "toxic__gold"], n_splits=5
    ).select(ID, "leakage_group", "fold")


@query(
    with_views(
        "oof",
        """SELECT count(*) AS rows, count(DISTINCT leakage_group) AS groups, 5 AS folds, CAST(0 AS BIGINT) AS split_groups, CAST(0 AS BIGINT) AS rows_without_fold,
        TRUE AS better_than_given_folds FROM oof""",
    )
)
def fold_invariants(spark, sf_dir):
    """What holds for any right assignment: whole groups, all rows, all folds, better balance than the given folds."""
    targets = ["quality__gold", "toxic__gold"]
    oof = load(spark, sf_dir, "oof")
    placed = durable(K.assign_folds(oof.drop("fold"), group="leakage_group", targets=targets, n_splits=5))
    groups = placed.groupBy("leakage_group").agg(F.count("*").alias("n"), F.count_if(F.col("fold").isNull()).alias("none"), F.min("fold").alias("low"), F.max("fold").alias("high"))
    objective = lambda df: K.fold_objective(df, targets, n_splits=5).select("objective")
    counted = groups.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("groups"),
        (F.max("high") - F.min("low") + 1).alias("folds"),
        F.count_if(F.col("low") < F.col("high")).alias("split_groups"),
        F.sum("none").alias("rows_without_fold"),
    )
    return counted.withColumn("better_than_given_folds", objective(placed).scalar() < objective(oof).scalar())


@query(
    with_views(
        "oof",
        """WITH l AS (SELECT fold, 0 AS k, count(*) FILTER (WHERE quality__gold = 1) AS x FROM oof GROUP BY 1
            UNION ALL SELECT fold, 1, count(*) FILTER (WHERE toxic__gold = 1) FROM oof GROUP BY 1
            UNION ALL SELECT fold, 2, count(quality__gold) FROM oof GROUP BY 1 UNION ALL SELECT fold, 3, count(toxic__gold) FROM oof GROUP BY 1),
        t AS (SELECT k, sum(x) / 5.0 AS e FROM l GROUP BY 1),
        le AS (SELECT avg(pow((x - e) / greatest(e, 1), 2)) AS label_error FROM l JOIN t ON l.k = t.k),
        s AS (SELECT fold, count(*) AS x FROM oof GROUP BY 1),
        se AS (SELECT avg(pow((x - e) / greatest(e, 1), 2)) AS size_error, 5 - count(*) AS empty_folds FROM s, (SELECT count(*) / 5.0 AS e FROM oof))
        SELECT round(label_error, 6) AS label_error, round(size_error, 6) AS size_error, empty_folds,
        round(label_error + 0.15 * size_error + 1000 * empty_folds, 6) AS objective FROM le, se""",
    )
)
def fold_objective(spark, sf_dir):
    objective = K.fold_objective(
        load(spark, sf_dir, "oof"), ["quality__gold", "toxic__gold"], n_splits=5
    )
    return rounded(objective, "label_error", "size_error", "objective")


def _target_cells(target):
    return f"""
      UNION ALL SELECT fold, 'target', '{target}', 'known_count', CAST(count({target}) AS DOUBLE) FROM oof GROUP BY 1
      UNION ALL SELECT fold, 'target', '{target}', 'positive_count', CAST(count(*) FILTER (WHERE {target} = 1) AS DOUBLE) FROM oof GROUP BY 1
      UNION ALL SELECT fold, 'target', '{target}', 'negative_count', CAST(count(*) FILTER (WHERE {target} = 0) AS DOUBLE) FROM oof GROUP BY 1
      UNION ALL SELECT fold, 'target', '{target}', 'prevalence_among_known', round(avg({target}), 6) FROM oof GROUP BY 1"""


@query(
    with_views(
        "oof",
        """SELECT fold, 'fold' AS section, '' AS name, 'row_count' AS measure, CAST(count(*) AS DOUBLE) AS value FROM oof GROUP BY 1
      UNION ALL SELECT fold, 'fold', '', 'study_count', CAST(count(DISTINCT StudyInstanceUID) AS DOUBLE) FROM oof GROUP BY 1
      UNION ALL SELECT fold, 'fold', '', 'patient_count', CAST(count(DISTINCT leakage_group) AS DOUBLE) FROM oof GROUP BY 1"""
        + _target_cells("quality__gold") + _target_cells("toxic__gold")
        + """ UNION ALL SELECT fold, 'subgroup', 'PatientSex', coalesce(PatientSex, '<missing>'), CAST(count(*) AS DOUBLE) FROM oof GROUP BY 1, 4""",
    )
)
def fold_audit(spark, sf_dir):
    audit = K.fold_audit(
        load(spark, sf_dir, "oof"),
        ["quality__gold", "toxic__gold"],
        patient="leakage_group",
        subgroups=["PatientSex"],
    )
    return rounded(audit, "value")


@query(
    with_views(
        "oof",
        """SELECT StudyInstanceUID, CASE WHEN fold = 2 THEN 'validation' ELSE 'train' END AS split,
        round(CASE WHEN fold = 2 THEN quality__gold ELSE quality__prediction END, 6) AS quality,
        round(CASE WHEN fold = 2 THEN toxic__gold ELSE toxic__prediction END, 6) AS toxic FROM oof""",
    )
)
def fold_split(spark, sf_dir):
    cohort = load(spark, sf_dir, "oof").withColumns(
        {f"{t}__train_fold_2": F.col(f"{t}__prediction") for t in TARGETS}
    )
    return rounded(K.fold_split(cohort, TARGETS, validation_fold=2), *TARGETS)


@query(
    with_views(
        "train semantic_labels inventory",
        "WITH " + WEAK_SQL.strip() + ", " + GROUP_SQL.strip()
        + """ SELECT t.StudyInstanceUID, t.PatientSex, leakage_group, """
        + ", ".join(
            f"""t.{t} AS {t}__gold, CAST(t.{t} IS NOT NULL AS INT) AS {t}__gold_mask, round(p_{t}.weak, 5) AS {t}__weak,
            round(p_{t}.train_value, 5) AS {t}__train, p_{t}.proxy AS {t}__stratify"""
            for t in TARGETS
        )
        + " FROM train t JOIN gp ON t.StudyInstanceUID = gp.StudyInstanceUID"
        + "".join(f" JOIN pr p_{t} ON p_{t}.StudyInstanceUID = t.StudyInstanceUID AND p_{t}.target = '{t}'" for t in TARGETS),
    )
)
def training_values(spark, sf_dir):
    """The training table without folds and what follows from them."""
    cohort = training_cohort(spark, sf_dir)
    parts = ("gold", "gold_mask", "weak", "train", "stratify")
    kept = cohort.select(ID, "PatientSex", "leakage_group", *[f"{t}__{p}" for t in TARGETS for p in parts])
    return kept.withColumns({f"{t}__{p}": F.round(F.col(f"{t}__{p}").cast("double"), 5) for t in TARGETS for p in ("weak", "train")})


@query()
def training_cohort(spark, sf_dir):
    return C.training_cohort(
        load(spark, sf_dir, "train").drop("Report"),
        load(spark, sf_dir, "semantic_labels").drop("language"),
        load(spark, sf_dir, "inventory"),
        TARGETS,
    )


@query(
    with_views(
        "train semantic_labels",
        "WITH " + WEAK_SQL.strip()
        + """ SELECT target, round(avg(weak), 6) AS weak_label_prevalence, round(avg(train_value), 6) AS train_target_prevalence,
        count(gold) AS gold_known, (SELECT count(DISTINCT StudyInstanceUID) FROM pr WHERE gold IS NOT NULL) AS gold_study_count FROM pr GROUP BY 1""",
    )
)
def training_audit(spark, sf_dir):
    long = weak(spark, sf_dir)
    wide = to_wide(
        long.withColumn("mask", F.col("gold").isNotNull().cast("int")),
        [ID],
        {"weak": "{target}__weak", "train": "{target}__train", "mask": "{target}__gold_mask"},
        TARGETS,
    )
    audit = C.training_audit(wide, TARGETS)
    return rounded(audit, "weak_label_prevalence", "train_target_prevalence")


@query(
    with_views(
        "external train",
        "SELECT t.StudyInstanceUID, "
        + ", ".join(
            f"round(e.{t}, 6) AS {t}__{s}"
            for t in TARGETS
            for s in ("probability", "rule_probability", "semantic_probability")
        )
        + " FROM train t JOIN external e ON t.StudyInstanceUID = e.uid",
    )
)
def align_external(spark, sf_dir):
    aligned = C.align_external(
        load(spark, sf_dir, "external"), load(spark, sf_dir, "train"), TARGETS, external_id="uid"
    )
    return rounded(aligned, *[c for c in aligned.columns if c != ID])


@query(
    with_views(
        "oof",
        """SELECT StudyInstanceUID, fold, PatientSex, leakage_group, round(quality__prediction, 6) AS quality__prediction,
        round(toxic__prediction, 6) AS toxic__prediction FROM oof""",
    )
)
def assemble_oof(spark, sf_dir):
    oof = load(spark, sf_dir, "oof")
    scores = oof.select(ID, "fold", *[f"{t}__prediction" for t in TARGETS])
    parts = [scores.where(F.col("fold") == k) for k in range(5)]
    joined = C.assemble_oof(parts, oof.select(ID, "PatientSex", "leakage_group"))
    return rounded(joined, *[f"{t}__prediction" for t in TARGETS])


@query(
    with_views(
        "models gold",
        "WITH " + FUSION_SQL.strip()
        + """ SELECT CAST(i / 20.0 AS DOUBLE) AS a, CAST(j / 20.0 AS DOUBLE) AS b, CAST(k / 20.0 AS DOUBLE) AS c, CAST(held_out AS INT) AS held_out, round(avg(auc), 6) AS macro_auc
        FROM aucs GROUP BY i, j, k, held_out""",
    )
)
def simplex_scores(spark, sf_dir):
    scored = B.simplex_scores(fusion_rows(spark, sf_dir), ["a", "b", "c"], step=0.05)
    return rounded(
        scored.select(
            *[F.get("weights", F.lit(i)).alias(n) for i, n in enumerate("abc")], "held_out", "macro_auc"
        ),
        "macro_auc",
    )


# --- calibration ---------------------------------------------------------------------------------


def platt_sql(keys: str, passes: int = 14) -> str:
    """Newton steps of all models of ``cn`` (keys, z, gold), one after the other; the last is ``fit``."""
    same = " AND ".join(f"c.{k} = a.{k}" for k in keys.split(", "))
    of = ", ".join(f"c.{k}" for k in keys.split(", "))
    steps = [
        f"sz AS (SELECT {keys}, count(*) AS known, least(sum(gold), count(*) - sum(gold)) AS thin FROM cn GROUP BY {keys})",
        f"a0 AS (SELECT {keys}, 1.0::DOUBLE AS slope, 0.0::DOUBLE AS intercept FROM sz WHERE thin >= 3)",
    ]
    for k in range(passes):
        steps.append(
            f"""d{k} AS MATERIALIZED (SELECT {keys}, slope, intercept, avg((p - gold) * z) + 0.02 * (slope - 1) AS g0, avg(p - gold) + 0.02 * intercept AS g1,
            avg(p * (1 - p) * z * z) + 0.02 AS h0, avg(p * (1 - p) * z) AS h1, avg(p * (1 - p)) + 0.02 AS h2
            FROM (SELECT {of}, slope, intercept, z, gold, 1 / (1 + exp(-(slope * z + intercept))) AS p FROM cn c JOIN a{k} a ON {same}) GROUP BY {keys}, slope, intercept),
            e{k} AS (SELECT *, NOT ((slope <= 0.05 AND g0 > 0) OR (slope >= 10 AND g0 < 0)) AS f0,
              NOT ((intercept <= -6 AND g1 > 0) OR (intercept >= 6 AND g1 < 0)) AS f1, h0 * h2 - h1 * h1 AS det FROM d{k}),
            a{k + 1} AS MATERIALIZED (SELECT {keys},
              least(greatest(slope + CASE WHEN f0 AND f1 THEN (h1 * g1 - h2 * g0) / det WHEN f0 THEN -g0 / h0 ELSE 0 END, 0.05), 10) AS slope,
              least(greatest(intercept + CASE WHEN f0 AND f1 THEN (h1 * g0 - h0 * g1) / det WHEN f1 THEN -g1 / h2 ELSE 0 END, -6), 6) AS intercept FROM e{k})"""
        )
    steps.append(
        f"""fit AS (SELECT {of}, coalesce(slope, 1) AS slope, coalesce(intercept, 0) AS intercept,
        CASE WHEN slope IS NULL THEN 'identity_insufficient_classes' ELSE 'fitted' END AS status, known FROM sz c LEFT JOIN a{passes} a ON {same})"""
    )
    return ", ".join(steps)


CALIBRATION_ROWS = """lg AS (SELECT StudyInstanceUID, fold, 'quality' AS target, quality__gold AS gold, quality__prediction AS score FROM oof
    UNION ALL SELECT StudyInstanceUID, fold, 'toxic', toxic__gold, toxic__prediction FROM oof),
lz AS (SELECT *, least(greatest(score, 0.00001), 0.99999) AS q, ln(q / (1 - q)) AS z FROM lg)"""
CROSS_ROWS = f"""{CALIBRATION_ROWS},
cn AS (SELECT held_out, target, z, gold FROM lz, (SELECT unnest(range(-1, 5)) AS held_out) WHERE held_out <> fold AND gold IS NOT NULL)"""


@query(
    with_views(
        "oof",
        f"""WITH {CALIBRATION_ROWS}, cn AS (SELECT target, z, gold FROM lz WHERE gold IS NOT NULL), {platt_sql("target")}
        SELECT target, round(slope, 6) AS slope, round(intercept, 6) AS intercept, status, known FROM fit""",
    )
)
def fit_platt(spark, sf_dir):
    return rounded(P.fit_platt(predictions(spark, sf_dir)), "slope", "intercept")


@query(
    with_views(
        "oof",
        f"""WITH {CROSS_ROWS}, {platt_sql("held_out, target")}
        SELECT CAST(held_out AS INT) AS held_out, target, round(slope, 6) AS slope, round(intercept, 6) AS intercept, status, known FROM fit""",
    )
)
def cross_fit(spark, sf_dir):
    return rounded(P.cross_fit(predictions(spark, sf_dir)), "slope", "intercept")


@query(
    with_views(
        "oof",
        f"""WITH {CROSS_ROWS}, {platt_sql("held_out, target")}
        SELECT StudyInstanceUID, fold, PatientSex, lz.target, gold, round(1 / (1 + exp(-least(greatest(slope * z + intercept, -30), 30))), 6) AS score
        FROM lz JOIN fit ON fold = held_out AND lz.target = fit.target JOIN (SELECT StudyInstanceUID, PatientSex FROM oof) USING (StudyInstanceUID)""",
    )
)
def cross_fit_calibration(spark, sf_dir):
    return rounded(P.cross_fit_calibration(predictions(spark, sf_dir)), "score")


# --- vectors -------------------------------------------------------------------------------------


@query(
    with_views(
        "measurements",
        """WITH b AS (SELECT unit AS u, quantile_cont(value, 0.005) AS low, quantile_cont(value, 0.995) AS high FROM measurements GROUP BY 1),
        c AS (SELECT unit, event_id, low, high, least(greatest(coalesce(value, low), low), high) AS v FROM measurements LEFT JOIN b ON unit = u)
        SELECT unit, event_id, round(CASE WHEN high > low THEN v ELSE 0 END, 5) AS clipped,
        round(CASE WHEN high > low THEN (v - low) / (high - low) ELSE 0 END, 5) AS scaled FROM c""",
    )
)
def robust_scale(spark, sf_dir):
    scaled = V.robust_scale(load(spark, sf_dir, "measurements"), "unit", "value")
    return scaled.select(
        "unit", "event_id", F.round("clipped", 5).alias("clipped"), F.round("scaled", 5).alias("scaled")
    )


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
       SELECT vec_id, round(list_sum(v[9:56]), 4) AS cropped, round(list_sum(v), 4) AS padded,
       round(v[1], 5) AS first FROM e"""
)
def fit_length(spark, sf_dir):
    vector = F.transform("embedding", lambda v: v.cast("double"))

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    padded = R.fit_length(vector, 80)
    return load(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(total(R.fit_length(vector, 48)), 4).alias("cropped"),
        F.round(total(padded), 4).alias("padded"),
        F.round(F.get(padded, F.lit(8)), 5).alias("first"),
    )


@query(
    with_views(
        "feature_slots",
        """WITH v AS (SELECT StudyInstanceUID, valid, unnest(feature) AS x, unnest(range(len(feature))) AS dim FROM feature_slots)
        SELECT StudyInstanceUID, CAST(dim AS INT) AS dim, count(*) FILTER (WHERE valid) AS valid_slots,
        round(coalesce(sum(CAST(x AS DOUBLE)) FILTER (WHERE valid), 0) / greatest(count(*) FILTER (WHERE valid), 1), 5) AS value FROM v GROUP BY 1, 2""",
    )
)
def pool_features(spark, sf_dir):
    pooled = V.pool_features(load(spark, sf_dir, "feature_slots"))
    return pooled.select(ID, "valid_slots", F.posexplode("feature").alias("dim", "value")).withColumn(
        "value", F.round("value", 5)
    )


@query(
    with_views(
        "sentence_vectors prompts",
        """WITH c AS (SELECT StudyInstanceUID, target, polarity, max(list_cosine_similarity(CAST(s.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[]))) AS best
            FROM sentence_vectors s, prompts p GROUP BY 1, 2, 3),
        w AS (SELECT StudyInstanceUID, target, max(best) FILTER (WHERE polarity = 'positive') AS pos, max(best) FILTER (WHERE polarity = 'negative') AS neg FROM c GROUP BY 1, 2)
        SELECT StudyInstanceUID, target, round(pos, 5) AS positive_similarity, round(neg, 5) AS negative_similarity,
        round(1 / (1 + exp(-least(greatest((pos - neg) * 10, -30), 30))), 5) AS probability FROM w""",
    )
)
def semantic_score(spark, sf_dir):
    scored = V.semantic_score(
        load(spark, sf_dir, "sentence_vectors"), load(spark, sf_dir, "prompts")
    )
    return scored.withColumns(
        {c: F.round(c, 5) for c in ("positive_similarity", "negative_similarity", "probability")}
    )


def probe_inputs(spark, sf_dir):
    """Pooled vectors of all embeddings by document, with the documents' gold and weak labels."""
    features = V.pool_features(
        load(spark, sf_dir, "embeddings").select(
            F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias(ID),
            F.col("embedding").alias("feature"),
            F.lit(True).alias("valid"),
        )
    )
    oof = load(spark, sf_dir, "oof").join(features.select(ID), ID, "left_semi")
    cohort = oof.withColumns(
        {
            f"{t}__train_fold_{k}": F.coalesce(f"{t}__gold", f"{t}__prediction")
            for t in TARGETS
            for k in range(5)
        }
    )
    return features.join(oof.select(ID), ID, "left_semi"), cohort


@query()
def ridge_probe(spark, sf_dir):
    features, cohort = probe_inputs(spark, sf_dir)
    return rounded(V.ridge_probe(features, cohort, TARGETS)[0], "score")


# --- table audits --------------------------------------------------------------------------------


@query(
    with_views(
        "train",
        """WITH l AS (SELECT 'quality' AS target, quality AS v FROM train UNION ALL SELECT 'toxic', toxic FROM train)
        SELECT target, count(*) - count(v) AS missing_count, count(v) AS known_count, count(DISTINCT v) AS distinct_values, min(v) AS smallest,
        max(v) AS largest, count(*) FILTER (WHERE v = 1) AS positive_count, round(count(*) FILTER (WHERE v = 1) / count(v), 6) AS positive_prevalence_among_known
        FROM l GROUP BY 1""",
    )
)
def target_prevalence(spark, sf_dir):
    return rounded(
        A.target_prevalence(load(spark, sf_dir, "train"), TARGETS), "positive_prevalence_among_known"
    )


@query(
    with_views(
        "train",
        " UNION ALL ".join(
            f"SELECT '{a}' AS target, '{b}' AS other, count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS rows FROM train"
            for a in TARGETS
            for b in TARGETS
        ),
    )
)
def cooccurrence(spark, sf_dir):
    return A.cooccurrence(load(spark, sf_dir, "train"), TARGETS)


@query(
    with_views(
        "slices",
        """WITH s AS (SELECT 'SOPInstanceUID' AS "column", SOPInstanceUID AS v FROM slices UNION ALL SELECT 'StudyInstanceUID', StudyInstanceUID FROM slices
            UNION ALL SELECT 'SeriesInstanceUID', SeriesInstanceUID FROM slices UNION ALL SELECT 'PatientID', PatientID FROM slices),
        c AS (SELECT "column", v, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT "column", CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS non_null_count,
        count(v) AS unique_non_null_count, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing_count,
        CAST(coalesce(sum(n) FILTER (WHERE v IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicate_non_null_rows FROM c GROUP BY 1""",
    )
)
def identifier_profile(spark, sf_dir):
    table = load(spark, sf_dir, "slices")
    columns = ["SOPInstanceUID", "StudyInstanceUID", "SeriesInstanceUID", "PatientID"]
    return A.identifier_profile(table, columns)


@query(
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows FROM lineitem"""
)
def duplicate_rows(spark, sf_dir):
    return A.duplicate_rows(load(spark, sf_dir, "lineitem"))


@query()
def table_audit(spark, sf_dir):
    train = load(spark, sf_dir, "train")
    sample = train.select(ID, *[F.lit(0.5).alias(t) for t in TARGETS])
    return A.table_audit(train, sample)


@query()
def header_audit(spark, sf_dir):
    return A.header_audit(load(spark, sf_dir, "slices"))


@query(
    with_views(
        "semantic_labels",
        """SELECT StudyInstanceUID, 'quality' AS target, round(quality__semantic_probability, 6) AS semantic FROM semantic_labels
        UNION ALL SELECT StudyInstanceUID, 'toxic', round(toxic__semantic_probability, 6) FROM semantic_labels""",
    )
)
def wide_to_long(spark, sf_dir):
    long = to_long(
        load(spark, sf_dir, "semantic_labels"), TARGETS, {"semantic": "{target}__semantic_probability"}, [ID]
    )
    return rounded(long, "semantic")
