"""Metrics, error ranking, ensembles, blends, contracts and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.core import to_long
from cohort_spark.functions import probability as P
from cohort_spark.operators import blending as B
from cohort_spark.operators import contracts as C
from cohort_spark.operators import delivery as D
from cohort_spark.operators import ensemble as E
from cohort_spark.operators import metrics as M
from cohort_spark.operators.vector_auc import POISSON
from testbed.registry import query
from testbed.views import load, with_views

TARGETS = ("quality", "toxic")
ID = "StudyInstanceUID"

LONG_SQL = """
long AS (SELECT StudyInstanceUID, fold, PatientSex, 'quality' AS target, quality__gold AS gold, quality__prediction AS score FROM oof
   UNION ALL SELECT StudyInstanceUID, fold, PatientSex, 'toxic', toxic__gold, toxic__prediction FROM oof)
"""


def auc_sql(source: str, keys: str = "", weight: str = "1") -> str:
    """CTEs that end in ``aucs(keys, target, known, positives, negatives, auc)``."""
    k = f"{keys}, " if keys else ""
    return f"""
cnt AS (SELECT {k}target, CASE WHEN gold IS NOT NULL THEN score END AS score,
     sum(CASE WHEN gold = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN gold = 0 THEN {weight} ELSE 0 END) AS n,
     sum(CASE WHEN gold IS NOT NULL THEN {weight} ELSE 0 END) AS kn FROM {source} GROUP BY ALL),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {k}target ORDER BY score NULLS FIRST
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cnt),
aucs AS (SELECT {k}target, CAST(sum(kn) AS BIGINT) AS known, CAST(sum(p) AS BIGINT) AS positives,
     CAST(sum(n) AS BIGINT) AS negatives,
     CASE WHEN sum(p) * sum(n) > 0 THEN CAST(sum(p * (below + n / 2.0)) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE) END AS auc
     FROM run GROUP BY ALL)"""


def predictions(spark, sf_dir, keep=(ID, "fold", "PatientSex")):
    return to_long(
        load(spark, sf_dir, "oof"), TARGETS, {"gold": "{target}__gold", "score": "{target}__prediction"}, keep
    )


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + "," + auc_sql("long")
        + " SELECT target, known, positives, negatives, round(auc, 6) AS auc FROM aucs",
    )
)
def auc(spark, sf_dir):
    return rounded(M.auc(predictions(spark, sf_dir)), "auc")


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + "," + auc_sql("long")
        + """ SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS valid_target_count, count(*) AS target_count FROM aucs""",
    )
)
def macro_auc(spark, sf_dir):
    return rounded(M.macro(M.auc(predictions(spark, sf_dir))), "macro_auc")


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + "," + auc_sql("long", "PatientSex")
        + " SELECT PatientSex, target, known, positives, negatives, round(auc, 6) AS auc FROM aucs",
    )
)
def subgroup_auc(spark, sf_dir):
    return rounded(M.subgroup_auc(predictions(spark, sf_dir), "PatientSex"), "auc")


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL
        + " SELECT target, count(gold) AS known, round(avg(pow(gold - score, 2)), 6) AS brier FROM long GROUP BY 1",
    )
)
def brier(spark, sf_dir):
    return rounded(M.brier(predictions(spark, sf_dir)), "brier")


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + "," + auc_sql("long")
        + """, b AS (SELECT target AS t, avg(pow(gold - score, 2)) AS brier FROM long GROUP BY 1)
        SELECT target, known, positives, negatives, round(auc, 6) AS auc, round(brier, 6) AS brier FROM aucs JOIN b ON target = t""",
    )
)
def oof_metrics(spark, sf_dir):
    return rounded(M.oof_metrics(predictions(spark, sf_dir)), "auc", "brier")


@query(with_views("oof", "SELECT fold, count(*) AS n FROM oof GROUP BY 1"))
def fold_counts(spark, sf_dir):
    return M.fold_counts(load(spark, sf_dir, "oof"))


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + """, c AS (SELECT CASE WHEN gold IS NOT NULL THEN 4.0 ELSE 1.0 END
           * CASE target WHEN 'quality' THEN 1.0 ELSE 2.5 END AS w, (score - 0.5) * 8 AS z,
           coalesce(gold, score) AS y FROM long)
        SELECT round(sum(CAST(w AS DOUBLE) * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) / greatest(sum(CAST(w AS DOUBLE)), 1), 6) AS loss FROM c""",
    )
)
def weighted_log_loss(spark, sf_dir):
    long = predictions(spark, sf_dir).select(
        "target",
        ((F.col("score") - 0.5) * 8).alias("logit"),
        F.coalesce("gold", "score").alias("value"),
        F.col("gold").isNotNull().alias("is_gold"),
    )
    return rounded(M.weighted_log_loss(long, target_weights={"quality": 1.0, "toxic": 2.5}), "loss")


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY target, gold ORDER BY
            CASE WHEN gold = 0 THEN -score ELSE score END, StudyInstanceUID) AS rank FROM long WHERE gold IN (0, 1))
        SELECT target, CASE WHEN gold = 0 THEN 'highest_ranked_negative' ELSE 'lowest_ranked_positive' END AS kind,
          CAST(rank AS INT) AS rank, StudyInstanceUID, fold, round(score, 6) AS score FROM r WHERE rank <= 3""",
    )
)
def ranked_errors(spark, sf_dir):
    return rounded(M.ranked_errors(predictions(spark, sf_dir), k=3, keep=["fold"]), "score")


RANK_SQL = """
rk AS (SELECT model, StudyInstanceUID, target, score,
   (rank() OVER (PARTITION BY model, target ORDER BY score)
    + (count(*) OVER (PARTITION BY model, target, score) - 1) / 2.0) / count(*) OVER (PARTITION BY model, target) AS pr FROM models)
"""


@query(
    with_views(
        "models",
        "WITH " + RANK_SQL.strip() + " SELECT model, StudyInstanceUID, target, round(pr, 6) AS rank FROM rk",
    )
)
def percentile_ranks(spark, sf_dir):
    ranked = M.percentile_ranks(load(spark, sf_dir, "models"), ["model", "target"])
    return rounded(ranked.drop("score"), "rank")


BOOTSTRAP_SQL = f"""
st AS (SELECT StudyInstanceUID AS s, md5(StudyInstanceUID || ':' || b || ':20260812') AS digest, b FROM (SELECT DISTINCT StudyInstanceUID FROM oof), range(125) x(b)),
dr AS (SELECT s, 8 * b + d AS replicate, CAST('0x' || substr(digest, CAST(4 * d + 1 AS INT), 4) AS INT) AS number FROM st, range(8) y(d)),
wt AS (SELECT s, replicate, {" + ".join(f"CAST(number >= {x} AS INT)" for x in POISSON)} AS w FROM dr),
kn AS (SELECT StudyInstanceUID AS s, 'quality' AS target, quality__gold AS gold, quality__prediction AS score FROM oof WHERE quality__gold IS NOT NULL
   UNION ALL SELECT StudyInstanceUID, 'toxic', toxic__gold, toxic__prediction FROM oof WHERE toxic__gold IS NOT NULL),
sc AS (SELECT replicate, target, score, sum(w) FILTER (WHERE gold = 1) AS p, sum(w) FILTER (WHERE gold = 0) AS n FROM kn JOIN wt USING (s) GROUP BY ALL),
rb AS (SELECT replicate, target, coalesce(p, 0) AS p, coalesce(n, 0) AS n,
   coalesce(sum(n) OVER (PARTITION BY replicate, target ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc),
ra AS (SELECT replicate, target, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / CAST(sum(p) * sum(n) AS DOUBLE) END AS auc FROM rb GROUP BY 1, 2),
rm AS (SELECT replicate, avg(auc) AS m FROM ra GROUP BY 1),
pa AS (SELECT target, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
   FROM kn a JOIN (SELECT target AS t, score, gold FROM kn) b ON target = t AND a.gold = 1 AND b.gold = 0 GROUP BY 1)
"""


@query(
    with_views(
        "oof",
        "WITH " + BOOTSTRAP_SQL.strip()
        + """ SELECT (SELECT round(avg(auc), 6) FROM pa) AS point_estimate, round(quantile_cont(m, 0.025), 6) AS lower_95,
        round(quantile_cont(m, 0.975), 6) AS upper_95, count(m) AS valid_bootstraps, 1000 AS requested_bootstraps FROM rm""",
    )
)
def bootstrap_auc(spark, sf_dir):
    return rounded(M.bootstrap_auc(predictions(spark, sf_dir)), "point_estimate", "lower_95", "upper_95")


MODELS = ("a", "b", "c")
WEIGHTS = {"a": 1.0, "b": 3.0, "c": 2.0}


@query(
    with_views(
        "models",
        """SELECT StudyInstanceUID, target, round(sum(CASE model WHEN 'a' THEN 1.0 WHEN 'b' THEN 3.0 ELSE 2.0 END * score) / 6.0, 6) AS score
        FROM models GROUP BY 1, 2""",
    )
)
def ensemble_mean(spark, sf_dir):
    return rounded(
        E.ensemble_mean(load(spark, sf_dir, "models"), models=MODELS, weights=WEIGHTS), "score"
    )


@query(
    with_views(
        "models",
        "WITH " + RANK_SQL.strip() + " SELECT StudyInstanceUID, target, round(avg(pr), 6) AS score FROM rk GROUP BY 1, 2",
    )
)
def ensemble_rank(spark, sf_dir):
    return rounded(E.ensemble_rank(load(spark, sf_dir, "models"), models=MODELS), "score")


@query(
    with_views(
        "models gold",
        "WITH " + RANK_SQL.strip() + """,
        px AS (SELECT 'probability' AS method, StudyInstanceUID, target, model, score AS v FROM models
              UNION ALL SELECT 'rank', StudyInstanceUID, target, model, pr FROM rk),
        e AS (SELECT method, StudyInstanceUID, target, ((CAST(0 AS DOUBLE) + max(v) FILTER (WHERE model = 'a') * (CAST(1 AS DOUBLE) / 3))
              + max(v) FILTER (WHERE model = 'b') * (CAST(1 AS DOUBLE) / 3)) + max(v) FILTER (WHERE model = 'c') * (CAST(1 AS DOUBLE) / 3) AS score FROM px GROUP BY 1, 2, 3),
        j AS (SELECT method, e.target, e.score, gold FROM e JOIN gold g ON e.StudyInstanceUID = g.StudyInstanceUID AND e.target = g.target),
        """ + auc_sql("j", "method") + """ SELECT method, round(avg(auc), 6) AS macro_auc, count(auc) AS valid_target_count, count(*) AS target_count
        FROM aucs GROUP BY 1""",
    )
)
def ensemble_compare(spark, sf_dir):
    compared = E.ensemble_compare(load(spark, sf_dir, "models"), load(spark, sf_dir, "gold"), models=MODELS)
    return rounded(compared, "macro_auc")


@query(
    with_views(
        "experiments",
        "SELECT experiment, round(macro_auc, 6) AS macro_auc FROM experiments ORDER BY macro_auc DESC, experiment DESC LIMIT 1",
    )
)
def leaderboard(spark, sf_dir):
    return rounded(M.leaderboard(load(spark, sf_dir, "experiments")), "macro_auc")


# --- blends --------------------------------------------------------------------------------------

BLEND_SQL = """
bl AS (SELECT s.StudyInstanceUID, g.fold, g.target, g.gold,
   CASE g.target WHEN 'quality' THEN quality__semantic_probability ELSE toxic__semantic_probability END AS semantic,
   CASE g.target WHEN 'quality' THEN quality__rule_probability ELSE toxic__rule_probability END AS rule
   FROM semantic_labels s JOIN gold g ON s.StudyInstanceUID = g.StudyInstanceUID),
cw(candidate, w) AS (VALUES (0, 0.0::DOUBLE), (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE), (4, 1.0::DOUBLE))
"""


def blend_rows(spark, sf_dir):
    sources = to_long(
        load(spark, sf_dir, "semantic_labels"),
        TARGETS,
        {"semantic": "{target}__semantic_probability", "rule": "{target}__rule_probability"},
        [ID],
    )
    return sources.join(load(spark, sf_dir, "gold"), [ID, "target"])


NESTED_SQL = BLEND_SQL + """,
cand AS (SELECT h.held AS held_out, candidate, w, target, gold, (1.0 - w) * semantic + w * rule AS score
   FROM bl, cw, range(5) h(held) WHERE fold <> h.held AND gold IS NOT NULL),
""" + auc_sql("cand", "held_out, candidate, w") + """,
mac AS (SELECT held_out, candidate, w, avg(auc) AS m FROM aucs GROUP BY 1, 2, 3),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY m DESC NULLS LAST, candidate) AS rk FROM mac) WHERE rk = 1)
"""


@query(
    with_views(
        "semantic_labels gold",
        "WITH " + NESTED_SQL.strip()
        + " SELECT CAST(held_out AS INT) AS held_out, w AS rule_weight, round(m, 6) AS development_macro_auc FROM win",
    )
)
def nested_blend_weights(spark, sf_dir):
    return rounded(B.nested_blend_weights(blend_rows(spark, sf_dir)), "development_macro_auc")


@query(
    with_views(
        "semantic_labels gold",
        "WITH " + NESTED_SQL.strip()
        + """ SELECT StudyInstanceUID, fold, target, CAST(held_out AS INT) AS held_out, w AS rule_weight,
        round(coalesce(gold, (1.0 - w) * semantic + w * rule), 6) AS train_target FROM bl, win""",
    )
)
def nested_blend(spark, sf_dir):
    return rounded(B.nested_blend(blend_rows(spark, sf_dir)), "train_target")


@query(
    with_views(
        "semantic_labels gold",
        "WITH " + BLEND_SQL.strip() + """, cand AS (SELECT candidate, w, target, gold, w * rule + (1.0 - w) * semantic AS score
            FROM bl, cw WHERE gold IS NOT NULL), """ + auc_sql("cand", "candidate, w")
        + """, mac AS (SELECT w, avg(auc) AS m FROM aucs GROUP BY 1)
        SELECT w AS rule_weight, round(m, 6) AS macro_auc, row_number() OVER (ORDER BY m DESC NULLS LAST, w) = 1 AS selected FROM mac""",
    )
)
def blend_selection(spark, sf_dir):
    return rounded(B.blend_selection(blend_rows(spark, sf_dir)), "macro_auc")


FUSION_SQL = """
wide AS (SELECT g.StudyInstanceUID, g.fold, g.target, g.gold, max(CASE WHEN model = 'a' THEN score END) AS a,
   max(CASE WHEN model = 'b' THEN score END) AS b, max(CASE WHEN model = 'c' THEN score END) AS c
   FROM gold g JOIN models m ON g.StudyInstanceUID = m.StudyInstanceUID AND g.target = m.target GROUP BY 1, 2, 3, 4),
sw AS (SELECT i, j, 20 - i - j AS k, row_number() OVER (ORDER BY i, j) - 1 AS candidate FROM range(21) x(i), range(21) y(j) WHERE i + j <= 20),
cand AS (SELECT h.held AS held_out, candidate, i, j, k, target, gold,
   (CAST(0 AS DOUBLE) + i / CAST(20 AS DOUBLE) * a) + j / CAST(20 AS DOUBLE) * b + k / CAST(20 AS DOUBLE) * c AS score
   FROM wide, sw, range(5) h(held) WHERE fold <> h.held AND gold IS NOT NULL),
""" + auc_sql("cand", "held_out, candidate, i, j, k")


def fusion_rows(spark, sf_dir):
    models = load(spark, sf_dir, "models")
    wide = models.groupBy(ID, "target").agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in ("a", "b", "c")]
    )
    return load(spark, sf_dir, "gold").join(wide, [ID, "target"])


@query(
    with_views(
        "models gold",
        "WITH " + FUSION_SQL.strip() + """,
        mac AS (SELECT held_out, candidate, i, j, k, avg(auc) AS m FROM aucs GROUP BY ALL),
        win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY m DESC NULLS LAST, candidate) AS rk FROM mac) WHERE rk = 1)
        SELECT StudyInstanceUID, fold, target, gold,
          round(i / 20.0 * a + j / 20.0 * b + k / 20.0 * c, 6) AS score FROM wide JOIN win ON fold = held_out""",
    )
)
def nested_fusion(spark, sf_dir):
    fused = B.nested_fusion(fusion_rows(spark, sf_dir), ["a", "b", "c"], step=0.05)
    return rounded(fused, "score")


@query(
    with_views(
        "models gold",
        "WITH " + FUSION_SQL.strip() + """,
        win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held_out, target ORDER BY auc DESC NULLS LAST, candidate) AS rk FROM aucs) WHERE rk = 1)
        SELECT StudyInstanceUID, fold, wide.target, gold,
          round(i / 20.0 * a + j / 20.0 * b + k / 20.0 * c, 6) AS score
        FROM wide JOIN win ON fold = held_out AND wide.target = win.target""",
    )
)
def nested_fusion_per_target(spark, sf_dir):
    fused = B.nested_fusion(
        fusion_rows(spark, sf_dir), ["a", "b", "c"], step=0.05, per_target=True
    )
    return rounded(fused, "score")


# --- contracts and delivery ----------------------------------------------------------------------


@query(
    with_views(
        "oof",
        """WITH t AS (SELECT StudyInstanceUID, CASE WHEN fold = 3 THEN quality__prediction * 1.5 ELSE quality__prediction END AS q,
              CASE WHEN PatientSex IS NULL THEN NULL ELSE toxic__prediction END AS t FROM oof)
        SELECT 'StudyInstanceUID is present' AS "check", count(*) FILTER (WHERE StudyInstanceUID IS NULL) AS violations,
               min(StudyInstanceUID) FILTER (WHERE StudyInstanceUID IS NULL) AS example FROM t
        UNION ALL SELECT 'q is finite', count(*) FILTER (WHERE q IS NULL), min(StudyInstanceUID) FILTER (WHERE q IS NULL) FROM t
        UNION ALL SELECT 'q is in [0, 1]', count(*) FILTER (WHERE q > 1), min(StudyInstanceUID) FILTER (WHERE q > 1) FROM t
        UNION ALL SELECT 't is finite', count(*) FILTER (WHERE t IS NULL), min(StudyInstanceUID) FILTER (WHERE t IS NULL) FROM t
        UNION ALL SELECT 't is in [0, 1]', count(*) FILTER (WHERE t > 1), min(StudyInstanceUID) FILTER (WHERE t > 1) FROM t
        UNION ALL SELECT 'StudyInstanceUID is unique', count(*) - count(DISTINCT StudyInstanceUID), NULL FROM t""",
    )
)
def contract_violations(spark, sf_dir):
    table = load(spark, sf_dir, "oof").select(
        ID,
        F.when(F.col("fold") == 3, F.col("quality__prediction") * 1.5)
        .otherwise(F.col("quality__prediction"))
        .alias("q"),
        F.when(F.col("PatientSex").isNotNull(), F.col("toxic__prediction")).alias("t"),
    )
    return C.prediction_violations(table, ID, ["q", "t"])


@query(
    """SELECT o.id, 'extra' AS status FROM (SELECT DISTINCT doc_id AS id FROM documents) o WHERE o.id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT l.id, 'missing' FROM (SELECT DISTINCT doc_id AS id FROM labels) l WHERE l.id NOT IN (SELECT doc_id FROM documents)"""
)
def id_set_difference(spark, sf_dir):
    return C.id_set_difference(
        load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents"), "doc_id"
    )


@query(
    """WITH g AS (SELECT o_custkey AS grp, o_orderkey % 5 AS fold FROM orders)
       SELECT grp, min(fold) AS first_fold, max(fold) AS last_fold FROM g GROUP BY 1 HAVING min(fold) <> max(fold)"""
)
def fold_leaks(spark, sf_dir):
    table = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 5).alias("fold")
    )
    return C.fold_leaks(table, "grp")


@query(
    """WITH g AS (SELECT o_custkey AS grp, o_orderkey % 5 AS fold FROM orders)
       SELECT DISTINCT a.grp FROM g a JOIN g b ON a.grp = b.grp WHERE a.fold = 2 AND b.fold <> 2"""
)
def split_overlap(spark, sf_dir):
    table = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 5).alias("fold")
    )
    return C.split_overlap(table, "grp", 2)


@query(
    with_views(
        "run_manifest run_parts",
        """SELECT m.run, m.declared_parts, m.complete, coalesce(f.n, 0) AS found_parts,
        m.complete AND coalesce(f.n, 0) = m.declared_parts AND m.declared_parts > 0 AS usable
        FROM run_manifest m LEFT JOIN (SELECT run, count(DISTINCT part) AS n FROM run_parts GROUP BY 1) f ON m.run = f.run""",
    )
)
def completeness_gate(spark, sf_dir):
    return C.completeness_gate(load(spark, sf_dir, "run_manifest"), load(spark, sf_dir, "run_parts"))


@query(
    with_views(
        "feature_slots",
        """SELECT count(*) AS rows, count(*) FILTER (WHERE valid) AS valid_rows,
        round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction FROM feature_slots""",
    )
)
def valid_fraction(spark, sf_dir):
    return rounded(C.valid_fraction(load(spark, sf_dir, "feature_slots")), "valid_fraction")


@query(
    with_views(
        "gold",
        """WITH o AS (SELECT StudyInstanceUID, target, CASE WHEN fold = 1 THEN 1 - gold ELSE gold END AS gold FROM gold)
        SELECT g.StudyInstanceUID, g.target, g.gold AS left_gold, o.gold AS right_gold
        FROM gold g JOIN o ON g.StudyInstanceUID = o.StudyInstanceUID AND g.target = o.target
        WHERE g.gold IS DISTINCT FROM o.gold""",
    )
)
def gold_mismatch(spark, sf_dir):
    gold = load(spark, sf_dir, "gold")
    other = gold.withColumn("gold", F.when(F.col("fold") == 1, 1 - F.col("gold")).otherwise(F.col("gold")))
    return C.gold_mismatch(gold, other)


@query(
    """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' || url WHEN 1 THEN '../' || url
                 WHEN 2 THEN 'a/../../' || url ELSE url || '/../x' END AS path FROM pages)
       SELECT page_id, path FROM p WHERE page_id % 4 < 3"""
)
def unsafe_paths(spark, sf_dir):
    i, url = F.col("page_id"), F.col("url")
    path = (
        F.when(i % 4 == 0, F.concat(F.lit("/"), url))
        .when(i % 4 == 1, F.concat(F.lit("../"), url))
        .when(i % 4 == 2, F.concat(F.lit("a/../../"), url))
        .otherwise(F.concat(url, F.lit("/../x")))
    )
    return C.unsafe_paths(load(spark, sf_dir, "pages").select("page_id", path.alias("path")))


@query(
    with_views(
        "semantic_labels train inventory",
        """SELECT t.StudyInstanceUID, t.PatientSex, t.quality, t.toxic, s.language, i.PatientID, i.slice_count
        FROM train t LEFT JOIN semantic_labels s ON t.StudyInstanceUID = s.StudyInstanceUID
        LEFT JOIN inventory i ON t.StudyInstanceUID = i.StudyInstanceUID""",
    )
)
def checked_join(spark, sf_dir):
    train = load(spark, sf_dir, "train").drop("Report")
    labels = load(spark, sf_dir, "semantic_labels").select(ID, "language")
    joined = C.checked_join(train, labels, [ID])
    return C.checked_join(joined, load(spark, sf_dir, "inventory"), [ID])


@query(
    with_views(
        "oof sample",
        """SELECT s.position, s.StudyInstanceUID, round(o.quality__prediction, 6) AS quality, round(o.toxic__prediction, 6) AS toxic
        FROM sample s LEFT JOIN oof o ON s.StudyInstanceUID = o.StudyInstanceUID""",
    )
)
def deliver(spark, sf_dir):
    scores = load(spark, sf_dir, "oof").select(
        ID, F.col("quality__prediction").alias("quality"), F.col("toxic__prediction").alias("toxic")
    )
    delivered = D.deliver(load(spark, sf_dir, "sample"), scores, identifier=ID, targets=TARGETS)
    return rounded(delivered, "quality", "toxic")


@query(
    with_views(
        "oof sample",
        """WITH d AS (SELECT s.position, s.StudyInstanceUID AS id, CASE WHEN fold = 4 THEN quality__prediction - 0.5 ELSE quality__prediction END AS q,
              toxic__prediction AS t FROM sample s LEFT JOIN oof o ON s.StudyInstanceUID = o.StudyInstanceUID)
        SELECT 'row count and order match the sample' AS "check", CAST(0 AS BIGINT) AS violations, CAST(NULL AS VARCHAR) AS example
        UNION ALL SELECT 'quality is a probability', count(*) FILTER (WHERE q < 0), min(id) FILTER (WHERE q < 0) FROM d
        UNION ALL SELECT 'toxic is a probability', count(*) FILTER (WHERE t < 0 OR t IS NULL), min(id) FILTER (WHERE t < 0 OR t IS NULL) FROM d
        UNION ALL SELECT 'StudyInstanceUID is unique', count(*) - count(DISTINCT id), NULL FROM d""",
    )
)
def delivery_violations(spark, sf_dir):
    sample = load(spark, sf_dir, "sample")
    scores = load(spark, sf_dir, "oof").select(
        ID,
        F.when(F.col("fold") == 4, F.col("quality__prediction") - 0.5)
        .otherwise(F.col("quality__prediction"))
        .alias("quality"),
        F.col("toxic__prediction").alias("toxic"),
    )
    delivered = D.deliver(sample, scores, identifier=ID, targets=TARGETS)
    return D.delivery_violations(sample, delivered, identifier=ID, targets=TARGETS)


@query(
    with_views(
        "gold oof",
        """SELECT o.StudyInstanceUID, o.fold, g.target, o.leakage_group, g.gold,
        round(CASE g.target WHEN 'quality' THEN o.quality__prediction ELSE o.toxic__prediction END, 6) AS image,
        round(CASE g.target WHEN 'quality' THEN o.toxic__prediction ELSE o.quality__prediction END, 6) AS report
        FROM oof o JOIN gold g ON o.StudyInstanceUID = g.StudyInstanceUID""",
    )
)
def join_modalities(spark, sf_dir):
    oof = load(spark, sf_dir, "oof")
    left = to_long(oof, TARGETS, {"score": "{target}__prediction"}, [ID, "fold", "leakage_group"])
    right = left.select(
        ID, F.when(F.col("target") == "quality", "toxic").otherwise("quality").alias("target"), "score"
    )
    from cohort_spark.operators.cohort import join_modalities as join

    joined = join(
        {"image": left, "report": right}, load(spark, sf_dir, "gold").select(ID, "target", "gold")
    )
    return rounded(joined, "image", "report")


@query(
    with_views(
        "oof",
        "WITH " + LONG_SQL + """, p(target, slope, intercept) AS (VALUES ('quality', 1.7::DOUBLE, -0.4::DOUBLE), ('toxic', 0.6::DOUBLE, 0.25::DOUBLE)),
        c AS (SELECT StudyInstanceUID, long.target, least(greatest(score, 0.00001), 1.0 - 0.00001) AS v, slope, intercept FROM long JOIN p ON long.target = p.target)
        SELECT StudyInstanceUID, target, round(1 / (1 + exp(-least(greatest(slope * ln(v / (1 - v)) + intercept, -30), 30))), 6) AS score FROM c""",
    )
)
def apply_calibration(spark, sf_dir):
    from cohort_spark.operators.calibration import apply_calibration as apply

    parameters = spark.createDataFrame(
        [("quality", 1.7, -0.4), ("toxic", 0.6, 0.25)], "target string, slope double, intercept double"
    )
    calibrated = apply(predictions(spark, sf_dir), parameters)
    return rounded(calibrated.select(ID, "target", "score"), "score")


@query(
    with_views(
        "semantic_labels",
        """SELECT StudyInstanceUID, round(0.25 * quality__rule_probability + 0.75 * quality__semantic_probability, 6) AS quality,
        round(0.25 * toxic__rule_probability + 0.75 * toxic__semantic_probability, 6) AS toxic FROM semantic_labels""",
    )
)
def blend_scores(spark, sf_dir):
    labels = load(spark, sf_dir, "semantic_labels")
    mixed = labels.select(
        ID,
        *[
            P.blend(
                F.col(f"{t}__rule_probability"), F.col(f"{t}__semantic_probability"), 0.25
            ).alias(t)
            for t in TARGETS
        ],
    )
    return rounded(mixed, *TARGETS)
