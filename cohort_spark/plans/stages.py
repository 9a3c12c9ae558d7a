"""Stages from source tables to delivered tables; each returns its outputs by name.

A stage stores what several of its outputs read, and leaves writing to the caller and the sinks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.core import durable, to_long
from cohort_spark.functions.geometry import projected_coordinate
from cohort_spark.functions.lexicon import KNEE, Lexicon
from cohort_spark.functions.probability import blend
from cohort_spark.operators import audit as A
from cohort_spark.operators import blending as B
from cohort_spark.operators import calibration as P
from cohort_spark.operators import cohort as C
from cohort_spark.operators import delivery as D
from cohort_spark.operators import ensemble as E
from cohort_spark.operators import features as V
from cohort_spark.operators import folds as K
from cohort_spark.operators import labels as L
from cohort_spark.operators import manifest as M
from cohort_spark.operators import metrics as S
from cohort_spark.sources.headers import read_ordering_headers

ID = "StudyInstanceUID"


def metadata_stage(slices: DataFrame, descriptors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Header rows to series manifest, study inventory and one audit."""
    manifest = durable(M.series_manifest(slices, descriptors))
    inventory = durable(M.extended_inventory(manifest))
    nodes = {"grouping": A.grouping_audit(inventory), "order_methods": A.order_methods(manifest)}
    if descriptors is not None:
        nodes["descriptor_missingness"] = A.descriptor_missingness(manifest)
    extra = A.assemble_audit(slices.sparkSession, nodes)
    return {
        "manifest": manifest,
        "inventory": inventory,
        "audit": A.header_audit(slices).unionByName(extra),
    }


def inference_stage(slices: DataFrame, failures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ordered series of a delivery set with their audit; only ordering columns are read."""
    columns = [*M.KEYS, "dicom_path", "SpatialSliceCoordinate", "InstanceNumber"]
    ordered = durable(M.order_children(slices.select(*columns)))
    return {"manifest": ordered, "audit": M.manifest_audit(ordered, failures)}


def file_stage(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Ordered series of image files under ``study/series/file``, read by their leading bytes.

    Files that cannot be read keep their place in the path order and are counted as failures.
    """
    headers = durable(read_ordering_headers(spark, root))
    folders = F.split("path", "/")
    slices = headers.select(
        F.try_element_at(folders, F.lit(-3)).alias("StudyInstanceUID"),
        F.try_element_at(folders, F.lit(-2)).alias("SeriesInstanceUID"),
        F.col("path").alias("dicom_path"),
        projected_coordinate(F.col("ImageOrientationPatient"), F.col("ImagePositionPatient")).alias("SpatialSliceCoordinate"),
        "InstanceNumber",
    )
    failures = headers.where("error_type IS NOT NULL").select("path", "error_type", "error")
    return {**inference_stage(slices, failures), "failures": failures}


def selection_stage(manifest: DataFrame, **sampling: object) -> dict[str, DataFrame]:
    """Series chosen per study and the slices to sample from them."""
    chosen = M.select_per_category(M.score_children(manifest))
    return {"selected": chosen, "plan": M.sampling_plan(chosen, **sampling)}


def corpus_stage(reports: DataFrame, text: str) -> dict[str, DataFrame]:
    """Language, length and duplicate audit of a report corpus."""
    return {
        "totals": L.corpus_totals(reports, text),
        "languages": L.corpus_languages(reports, text),
        "lengths": L.length_quantiles(reports, text),
        "duplicates": L.duplicate_summary(reports, text),
    }


def label_stage(
    train: DataFrame,
    *,
    text: str = "Report",
    lexicon: Lexicon = KNEE,
    targets: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Reports and gold to final labels in long form, with their audit."""
    targets = list(targets or lexicon.targets)
    weak = L.label_corpus(train, text=text, keep=[ID], lexicon=lexicon, targets=targets)
    gold = to_long(train, targets, {"gold": "{target}"}, [ID])
    labels = durable(C.gold_override(weak.join(gold, [ID, "target"])))
    return {
        "labels": labels,
        "audit": L.weak_label_audit(labels),
        "statuses": L.status_counts(labels),
    }


def semantic_stage(
    rule_labels: DataFrame, sentence_vectors: DataFrame, prompts: DataFrame, gold: DataFrame
) -> dict[str, DataFrame]:
    """Rule and semantic probabilities, the best global blend of both, and its scores."""
    keys = [ID, "target"]
    semantic = V.semantic_score(sentence_vectors, prompts).withColumnRenamed("probability", "semantic")
    rules = rule_labels.select(*keys, F.col("weak_probability").alias("rule"))
    long = durable(semantic.join(rules, keys).join(gold.select(*keys, "gold"), keys, "left"))
    weights = durable(B.blend_selection(long))
    chosen = weights.where("selected").first().rule_weight
    labels = long.withColumn("probability", blend(F.col("rule"), F.col("semantic"), chosen))
    return {"labels": labels, "weights": weights}


def cohort_stage(
    train: DataFrame,
    weak_labels: DataFrame,
    inventory: DataFrame,
    targets: Sequence[str],
    **options: object,
) -> dict[str, DataFrame]:
    """Training table with its fold audit, fold quality, prevalence and nested blend weights."""
    cohort = durable(C.training_cohort(train, weak_labels, inventory, targets, **options))
    golds = [f"{t}__gold" for t in targets]
    return {
        "cohort": cohort,
        "folds": K.fold_audit(cohort, golds, patient="leakage_group", subgroups=["PatientSex"]),
        "quality": K.fold_objective(
            cohort,
            [*[f"{t}__stratify" for t in targets], *golds],
            n_splits=int(options.get("n_splits", 5)),
        ),
        "prevalence": C.training_audit(cohort, targets),
        "blends": C.cohort_blend_weights(train, weak_labels, cohort, targets),
    }


def evaluation_stage(
    oof: DataFrame,
    targets: Sequence[str],
    *,
    subgroups: Sequence[str] = ("PatientSex",),
    iterations: int = 1000,
    top_k: int = 3,
) -> dict[str, DataFrame]:
    """Metrics, interval, subgroups, ranked errors and calibration of out-of-fold predictions."""
    fields = {"gold": "{target}__gold", "score": "{target}__prediction"}
    long = durable(to_long(oof, targets, fields, [ID, "fold", *subgroups]))
    calibrated = durable(P.cross_fit_calibration(long))
    return {
        "metrics": S.oof_metrics(long),
        "macro": S.macro(S.auc(long)),
        "folds": S.fold_counts(oof),
        "interval": S.bootstrap_auc(long, iterations=iterations),
        **{f"by_{c}": S.subgroup_auc(long, c) for c in subgroups},
        "errors": S.ranked_errors(long, k=top_k, keep=["fold"]),
        "calibrated": calibrated,
        "calibrated_metrics": S.oof_metrics(calibrated),
        "parameters": P.cross_fit(long).where(F.col("held_out") == P.FULL_FIT).drop("held_out"),
    }


def delivery_stage(
    predictions: Mapping[str, DataFrame],
    sample: DataFrame,
    targets: Sequence[str],
    *,
    weights: Mapping[str, float] | None = None,
    by_rank: bool = False,
    calibration: DataFrame | None = None,
) -> DataFrame:
    """Ensemble of wide prediction tables, calibrated when parameters are given, in the sample's order."""
    wide = E.stack_models(predictions)
    stacked = to_long(wide, targets, {"score": "{target}__prediction"}, ["model", ID])
    combine = E.ensemble_rank if by_rank else E.ensemble_mean
    scores = combine(stacked, models=list(predictions), weights=weights)
    if calibration is not None:
        scores = P.apply_calibration(scores, calibration)
    table = durable(
        scores.groupBy(ID).agg(
            *[F.max(F.when(F.col("target") == t, F.col("score"))).alias(t) for t in targets]
        )
    )
    options = {"identifier": ID, "targets": list(targets)}
    return D.validated_delivery(sample, D.deliver(sample, table, **options), **options)
