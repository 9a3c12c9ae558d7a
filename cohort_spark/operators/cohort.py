"""Training cohorts: gold over weak labels, leakage groups, proxies, folds and nested targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import (
    check_unique,
    durable,
    enforce,
    finite,
    guarded,
    require_columns,
    to_long,
    to_wide,
)
from cohort_spark.functions.probability import is_probability
from cohort_spark.functions.text import strip
from cohort_spark.operators.blending import nested_blend, nested_blend_weights
from cohort_spark.operators.contracts import checked_join, prediction_violations, same_ids
from cohort_spark.operators.folds import assign_folds
from cohort_spark.skew import running_totals

STUDY = "StudyInstanceUID"
# Share of rows a proxy may mark, and the share without any gold (fixed values).
PREVALENCE_RANGE = (0.02, 0.98)
PREVALENCE_DEFAULT = 0.5


def leakage_group(
    inventory: DataFrame,
    *,
    study: str = STUDY,
    patient: str = "PatientID",
    min_groups: int = 2,
) -> DataFrame:
    """Add ``leakage_group`` and ``group_source``: shared patients when they survive, else studies.

    Patients group the rows when a trimmed, non-blank value is shared and enough groups remain; rows
    without one get a group of their own. The decision is one aggregate, used as a scalar.
    """
    if patient not in inventory.columns:
        return inventory.withColumns(
            {"leakage_group": F.col(study).cast("string"), "group_source": F.lit(study)}
        )
    value = strip(F.col(patient).cast("string"))
    usable = value.isNotNull() & (value != "")
    grouped = F.when(usable, value).otherwise(F.concat(F.lit("study::"), F.col(study).cast("string")))
    decision = (
        inventory.groupBy(grouped.alias("_g"))
        .agg(F.count_if(usable).alias("_n"))
        .agg(
            (F.coalesce(F.max(F.col("_n") > 1), F.lit(False)) & (F.count("*") >= min_groups)).alias(
                "_by_patient"
            )
        )
    )
    return (
        inventory.withColumn("_by_patient", decision.scalar())
        .withColumns(
            {
                "leakage_group": F.when(F.col("_by_patient"), grouped).otherwise(
                    F.col(study).cast("string")
                ),
                "group_source": F.when(F.col("_by_patient"), patient).otherwise(study),
            }
        )
        .drop("_by_patient")
    )


def gold_override(long: DataFrame) -> DataFrame:
    """Final label of every cell: gold where known, else the weak label.

    Needs ``gold, weak_probability, weak_label, weak_confidence``.
    """
    gold = finite(F.col("gold"))
    known = gold.isNotNull()
    return long.withColumns(
        {
            "probability": F.coalesce(gold, F.col("weak_probability")),
            "label": F.when(known, gold.cast("int")).otherwise(F.col("weak_label")),
            "confidence": F.when(known, 1.0).otherwise(F.col("weak_confidence")),
            "source": F.when(known, "gold").otherwise("rules_v1"),
        }
    )


def stratify_proxy(
    long: DataFrame,
    *,
    identifier: str = STUDY,
    score: str = "weak",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``proxy``: the top share of every target by score, the share being the gold prevalence.

    Equal scores are ordered by identifier. Gold replaces the proxy where it is known.
    """
    gold = finite(F.col("gold"))
    low, high = PREVALENCE_RANGE
    shares = long.groupBy(F.col("target").alias("_target")).agg(
        F.count("*").alias("_n"),
        F.least(F.greatest(F.coalesce(F.avg(gold), F.lit(PREVALENCE_DEFAULT)), F.lit(low)), F.lit(high)).alias(
            "_share"
        ),
    )
    placed = running_totals(
        long,
        ["target"],
        [F.col(score), F.col(identifier)],
        {"_before": F.lit(1)},
        rows_per_task=rows_per_task,
    )
    # One row per configured target.
    joined = placed.join(F.broadcast(shares), F.col("target") == F.col("_target"))
    proxy = ((F.col("_before") + 1) / F.col("_n") >= 1.0 - F.col("_share")).cast("int")
    return joined.withColumn("proxy", F.coalesce(gold.cast("int"), proxy)).drop(
        "_before", "_n", "_share", "_target"
    )


def weak_rows(
    train: DataFrame,
    weak_labels: DataFrame,
    targets: Sequence[str],
    *,
    identifier: str = STUDY,
) -> DataFrame:
    """One row per (study, target) with gold, both weak sources, their mean and the training value."""
    joined = checked_join(train, weak_labels, [identifier])
    long = to_long(
        joined,
        targets,
        {
            "gold": "{target}",
            "semantic": "{target}__semantic_probability",
            "rule": "{target}__rule_probability",
        },
        [identifier],
    ).withColumn("gold", finite(F.col("gold")))
    mean = 0.5 * F.col("semantic") + 0.5 * F.col("rule")
    return long.withColumn(
        "weak", guarded(mean, is_probability(mean), "weak probabilities are invalid")
    ).withColumn("train", F.coalesce("gold", "weak"))


def training_cohort(
    train: DataFrame,
    weak_labels: DataFrame,
    inventory: DataFrame,
    targets: Sequence[str],
    *,
    identifier: str = STUDY,
    n_splits: int = 5,
    **fold_options,
) -> DataFrame:
    """The training table: targets, masks, proxies, leakage group, fold and nested targets, one row per study.

    Long inside; wide columns appear at the end. The rows that folds and blends both read are stored
    once, so neither recomputes the joins.
    """
    for name, df in (("train", train), ("weak labels", weak_labels), ("inventory", inventory)):
        enforce(check_unique(df.select(identifier), [identifier], f"{name}: {identifier} is unique"))
    sex = F.col("PatientSex") if "PatientSex" in train.columns else F.lit(None).cast("string")
    base = train.select(identifier, sex.alias("PatientSex"), *[F.col(f"`{t}`") for t in targets])
    long = durable(stratify_proxy(weak_rows(base, weak_labels, targets, identifier=identifier), identifier=identifier))
    fields = {
        "gold": "{target}__gold",
        "weak": "{target}__weak",
        "train": "{target}__train",
        "proxy": "{target}__stratify",
    }
    wide = to_wide(long, [identifier], fields, targets)
    studies = base.select(identifier, "PatientSex").join(inventory, identifier, "left")
    grouped = leakage_group(studies, study=identifier, min_groups=n_splits)
    proxies = [f"{t}__stratify" for t in targets]
    golds = [f"{t}__gold" for t in targets]
    folded = durable(
        assign_folds(
            grouped.join(wide, identifier),
            group="leakage_group",
            targets=[*proxies, *golds],
            n_splits=n_splits,
            **fold_options,
        )
    )
    with_fold = long.join(folded.select(identifier, "fold"), identifier)
    nested = nested_blend(with_fold, identifier=identifier)
    per_fold = nested.groupBy(identifier).agg(
        *[
            F.max(
                F.when((F.col("target") == t) & (F.col("held_out") == k), F.col("train_target"))
            )
            .cast("float")
            .alias(f"{t}__train_fold_{k}")
            for t in targets
            for k in range(n_splits)
        ]
    )
    edges = {
        **{f"{t}__gold_mask": F.col(f"`{t}__gold`").isNotNull().cast("int") for t in targets},
        **{f"{t}__{c}": F.col(f"`{t}__{c}`").cast("float") for t in targets for c in ("weak", "train")},
        **{p: F.col(f"`{p}`").cast("int") for p in proxies},
    }
    return folded.withColumns(edges).join(per_fold, identifier)


def cohort_blend_weights(
    train: DataFrame, weak_labels: DataFrame, folds: DataFrame, targets: Sequence[str], identifier: str = STUDY
) -> DataFrame:
    """The rule weight every held-out fold of a cohort uses."""
    long = weak_rows(train, weak_labels, targets, identifier=identifier)
    return nested_blend_weights(long.join(folds.select(identifier, "fold"), identifier))


def training_audit(cohort: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean weak and training value and known gold per target, with the studies that have any gold."""
    counted = cohort.agg(
        F.count_if(
            F.greatest(*[F.col(f"`{t}__gold_mask`") for t in targets], F.lit(0)) == 1
        ).alias("gold_study_count"),
        *[F.avg(F.col(f"`{t}__weak`").cast("double")).alias(f"w::{t}") for t in targets],
        *[F.avg(F.col(f"`{t}__train`").cast("double")).alias(f"t::{t}") for t in targets],
        *[F.sum(F.col(f"`{t}__gold_mask`")).cast("bigint").alias(f"g::{t}") for t in targets],
    )
    cells = [
        F.struct(
            F.lit(t).alias("target"),
            F.col(f"`w::{t}`").alias("weak_label_prevalence"),
            F.col(f"`t::{t}`").alias("train_target_prevalence"),
            F.col(f"`g::{t}`").alias("gold_known"),
        )
        for t in targets
    ]
    return counted.select("gold_study_count", F.inline(F.array(*cells))).select(
        "target", "weak_label_prevalence", "train_target_prevalence", "gold_known", "gold_study_count"
    )


def align_external(
    external: DataFrame,
    studies: DataFrame,
    targets: Sequence[str],
    *,
    external_id: str,
    identifier: str = STUDY,
) -> DataFrame:
    """Public labels aligned to the studies: full coverage, unique ids, probabilities.

    Each target is offered as the final, the rule and the semantic probability.
    """
    require_columns(external, [external_id, *targets])
    renamed = external.select(
        F.col(external_id).cast("string").alias(identifier), *[F.col(f"`{t}`") for t in targets]
    )
    enforce(prediction_violations(renamed, identifier, targets))
    ids = studies.select(F.col(identifier).cast("string").alias(identifier))
    same_ids(ids, renamed, identifier)
    copies = [
        F.col(f"`{t}`").cast("double").alias(f"{t}__{suffix}")
        for t in targets
        for suffix in ("probability", "rule_probability", "semantic_probability")
    ]
    return ids.join(renamed, identifier).select(identifier, *copies)


def assemble_oof(
    parts: Sequence[DataFrame],
    metadata: DataFrame,
    *,
    identifier: str = STUDY,
) -> DataFrame:
    """Fold prediction tables as one table with the cohort's metadata; every study exactly once."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    enforce(check_unique(stacked.select(identifier), [identifier], "out-of-fold ids are unique"))
    same_ids(metadata.select(identifier), stacked.select(identifier), identifier)
    extra = [c for c in metadata.columns if c == identifier or c not in stacked.columns]
    return stacked.join(metadata.select(*extra), identifier)


def join_modalities(
    modalities: Mapping[str, DataFrame],
    gold: DataFrame,
    *,
    keys: Sequence[str] = (STUDY, "target"),
) -> DataFrame:
    """Long prediction tables side by side, one score column per modality; equal ids are required."""
    keys = list(keys)
    names = list(modalities)
    first = modalities[names[0]]
    joined = first.withColumnRenamed("score", names[0])
    for name in names[1:]:
        same_ids(first, modalities[name], keys[0])
        right = modalities[name].select(*keys, F.col("score").alias(name))
        joined = checked_join(joined, right, keys, how="inner")
    return joined.join(gold.select(*keys, "gold"), keys, "left")
