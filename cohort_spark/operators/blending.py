"""Blend weights chosen away from the rows they are applied to."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, durable, finite, require_columns
from cohort_spark.operators.metrics import auc_of_counts, binary, macro, score_counts
from cohort_spark.operators.vector_auc import held_out_candidate_aucs
from cohort_spark.skew import running_totals

# Rule weights tried by the label blends (fixed values).
RULE_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
# Folds are columns of the pair counts.
MOST_FOLDS = 100


def simplex_weights(n: int, step: float) -> list[tuple[float, ...]]:
    """Non-negative weight vectors that sum to one on a grid, in lexicographic order."""
    if n < 2:
        raise ValueError(f"{n} sources leave nothing to weigh")
    parts = round(1 / step) if step > 0 else 0
    if not parts or not math.isclose(parts * step, 1.0, rel_tol=1e-6):
        raise ValueError(f"{step} is not one part of a whole number of parts")
    heads = (h for h in product(range(parts + 1), repeat=n - 1) if sum(h) <= parts)
    return [tuple(v / parts for v in (*head, parts - sum(head))) for head in heads]


def _fan_out(candidates: Sequence[Column]) -> Column:
    """One output row per configured candidate, numbered in order, inside the task."""
    return F.posexplode(F.array(*candidates)).alias("candidate", "score")


def held_out_aucs(counts: DataFrame, folds: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """AUC per (held_out, keys, target) over the rows of all other folds, from counts per fold and score.

    The area is a sum over pairs of folds: positives of one above negatives of the other. One
    running sum of negatives per fold gives all pairs, and each held-out fold adds up those that it
    has no part in, so nothing is copied per held-out fold.
    """
    number = {f: i for i, f in enumerate(folds)}
    of_fold = lambda c, f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0))
    cells = [of_fold(c, f).alias(f"_{c[0]}{i}") for f, i in number.items() for c in ("positives", "negatives", "known")]
    group = [*keys, "target"]
    merged = durable(counts.groupBy(*group, "score").agg(*cells))
    below = running_totals(
        merged, group, [F.col("score").asc_nulls_first()], {f"_b{i}": F.col(f"_n{i}") for i in number.values()}
    )
    area = lambda i, j: F.col(f"_p{i}") * (F.col(f"_b{j}") + F.col(f"_n{j}") / 2.0)
    sums = below.groupBy(*group).agg(
        *[F.sum(area(i, j)).alias(f"_a{i}_{j}") for i in number.values() for j in number.values()],
        *[F.sum(f"_{c}{i}").alias(f"_{c}{i}") for i in number.values() for c in "pnk"],
    )
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    rows = []
    for f, i in number.items():
        rest = [j for j in number.values() if j != i]
        positives, negatives = total(f"_p{j}" for j in rest), total(f"_n{j}" for j in rest)
        pairs = positives.cast("double") * negatives.cast("double")
        whole = total(f"_a{j}_{k}" for j in rest for k in rest)
        rows.append(
            F.struct(
                F.lit(f).alias("held_out"),
                total(f"_k{j}" for j in rest).alias("known"),
                positives.alias("positives"),
                negatives.alias("negatives"),
                F.when(pairs > 0, whole / pairs).alias("auc"),
            )
        )
    return sums.select(*group, F.inline(F.array(*rows))).where("known > 0")


def fold_numbers(long: DataFrame) -> list[int]:
    """Fold numbers; their count is set by the configuration and checked here."""
    found = long.select("fold").distinct().take(MOST_FOLDS + 1)
    if len(found) > MOST_FOLDS:
        raise ContractError(f"more than {MOST_FOLDS} folds")
    return sorted(r[0] for r in found)


def _first_best(scored: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The best candidate per key, the first of equals; undefined scores lose."""
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col("candidate"))
    return scored.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def blend_candidates(long: DataFrame, weights: Sequence[float] = RULE_WEIGHTS, semantic_first: bool = True) -> DataFrame:
    """Long rows with ``rule`` and ``semantic`` fanned out to one row per rule weight."""
    require_columns(long, ["target", "rule", "semantic"])

    def mixed(w: float) -> Column:
        semantic, rule = (1.0 - w) * F.col("semantic"), w * F.col("rule")
        return semantic + rule if semantic_first else rule + semantic

    return long.select("*", _fan_out([mixed(float(w)) for w in weights]))


def _weight_of(candidate: Column, weights: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(w)) for w in weights]), candidate)


def nested_blend_weights(
    long: DataFrame, weights: Sequence[float] = RULE_WEIGHTS
) -> DataFrame:
    """Per held-out fold, the rule weight with the best macro AUC on the other folds.

    Equal scores go to the first candidate; a fold without any defined AUC gets one half.
    """
    known = long.where(finite(F.col("gold")).isNotNull())
    counts = score_counts(blend_candidates(known, weights), ["fold", "candidate"])
    folds = fold_numbers(long)
    scored = macro(held_out_aucs(counts, folds, ["candidate"]), ["held_out", "candidate"])
    best = _first_best(scored, ["held_out"], "macro_auc").select(
        F.col("held_out").alias("_held"),
        _weight_of(F.col("candidate"), weights).alias("_weight"),
        F.col("macro_auc").alias("development_macro_auc"),
    )
    # One row per fold on both sides.
    all_folds = long.sparkSession.createDataFrame([(f,) for f in folds], "held_out int")
    return all_folds.join(F.broadcast(best), F.col("held_out") == F.col("_held"), "left").select(
        "held_out",
        F.when(F.col("development_macro_auc").isNull(), 0.5)
        .otherwise(F.col("_weight"))
        .alias("rule_weight"),
        "development_macro_auc",
    )


def nested_blend(
    long: DataFrame,
    weights: Sequence[float] = RULE_WEIGHTS,
    *,
    identifier: str = "StudyInstanceUID",
) -> DataFrame:
    """Training target of every row for every held-out fold: gold, else the fold's blend.

    One row per (row, target, held-out fold); the fold count is configured, so the chosen weights
    are a handful of rows and are used as one scalar list.
    """
    chosen = nested_blend_weights(long, weights)
    # The number of folds bounds this list.
    per_fold = chosen.agg(
        F.array_sort(F.collect_list(F.struct("held_out", "rule_weight"))).alias("_chosen")
    )
    mixed = (1.0 - F.col("rule_weight")) * F.col("semantic") + F.col("rule_weight") * F.col("rule")
    return (
        long.withColumn("_chosen", per_fold.scalar())
        .select("*", F.inline("_chosen"))
        .select(
            identifier,
            "fold",
            "target",
            "held_out",
            "rule_weight",
            F.coalesce(finite(F.col("gold")), mixed).alias("train_target"),
        )
    )


def blend_selection(long: DataFrame, weights: Sequence[float] = RULE_WEIGHTS) -> DataFrame:
    """Macro AUC of every rule weight over all rows, the winner marked; equals go to the smallest."""
    known = long.where(finite(F.col("gold")).isNotNull())
    counts = score_counts(blend_candidates(known, weights, semantic_first=False), ["candidate"])
    scored = macro(auc_of_counts(counts, ["candidate"]), ["candidate"])
    weighted = scored.withColumn("rule_weight", _weight_of(F.col("candidate"), weights))
    # One row per configured weight.
    rank = Window.orderBy(F.col("macro_auc").desc_nulls_last(), F.col("rule_weight"))
    return weighted.select(
        "rule_weight", "macro_auc", (F.row_number().over(rank) == 1).alias("selected")
    )


def _fusion_aucs(long: DataFrame, sources: Sequence[str], step: float) -> tuple[DataFrame, Column]:
    """AUC per (held_out, candidate, target) away from the held-out fold, and the weight vectors."""
    require_columns(long, ["fold", "target", "gold", *sources])
    candidates = simplex_weights(len(sources), step)
    gold = binary(finite(F.col("gold")))
    known = long.select("fold", "target", gold.alias("gold"), *sources).where("gold IS NOT NULL")
    vectors = F.array(*[F.array(*[F.lit(v) for v in w]) for w in candidates])
    aucs = held_out_candidate_aucs(known, sources, candidates, fold_numbers(long))
    return durable(aucs), F.get(vectors, F.col("candidate"))


def simplex_scores(long: DataFrame, sources: Sequence[str], *, step: float = 0.05) -> DataFrame:
    """Macro AUC of every weight vector on the folds other than each held-out one."""
    aucs, vector = _fusion_aucs(long, sources, step)
    scored = macro(aucs, ["held_out", "candidate"])
    return scored.select("held_out", vector.alias("weights"), "macro_auc")


def nested_fusion_weights(
    long: DataFrame,
    sources: Sequence[str],
    *,
    step: float = 0.05,
    per_target: bool = False,
) -> DataFrame:
    """Per held-out fold (and target), the simplex weights with the best AUC on the other folds.

    ``long`` has one column per source; equal scores go to the first candidate in lexicographic
    order.
    """
    aucs, vector = _fusion_aucs(long, sources, step)
    if per_target:
        keys, score, scored = ["held_out", "target"], "auc", aucs
    else:
        keys, score = ["held_out"], "macro_auc"
        scored = macro(aucs, ["held_out", "candidate"])
    # One row per configured fold (and target).
    best = durable(
        _first_best(scored, keys, score).select(
            *keys, vector.alias("weights"), F.col(score).alias("development_auc")
        )
    )
    # Fail closed: every held-out fold (and target) needs gold of both classes elsewhere.
    found = best.where("development_auc IS NOT NULL").count()
    groups = len(fold_numbers(long)) * (long.select("target").distinct().count() if per_target else 1)
    if found < groups:
        raise ContractError("a held-out fold has no usable training gold")
    return best


def nested_fusion(
    long: DataFrame,
    sources: Sequence[str],
    *,
    identifier: str = "StudyInstanceUID",
    step: float = 0.05,
    per_target: bool = False,
) -> DataFrame:
    """Out-of-fold fusion: every row mixed with the weights chosen without its fold."""
    chosen = nested_fusion_weights(long, sources, step=step, per_target=per_target)
    chosen = chosen.withColumnsRenamed({"held_out": "fold"}).select(
        "fold", *(["target"] if per_target else []), "weights"
    )
    fused = F.lit(0.0)
    for i, s in enumerate(sources):
        fused = fused + F.get(F.col("weights"), F.lit(i)) * F.col(s)
    # One row per fold and configured target.
    keys = ["fold", "target"] if per_target else ["fold"]
    return long.join(F.broadcast(chosen), keys).select(
        identifier, "fold", "target", "gold", fused.alias("score")
    )
