"""Vectors and measurements: robust scaling, pooling, semantic scores, the nested ridge probe."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, check_unique, durable, enforce, finite, require_columns
from cohort_spark.functions import arrays as A
from cohort_spark.functions.probability import sigmoid_margin
from cohort_spark.operators.contracts import same_ids
from cohort_spark.operators.metrics import auc, macro
from cohort_spark.skew import exact_quantiles

# Prompts are configuration: target pairs times vector length.
MAX_PROMPTS = 10_000


def robust_scale(
    df: DataFrame,
    unit: str,
    value: str,
    *,
    lower: float = 0.5,
    upper: float = 99.5,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Clip every unit's values to two percentiles and scale them to [0, 1].

    Non-finite and missing values take an end of the range; a unit without spread becomes zero. The
    percentiles are exact and need no buffer per unit.
    """
    known = df.withColumn("_value", finite(F.col(value)))
    bounds = exact_quantiles(
        known.select(unit, "_value"),
        [unit],
        "_value",
        {"low": lower / 100.0, "high": upper / 100.0},
        rows_per_task=rows_per_task,
    ).select(F.col(unit).alias("_unit"), "low", "high")
    raw = F.col(value).cast("double")
    filled = F.coalesce(
        F.col("_value"), F.when(raw == float("inf"), F.col("high")).otherwise(F.col("low"))
    )
    clipped = F.least(F.greatest(filled, F.col("low")), F.col("high"))
    spread = F.col("high") > F.col("low")
    # A clipped value spans its range exactly: the extremes of a unit reach both percentiles.
    scaled = (clipped - F.col("low")) / (F.col("high") - F.col("low"))
    joined = known.join(bounds, F.col(unit).eqNullSafe(F.col("_unit")), "left")
    return joined.withColumns(
        {
            "clipped": F.when(spread, clipped).otherwise(0.0),
            "scaled": F.when(spread, scaled).otherwise(0.0),
        }
    ).drop("_value", "_unit", "low", "high")


def pool_features(
    slots: DataFrame,
    *,
    identifier: str = "StudyInstanceUID",
    feature: str = "feature",
    valid: str = "valid",
) -> DataFrame:
    """Mean vector of the valid slots per study; zeros for a study without any.

    Sums are kept as vectors and combined before the shuffle.
    """
    require_columns(slots, [identifier, feature, valid])
    weight = F.col(valid).cast("double")
    vector = array_to_vector(
        F.transform(F.col(feature), lambda v: v.cast("double") * weight)
    )
    pooled = slots.select(identifier, vector.alias("_v"), weight.alias("_w")).groupBy(identifier).agg(
        Summarizer.sum(F.col("_v")).alias("_sum"), F.sum("_w").alias("valid_slots")
    )
    return pooled.select(
        identifier,
        F.col("valid_slots").cast("bigint").alias("valid_slots"),
        F.transform(
            vector_to_array("_sum"), lambda v: v / F.greatest(F.col("valid_slots"), F.lit(1.0))
        ).alias("feature"),
    )


def semantic_similarities(
    sentences: DataFrame,
    prompts: DataFrame,
    *,
    identifier: str = "StudyInstanceUID",
) -> DataFrame:
    """Best positive and negative cosine per (report, target).

    ``sentences`` has one vector per sentence, ``prompts`` a positive and a negative vector per
    target. Prompts are configuration: their number is checked, they are shipped to the tasks, and
    each batch of sentences is one matrix product. Maxima combine before the shuffle.
    """
    require_columns(sentences, [identifier, "vector"])
    enforce(check_unique(prompts.select("target", "polarity"), ["target", "polarity"], "prompts are unique"))
    rows = prompts.select("target", "polarity", "vector").limit(MAX_PROMPTS + 1).collect()
    if len(rows) > MAX_PROMPTS:
        raise ContractError(f"at most {MAX_PROMPTS} prompts are supported")
    by_key = {(r.target, r.polarity): np.asarray(r.vector, dtype=np.float64) for r in rows}
    targets = sorted({t for t, _ in by_key})
    lacking = [t for t in targets if {(t, "positive"), (t, "negative")} - set(by_key)]
    if lacking:
        raise ContractError("targets lack a prompt: " + ", ".join(lacking))
    matrix = np.stack(
        [by_key[t, p] / np.linalg.norm(by_key[t, p]) for t in targets for p in ("positive", "negative")]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            vectors = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            cosines = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ matrix.T
            best = pd.DataFrame(cosines).groupby(batch[identifier].to_numpy()).max()
            wide = best.to_numpy().reshape(len(best), len(targets), 2)
            yield pd.DataFrame(
                {
                    identifier: np.repeat(best.index.to_numpy(), len(targets)),
                    "target": np.tile(np.asarray(targets, dtype=object), len(best)),
                    "positive": wide[:, :, 0].ravel(),
                    "negative": wide[:, :, 1].ravel(),
                }
            )

    kind = sentences.schema[identifier].dataType.simpleString()
    scored = sentences.select(identifier, "vector").mapInPandas(
        score, f"`{identifier}` {kind}, target string, positive double, negative double"
    )
    return scored.groupBy(identifier, "target").agg(
        F.max("positive").alias("positive_similarity"), F.max("negative").alias("negative_similarity")
    )


def semantic_score(
    sentences: DataFrame,
    prompts: DataFrame,
    *,
    identifier: str = "StudyInstanceUID",
    scale: float = 10.0,
) -> DataFrame:
    """Semantic probability per (report, target) from the margin of the two similarities."""
    similar = semantic_similarities(sentences, prompts, identifier=identifier)
    margin = F.col("positive_similarity") - F.col("negative_similarity")
    return similar.withColumn("probability", sigmoid_margin(margin, scale))


def with_placeholder(reports: DataFrame, sentences: str = "sentences") -> DataFrame:
    """One row per sentence to encode; a report without text gets a placeholder sentence."""
    texts = F.when(F.size(sentences) > 0, F.col(sentences)).otherwise(F.array(F.lit("No report text.")))
    return reports.select("*", F.explode(texts).alias("sentence")).drop(sentences)


# --- nested ridge probe --------------------------------------------------------------------------


def _moments(
    rows: DataFrame, width: int, outputs: int
) -> dict[int, np.ndarray]:
    """Per fold, the products [1, x]' [1, x, y] summed over its rows.

    Each task adds up its rows and emits one vector per fold; Spark sums the vectors. What reaches
    the driver is one matrix per configured fold, whatever the number of rows.
    """
    height = width + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["feature"].to_numpy()).astype(np.float64)
            y = np.stack(batch["outputs"].to_numpy()).astype(np.float64)
            left = np.hstack([np.ones((len(x), 1)), x])
            right = np.hstack([left, y])
            folds = batch["fold"].to_numpy()
            for fold in np.unique(folds):
                here = folds == fold
                sums[int(fold)] = sums.get(int(fold), 0.0) + left[here].T @ right[here]
        if sums:
            yield pd.DataFrame(
                {"fold": list(sums), "products": [m.ravel() for m in sums.values()]}
            )

    summed = (
        rows.select("fold", "feature", "outputs")
        .mapInPandas(partial, "fold int, products array<double>")
        .groupBy("fold")
        .agg(Summarizer.sum(array_to_vector("products")).alias("s"))
        .select("fold", vector_to_array("s").alias("s"))
        .collect()
    )
    return {
        r.fold: np.asarray(r.s).reshape(height, height + outputs) for r in summed
    }


def ridge_fit(moments: np.ndarray, columns: Sequence[int], alpha: float) -> np.ndarray:
    """Ridge on standardised features from summed products: intercept row, then one row per feature.

    Population standard deviation, constant features left unscaled, intercept not penalised.
    """
    width = moments.shape[0] - 1
    n = moments[0, 0]
    mean = moments[0, 1 : width + 1] / n
    y_sums = moments[:, [1 + width + c for c in columns]]
    y_mean = y_sums[0] / n
    spread = moments[1:, 1 : width + 1] - n * np.outer(mean, mean)
    cross = y_sums[1:] - n * np.outer(mean, y_mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0.0) / n)
    scale[scale <= 10 * np.finfo(float).eps * np.maximum(np.abs(mean), 1.0)] = 1.0
    inner = spread / np.outer(scale, scale) + alpha * np.eye(width)
    weights = np.linalg.solve(inner, cross / scale[:, None]) / scale[:, None]
    return np.vstack([y_mean - mean @ weights, weights])


def ridge_probe(
    features: DataFrame,
    cohort: DataFrame,
    targets: Sequence[str],
    *,
    alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0),
    identifier: str = "StudyInstanceUID",
) -> tuple[DataFrame, DataFrame]:
    """Nested ridge probe: out-of-fold predictions in long form, and the alpha of every outer fold.

    One pass sums the products per fold; every outer, inner and final fit is a sum of folds, so no
    fit reads the data again. ``cohort`` has ``fold``, ``{t}__gold`` and ``{t}__train_fold_{k}``.
    """
    same_ids(features, cohort, identifier)
    folds = sorted(r[0] for r in cohort.select("fold").distinct().collect())
    outputs = [(k, t) for k in folds for t in targets]
    index = {pair: i for i, pair in enumerate(outputs)}
    rows = features.select(identifier, F.col("feature")).join(
        cohort.select(
            identifier,
            F.col("fold").cast("int").alias("fold"),
            F.array(
                *[F.col(f"`{t}__train_fold_{k}`").cast("double") for k, t in outputs]
            ).alias("outputs"),
            F.array(*[F.col(f"`{t}__gold`").cast("double") for t in targets]).alias("golds"),
        ),
        identifier,
    )
    # Read for the width, the moments, the inner scores and the predictions.
    rows = durable(rows)
    width = rows.select(F.size("feature")).first()[0]
    moments = _moments(rows, width, len(outputs))
    alphas = [float(a) for a in alphas]

    # Inner fits: predicts fold ``inner`` for the choice made by fold ``outer``.
    inner_coefficients: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for outer in folds:
        for inner in folds:
            if inner == outer:
                continue
            train = sum(moments[f] for f in folds if f not in (outer, inner))
            columns = [index[outer, t] for t in targets]
            for a, alpha in enumerate(alphas):
                inner_coefficients.setdefault(inner, []).append(
                    (outer, a, ridge_fit(train, columns, alpha))
                )

    def predict_inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.stack(part["feature"].to_numpy()).astype(np.float64)
                gold = np.stack(part["golds"].to_numpy()).astype(np.float64)
                for outer, a, weights in inner_coefficients[int(fold)]:
                    scores = weights[0] + x @ weights[1:]
                    yield pd.DataFrame(
                        {
                            "outer": outer,
                            "alpha": a,
                            "target": np.tile(np.asarray(targets, dtype=object), len(part)),
                            "gold": gold.ravel(),
                            "score": scores.ravel(),
                        }
                    )

    # Only rows with gold take part in the choice.
    with_gold = rows.where(F.exists("golds", lambda g: g.isNotNull()))
    inner_long = with_gold.select("fold", "feature", "golds").mapInPandas(
        predict_inner, "outer int, alpha int, target string, gold double, score double"
    )
    scored = macro(auc(inner_long, ["outer", "alpha"], check=False), ["outer", "alpha"]).collect()
    # One score per configured (fold, alpha).
    best: dict[int, tuple[float, int]] = {}
    for r in sorted(scored, key=lambda r: (r.outer, r.alpha)):
        value = float("-inf") if r.macro_auc is None else r.macro_auc
        if r.outer not in best or value > best[r.outer][0]:
            best[r.outer] = (value, r.alpha)
    final = {}
    for outer in folds:
        train = sum(moments[f] for f in folds if f != outer)
        chosen = alphas[best.get(outer, (0.0, 0))[1]]
        final[outer] = ridge_fit(train, [index[outer, t] for t in targets], chosen)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.stack(part["feature"].to_numpy()).astype(np.float64)
                scores = final[int(fold)][0] + x @ final[int(fold)][1:]
                gold = np.stack(part["golds"].to_numpy()).astype(np.float64)
                yield pd.DataFrame(
                    {
                        identifier: np.repeat(part[identifier].to_numpy(), len(targets)),
                        "fold": int(fold),
                        "target": np.tile(np.asarray(targets, dtype=object), len(part)),
                        "gold": gold.ravel(),
                        "score": scores.ravel(),
                    }
                )

    predictions = rows.select(identifier, "fold", "feature", "golds").mapInPandas(
        predict, f"`{identifier}` string, fold int, target string, gold double, score double"
    )
    predictions = predictions.withColumn("gold", finite(F.col("gold")))
    spark = features.sparkSession
    selections = spark.createDataFrame(
        [
            (outer, alphas[a], None if value == float("-inf") else float(value))
            for outer, (value, a) in sorted(best.items())
        ],
        "outer_fold int, alpha double, inner_macro_auc double",
    )
    return predictions, selections


def cosine(a, b):
    """Cosine of two array columns."""
    return A.dot(a, b) / (A.norm(a) * A.norm(b))
