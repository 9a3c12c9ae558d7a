"""Balanced placement of indivisible groups, by their profiles.

Groups with the same size and label counts are alike, so they are counted as one *profile* and placed
together: of a profile's m groups each fold gets as many as keep the balance error least. For a fold
with holdings h and a profile v the error grows by ``2 n <h, v> + n^2 <v, v>`` (weighted per label), a
convex function of n, so the best counts pour the groups into the folds like water: up to one level,
remainders to the lowest marginal costs.

Profiles are placed in descending *load*, the largest share of any label or of all rows that one group
holds. The heaviest ``SLICE`` profiles are one slice; the next ones come in waves of 1, 2, 4, ...
slices. The slices of a wave are placed at once, each on its share of all holdings so far, and their
sums go on to the next wave. So a task holds one slice, however many groups there are, and the number
of jobs grows with their logarithm. Restarts disturb the order of similar loads; a slice works on all
of them side by side, and only their holdings are kept until the best one is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, durable
from cohort_spark.skew import running_totals

# Weight of the size error and price of an empty fold (fixed values).
SIZE_WEIGHT = 0.15
EMPTY_PENALTY = 1000.0
# Profiles that one task places.
SLICE = 20_000
# How far a restart may move a profile in the order of loads.
DISTURBANCE = 0.5


def _pour(cost: np.ndarray, square: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Copies per fold, for each restart: least sum of ``2 n cost + n^2 square`` with the given total."""
    restarts, folds = cost.shape
    order = np.argsort(cost, axis=1, kind="stable")
    if copies.max() == 1:
        # One copy goes to the lowest cost.
        out = np.zeros(cost.shape, np.int64)
        out[np.arange(restarts), order[:, 0]] = copies
        return out
    low = np.take_along_axis(cost, order, axis=1)
    level = (copies * square)[:, None] + np.cumsum(low, axis=1)
    level /= np.arange(1, folds + 1)
    # The level of the most folds that all lie below it.
    used = np.maximum((low < level).sum(axis=1), 1)
    top = np.take_along_axis(level, used[:, None] - 1, axis=1)
    whole = np.floor(np.maximum(top - low, 0) / square[:, None]).astype(np.int64)
    # Rounding may leave one too many; the rest goes where one more costs least.
    over = np.maximum(whole.sum(axis=1) - copies, 0)
    while over.any():
        worst = np.argmax(np.where(whole > 0, 2 * low + square[:, None] * (2 * whole - 1), -np.inf), axis=1)
        whole[np.arange(restarts), worst] -= over > 0
        over -= over > 0
    left = copies - whole.sum(axis=1)
    while left.any():
        best = np.argmin(2 * low + square[:, None] * (2 * whole + 1), axis=1)
        whole[np.arange(restarts), best] += left > 0
        left -= left > 0
    out = np.empty_like(whole)
    np.put_along_axis(out, order, whole, axis=1)
    return out


def place(vectors: np.ndarray, copies: np.ndarray, order: np.ndarray, held: np.ndarray, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Place profiles in each restart's ``order``; yields the copies per fold of each step.

    ``held`` (restarts x folds x labels) is brought up to date.
    """
    restarts = np.arange(len(order))[:, None]
    scaled = vectors * weights
    squares = np.einsum("ij,ij->i", vectors, scaled)
    for step in range(order.shape[1]):
        now = order[:, step]
        cost = np.einsum("rfd,rd->rf", held, scaled[now])
        counts = _pour(cost, squares[now], copies[now])
        held[restarts, np.arange(held.shape[1])] += counts[:, :, None] * vectors[now][:, None, :]
        yield counts


def _orders(load: np.ndarray, names: np.ndarray, seed: int, restarts: list[int]) -> np.ndarray:
    """Descending loads; restart 0 as they are, others disturbed. Ties by a hash of profile and restart."""
    out = np.empty((len(restarts), len(load)), np.int64)
    for k, restart in enumerate(restarts):
        mixed = pd.util.hash_array(names ^ np.int64(seed * 1_000_003 + restart * 7919)).astype(np.float64) / 2**64
        disturbed = np.log(np.maximum(load, 1e-300)) + (DISTURBANCE * mixed if restart else 0)
        out[k] = np.lexsort((mixed, -disturbed))
    return out


def balance_error(held: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Label error + weighted size error + empty folds of holdings (... x folds x (labels, size))."""
    folds = held.shape[-2]
    want = total / folds
    relative = ((held - want) / np.maximum(want, 1.0)) ** 2
    empty = (held[..., -1] == 0).sum(axis=-1)
    return relative[..., :-1].mean(axis=(-2, -1)) + SIZE_WEIGHT * relative[..., -1].mean(axis=-1) + EMPTY_PENALTY * empty


def _weights(total: np.ndarray, folds: int) -> np.ndarray:
    labels = len(total) - 1
    share = np.append(np.full(labels, 1 / labels), SIZE_WEIGHT)
    return share / np.maximum(total / folds, 1.0) ** 2


def _loads(total: list[float]) -> Column:
    cells = [F.get("vector", F.lit(i)) / F.lit(x) for i, x in enumerate(total) if x > 0]
    return F.greatest(F.lit(0.0), F.lit(0.0), *cells)


def _waves(profiles: DataFrame, slice_rows: int) -> tuple[DataFrame, int]:
    """``wave`` and ``slice`` of each profile: slices of 1, 1, 2, 4, ... in descending load."""
    number = profiles.count()
    shares, upto = [], slice_rows
    while upto < number:
        shares.append(1 - upto / number)
        upto *= 2
    edges = profiles.agg(F.percentile_approx("load", F.array(*map(F.lit, shares)), F.lit(100_000))).first()[0] if shares else []
    wave = sum(((F.col("load") < F.lit(e)).cast("int") for e in edges), F.lit(0))
    waved = profiles.withColumn("wave", wave)
    sizes = {r.wave: -(-r["count"] // slice_rows) for r in waved.groupBy("wave").count().collect()}
    slices = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("wave"))
    cut = waved.withColumn("slices", slices.cast("int")).withColumn("slice", F.pmod(F.col("name"), F.col("slices")).cast("int"))
    return cut, len(edges) + 1


def place_profiles(
    matrix: DataFrame, *, n_splits: int, seed: int, restarts: int, slice_rows: int = SLICE
) -> tuple[DataFrame, float, int]:
    """``size, labels, counts`` (groups per fold) of every profile, the objective and the restart used.

    ``matrix`` has ``group, size, labels``. The driver holds restarts x folds x labels numbers and the
    number of slices of each wave.
    """
    vector = F.concat(F.col("labels").cast("array<double>"), F.array(F.col("size").cast("double")))
    profiles = durable(
        matrix.groupBy("size", "labels")
        .agg(F.count("*").alias("copies"))
        .withColumns({"vector": vector, "name": F.xxhash64("size", "labels", F.lit(seed))})
    )
    cells = profiles.select("copies", F.posexplode("vector").alias("at", "x"))
    sums = {r["at"]: r["total"] for r in cells.groupBy("at").agg(F.sum(F.col("x") * F.col("copies")).alias("total")).collect()}
    total = np.array([sums[i] for i in range(len(sums))])
    waved, waves = _waves(profiles.withColumn("load", _loads(total.tolist())), slice_rows)
    waved = durable(waved)
    weights, width = _weights(total, n_splits), len(total)

    def fitted(pdf: pd.DataFrame, held: np.ndarray, tried: list[int]) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
        start = held / int(pdf["slices"].iloc[0])
        order = _orders(pdf["load"].to_numpy(), pdf["name"].to_numpy(), seed, tried)
        vectors = np.stack(pdf["vector"].to_numpy())
        return start, order, place(vectors, pdf["copies"].to_numpy(), order, start, weights)

    def scored(held: np.ndarray):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own, _, steps = fitted(pdf, held, list(range(restarts)))
            for _ in steps:
                pass
            own -= held / int(pdf["slices"].iloc[0])
            return pd.DataFrame({"at": np.arange(own.size), "x": own.ravel()})

        return run

    holdings = [np.zeros((restarts, n_splits, width))]
    for wave in range(waves):
        rows = waved.where(F.col("wave") == wave).groupBy("slice").applyInPandas(scored(holdings[-1]), "at bigint, x double")
        added = np.zeros(restarts * n_splits * width)
        for r in rows.groupBy("at").agg(F.sum("x").alias("x")).collect():
            added[r["at"]] = r["x"]
        holdings.append(holdings[-1] + added.reshape(holdings[-1].shape))
    error = balance_error(np.rint(holdings[-1]), total)
    best = int(np.argmin(np.round(error, 12)))
    before = [h[best : best + 1] for h in holdings[:-1]]

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        _, order, steps = fitted(pdf, before[int(pdf["wave"].iloc[0])], [best])
        counts = np.zeros((len(pdf), n_splits), np.int64)
        for row, step in zip(order[0], steps, strict=True):
            counts[row] = step[0]
        return pd.DataFrame({"size": pdf["size"], "labels": pdf["labels"], "counts": list(counts)})

    placed = waved.groupBy("wave", "slice").applyInPandas(chosen, "size double, labels array<double>, counts array<bigint>")
    return durable(placed), float(error[best]), best


def place_groups(
    matrix: DataFrame, *, n_splits: int, seed: int, restarts: int, slice_rows: int = SLICE, rows_per_task: int | None = None
) -> DataFrame:
    """``group, fold, objective, restart``: the groups of a profile, in the order of a hash, fill its folds."""
    if restarts < 1:
        raise ValueError("restarts must be positive")
    if len(matrix.limit(n_splits).collect()) < n_splits:
        raise ContractError("there are fewer groups than folds")
    placed, objective, restart = place_profiles(matrix, n_splits=n_splits, seed=seed, restarts=restarts, slice_rows=slice_rows)
    if math.isnan(objective):
        raise ContractError("sizes and labels must be numbers")
    order = [F.xxhash64(F.lit(seed), F.col("group")), F.col("group")]
    numbered = running_totals(matrix, ["size", "labels"], order, {"_before": F.lit(1)}, rows_per_task=rows_per_task)
    placed = placed.select(F.col("size").alias("_size"), F.col("labels").alias("_labels"), F.col("counts").alias("_counts"))
    joined = numbered.join(placed, (F.col("size") == F.col("_size")) & (F.col("labels") == F.col("_labels")))
    upto = [F.expr(f"aggregate(slice(_counts, 1, {k + 1}), 0L, (a, x) -> a + x)") for k in range(n_splits - 1)]
    fold = sum(((F.col("_before") >= edge).cast("int") for edge in upto), F.lit(0))
    return joined.select("group", fold.cast("int").alias("fold"), F.lit(objective).alias("objective"), F.lit(restart).alias("restart"))
