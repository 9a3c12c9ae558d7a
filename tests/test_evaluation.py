from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, to_long
from cohort_spark.operators import blending as B
from cohort_spark.operators import calibration as P
from cohort_spark.operators import contracts as C
from cohort_spark.operators import delivery as D
from cohort_spark.operators import ensemble as E
from cohort_spark.operators import features as V
from cohort_spark.operators import metrics as M
from cohort_spark.operators import vector_auc as W

LONG = "StudyInstanceUID string, fold int, target string, gold double, score double"


def pairwise_auc(gold, score):
    pos = [s for g, s in zip(gold, score) if g == 1]
    neg = [s for g, s in zip(gold, score) if g == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        for t in ("x", "y"):
            gold = None if rng.random() < 0.3 else float(rng.random() < 0.4)
            rows.append((f"s{i}", i % 5, t, gold, round(float(rng.random()), 2)))
    return spark.createDataFrame(rows, LONG), rows


def test_auc_edge_case(spark):
    rows = [("a", 0, "v", 0.0, 0.1), ("b", 0, "v", 1.0, 0.9), ("c", 0, "v", None, 0.5)]
    rows += [(k, 0, "n", 0.0, 0.3) for k in "abc"]
    aucs = M.auc(spark.createDataFrame(rows, LONG))
    got = {r.target: r.auc for r in aucs.collect()}
    assert got == {"v": 1.0, "n": None}
    total = M.macro(aucs).first()
    assert (total.macro_auc, total.valid_target_count, total.target_count) == (1.0, 1, 2)


@pytest.mark.parametrize("limit", [None, 10])
def test_auc_equals_the_pairwise_definition(scored, limit):
    df, rows = scored
    got = {r.target: r.auc for r in M.auc(df, rows_per_task=limit).collect()}
    for t in ("x", "y"):
        mine = [(r[3], r[4]) for r in rows if r[2] == t]
        assert got[t] == pytest.approx(pairwise_auc([g for g, _ in mine], [s for _, s in mine]), abs=1e-12)


def test_scores_must_be_probabilities(spark):
    bad = spark.createDataFrame([("a", 0, "v", 1.0, 1.1)], LONG)
    with pytest.raises(Exception, match="probability"):
        M.auc(bad).collect()


def test_bootstrap_contains_the_point(scored):
    row = M.bootstrap_auc(scored[0], iterations=60).first()
    assert row.lower_95 <= row.point_estimate <= row.upper_95
    assert row.valid_bootstraps == 60
    assert row == M.bootstrap_auc(scored[0], iterations=60).first()


def test_ranked_errors(spark):
    rows = [("a", 0, "v", 0.0, 0.2), ("b", 0, "v", 0.0, 0.9), ("c", 0, "v", 1.0, 0.1), ("d", 0, "v", 1.0, 0.8)]
    got = {r.kind: r.StudyInstanceUID for r in M.ranked_errors(spark.createDataFrame(rows, LONG), k=1).collect()}
    assert got == {"highest_ranked_negative": "b", "lowest_ranked_positive": "c"}


@pytest.mark.parametrize("limit", [None, 2])
def test_percentile_ranks(spark, limit):
    df = spark.createDataFrame([("a", "t", 0.2), ("b", "t", 0.2), ("c", "t", 0.8)], "id string, target string, score double")
    got = {r.id: r.rank for r in M.percentile_ranks(df, rows_per_task=limit).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.5, "c": 1.0})


def test_ensembles(spark):
    schema = "model string, StudyInstanceUID string, target string, score double"
    df = spark.createDataFrame([("m", "a", "t", 0.2), ("m", "b", "t", 0.8), ("n", "a", "t", 0.8), ("n", "b", "t", 0.2)], schema)
    got = {r.StudyInstanceUID: r.score for r in E.ensemble_mean(df, models=["m", "n"], weights={"m": 1, "n": 3}).collect()}
    assert got == pytest.approx({"a": 0.65, "b": 0.35})
    rows = [("m", k, "t", s) for k, s in zip("abc", (0.1, 0.2, 0.9))] + [("n", k, "t", s) for k, s in zip("abc", (0.6, 0.7, 0.8))]
    ranked = {r.StudyInstanceUID: r.score for r in E.ensemble_rank(spark.createDataFrame(rows, schema), models=["m", "n"]).collect()}
    assert ranked == pytest.approx({"a": 1 / 3, "b": 2 / 3, "c": 1.0})
    with pytest.raises(Exception, match="exactly one score"):
        E.ensemble_mean(df.limit(3), models=["m", "n"]).collect()
    with pytest.raises(ValueError):
        E.ensemble_mean(df, models=["m", "n"], weights={"m": -1, "n": 3})


def fusion_rows(spark):
    rows = []
    for i in range(12):
        gold = float(i % 2)
        good, bad = 0.2 + 0.6 * gold, 0.8 - 0.6 * gold
        rows.append((f"s{i}", i % 3, "x", gold, good, bad))
        rows.append((f"s{i}", i % 3, "y", gold, bad, good))
    return spark.createDataFrame(rows, "StudyInstanceUID string, fold int, target string, gold double, a double, b double")


def test_fusion(spark):
    assert len(B.simplex_weights(3, 0.5)) == 6
    with pytest.raises(ValueError):
        B.simplex_weights(3, 0.3)
    rows = fusion_rows(spark)
    only_x = rows.where("target = 'x'")
    chosen = B.nested_fusion_weights(only_x, ["a", "b"], step=0.5).collect()
    assert all(r.weights == [1.0, 0.0] for r in chosen) and len(chosen) == 3
    assert M.auc(B.nested_fusion(only_x, ["a", "b"], step=0.5), check=False).first().auc == 1.0
    per = {r.target: r.weights for r in B.nested_fusion_weights(rows, ["a", "b"], step=0.5, per_target=True).collect()}
    assert per == {"x": [1.0, 0.0], "y": [0.0, 1.0]}


def test_nested_choice_never_sees_the_held_out_fold(spark):
    """Changing the gold of a fold must not change the weights that are used in it."""
    rows = fusion_rows(spark).where("target = 'x'")
    flipped = rows.withColumn("gold", F.when(F.col("fold") == 0, 1 - F.col("gold")).otherwise(F.col("gold")))
    first = {r.held_out: r.weights for r in B.nested_fusion_weights(rows, ["a", "b"], step=0.5).collect()}
    second = {r.held_out: r.weights for r in B.nested_fusion_weights(flipped, ["a", "b"], step=0.5).collect()}
    assert first[0] == second[0]


def test_platt_is_the_minimum(spark):
    labels = [0, 0, 0, 1, 1, 1]
    scores = [0.05, 0.15, 0.3, 0.7, 0.8, 0.95]
    df = spark.createDataFrame([(f"s{i}", 0, "t", float(g), s) for i, (g, s) in enumerate(zip(labels, scores))], LONG)
    fit = P.fit_platt(df).first()
    assert fit.status == "fitted" and fit.known == 6
    z, y = np.log(np.array(scores) / (1 - np.array(scores))), np.array(labels)

    def loss(a, b):
        t = a * z + b
        return np.mean(np.logaddexp(0, t) - y * t) + 0.01 * ((a - 1) ** 2 + b * b)

    best = loss(fit.slope, fit.intercept)
    for a in np.linspace(0.05, 10, 60):
        for b in np.linspace(-6, 6, 49):
            assert best <= loss(a, b) + 1e-9
    out = [r.score for r in P.apply_calibration(df, P.fit_platt(df)).orderBy("StudyInstanceUID").collect()]
    assert out == sorted(out) and 0 < out[0] and out[-1] < 1
    thin = P.fit_platt(df.where("score < 0.75")).first()
    assert (thin.slope, thin.intercept, thin.status) == (1.0, 0.0, "identity_insufficient_classes")
    with pytest.raises(Exception, match="missing a target"):
        P.apply_calibration(df.withColumn("target", F.lit("other")), P.fit_platt(df)).collect()


def test_cross_fit_uses_the_other_folds(scored):
    df, _ = scored
    fits = {(r.held_out, r.target): r for r in P.cross_fit(df).collect()}
    alone = P.fit_platt(df.where("fold <> 2")).where("target = 'x'").first()
    assert fits[2, "x"].slope == pytest.approx(alone.slope, abs=1e-8)
    assert len(fits) == 12


def test_ridge_fit_equals_a_direct_fit():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 6)) * 3 + 1, rng.random((80, 2))
    x[:, 5] = 2.0
    left = np.hstack([np.ones((80, 1)), x])
    got = V.ridge_fit(left.T @ np.hstack([left, y]), [0, 1], 10.0)
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    xs = (x - x.mean(axis=0)) / scale
    w = np.linalg.solve(xs.T @ xs + 10 * np.eye(6), xs.T @ (y - y.mean(axis=0)))
    assert got[0] + x @ got[1:] == pytest.approx(y.mean(axis=0) + xs @ w, abs=1e-9)


def test_ridge_probe_agrees_with_numpy(spark):
    rng = np.random.default_rng(11)
    n, d = 60, 4
    x = rng.normal(size=(n, d)).astype(float)
    gold = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    features = spark.createDataFrame([(f"s{i}", x[i].tolist()) for i in range(n)], "StudyInstanceUID string, feature array<double>")
    cohort = spark.createDataFrame(
        [(f"s{i}", i % 3, *[float(gold[i])] * 4) for i in range(n)],
        "StudyInstanceUID string, fold int, t__gold double, t__train_fold_0 double, t__train_fold_1 double, t__train_fold_2 double",
    )
    predictions, chosen = V.ridge_probe(features, cohort, ["t"], alphas=[5.0])
    got = {r.StudyInstanceUID: r.score for r in predictions.collect()}
    for fold in range(3):
        train = np.arange(n) % 3 != fold
        m, s = x[train].mean(axis=0), x[train].std(axis=0)
        xs = (x[train] - m) / s
        w = np.linalg.solve(xs.T @ xs + 5 * np.eye(d), xs.T @ (gold[train] - gold[train].mean()))
        for i in np.flatnonzero(~train):
            assert got[f"s{i}"] == pytest.approx(gold[train].mean() + ((x[i] - m) / s) @ w, abs=1e-8)
    assert {r.alpha for r in chosen.collect()} == {5.0}


def test_robust_scale(spark):
    values = [float(v) for v in range(200)]
    rows = [("u", v) for v in values] + [("flat", 3.0), ("flat", 3.0), ("u", float("inf")), ("u", None)]
    got = V.robust_scale(spark.createDataFrame(rows, "unit string, value double"), "unit", "value").collect()
    lo, hi = np.percentile(values, [0.5, 99.5])
    by_value = {r.value: r for r in got if r.unit == "u"}
    assert by_value[100.0].clipped == pytest.approx(100.0)
    assert by_value[0.0].clipped == pytest.approx(lo) and by_value[float("inf")].clipped == pytest.approx(hi)
    assert by_value[None].scaled == 0.0 and by_value[199.0].scaled == 1.0
    assert {r.scaled for r in got if r.unit == "flat"} == {0.0}


def test_semantic_score_is_monotone(spark):
    vectors = spark.createDataFrame([("low", [0.0, 1.0]), ("mid", [1.0, 1.0]), ("high", [1.0, 0.0])], "StudyInstanceUID string, vector array<double>")
    prompts = spark.createDataFrame([("t", "positive", [1.0, 0.0]), ("t", "negative", [0.0, 1.0])], "target string, polarity string, vector array<double>")
    got = {r.StudyInstanceUID: r.probability for r in V.semantic_score(vectors, prompts).collect()}
    assert got["low"] < got["mid"] < got["high"] and got["mid"] == pytest.approx(0.5)


def test_delivery(spark):
    sample = spark.createDataFrame([("b", 0), ("a", 1)], "StudyInstanceUID string, position int")
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.8)], "StudyInstanceUID string, t double")
    options = {"identifier": "StudyInstanceUID", "targets": ["t"]}
    delivered = D.validated_delivery(sample, D.deliver(sample, scores, **options), **options)
    assert [r.t for r in delivered.orderBy("position").collect()] == [0.8, 0.2]
    bad = D.deliver(sample, scores.withColumn("t", F.lit(1.1)), **options)
    with pytest.raises(ContractError, match="probability"):
        D.validated_delivery(sample, bad, **options)
    with pytest.raises(ContractError, match="order"):
        D.validated_delivery(sample, delivered.where("position = 0"), **options)


def test_checked_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([("a", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 2), ("a", 3)], "k string, w int")
    with pytest.raises(ContractError, match="right keys"):
        C.checked_join(left, right, ["k"])
    with pytest.raises(ContractError, match="partner"):
        C.checked_join(left, right.limit(1).withColumn("k", F.lit("z")), ["k"], complete=True)


def test_gates(spark):
    runs = spark.createDataFrame([("r1", 2, True), ("r2", 1, True), ("r3", 0, True)], "run string, declared_parts int, complete boolean")
    parts = spark.createDataFrame([("r1", "p1"), ("r1", "p2"), ("r2", "p1"), ("r2", "p2")], "run string, part string")
    gated = C.completeness_gate(runs, parts)
    assert C.single_candidate(gated) == "r1"
    with pytest.raises(ContractError):
        C.single_candidate(gated.where("run = 'r2'"))
    valid = spark.createDataFrame([(True,)] * 8 + [(False,)] * 2, "valid boolean")
    with pytest.raises(ContractError):
        C.enforce_valid_fraction(valid)
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../../b",), ("a/../b",)], "path string")
    assert {r.path for r in C.unsafe_paths(paths).collect()} == {"/a", "a/../../b"}


def test_long_form_requires_columns(spark):
    with pytest.raises(ContractError):
        to_long(spark.range(1), ["t"], {"gold": "{target}__gold"})


@pytest.mark.parametrize("score", [None, float("nan"), float("inf")])
def test_ranks_refuse_scores_without_order(spark, score):
    rows = spark.createDataFrame([("t", 0.5), ("t", score)], "target string, score double")
    with pytest.raises(Exception, match="ranks need finite scores"):
        M.percentile_ranks(rows).collect()


@pytest.mark.parametrize("gold", [0.5, 2.0, -1.0])
def test_gold_outside_the_binary_domain_fails(spark, gold):
    rows = spark.createDataFrame([("t", 1.0, 0.5), ("t", gold, 0.2)], "target string, gold double, score double")
    for measure in (M.auc, M.brier):
        with pytest.raises(Exception, match="gold must be 0 or 1"):
            measure(rows).collect()


def naive_auc(gold, score, weight):
    pairs = [(w * v, (a > b) + 0.5 * (a == b)) for g, a, w in zip(gold, score, weight) if g for h, b, v in zip(gold, score, weight) if not h]
    total = sum(w for w, _ in pairs)
    return sum(w * x for w, x in pairs) / total if total else None


def test_resampled_aucs_equal_the_direct_form(spark):
    """Many slices, ties that span slices, and a target with one class only."""
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 70}", t, int(rng.random() < 0.4), float(rng.choice([0.5, 0.5, 0.5, 0.25, rng.random()]))) for i in range(140) for t in ("x", "y")]
    rows += [(f"s{i}", "z", 1, 0.5) for i in range(4)] + [(None, "x", 1, 0.5)]
    known = spark.createDataFrame(rows, "identifier string, target string, gold int, score double").repartition(5)
    got = {(r.target, r.replicate): r.auc for r in W.resampled_aucs(known, replicates=11, seed=7, rows_per_slice=20).collect()}
    assert len(got) == 33
    weights = {i: W.draws([i], 11, 7)[0] for i in {r[0] for r in rows}}
    for (target, replicate), auc in got.items():
        mine = [r for r in rows if r[1] == target]
        want = naive_auc([r[2] for r in mine], [r[3] for r in mine], [weights[r[0]][replicate] for r in mine])
        assert (auc is None) == (want is None) and (want is None or auc == pytest.approx(want, abs=1e-12))


def test_draws_are_poisson():
    weights = W.draws([f"s{i}" for i in range(400)], 250, 1)
    assert weights.shape == (400, 250)
    assert weights.mean() == pytest.approx(1.0, abs=0.02)
    assert weights.var() == pytest.approx(1.0, abs=0.03)


def test_candidate_aucs_equal_the_fanned_out_form(spark):
    rng = np.random.default_rng(4)
    value = lambda: None if rng.random() < 0.03 else float(rng.choice([0.5, rng.random(), 1.0]))
    rows = [(int(rng.integers(4)), t, int(rng.random() < 0.5), value(), value()) for _ in range(150) for t in ("x", "y")]
    rows += [(9, "z", 1, 0.5, 0.5), (0, "z", 0, 0.5, 0.25)]
    known = spark.createDataFrame(rows, "fold int, target string, gold int, a double, b double").repartition(6)
    weights = B.simplex_weights(2, 0.25)
    folds = B.fold_numbers(known)
    fanned = known.select("fold", "target", "gold", B._fan_out([F.lit(0.0) + F.lit(u) * F.col("a") + F.lit(v) * F.col("b") for u, v in weights]))
    direct = B.held_out_aucs(M.score_counts(fanned, ["fold", "candidate"], check=False), folds, ["candidate"])
    columns = ["target", "candidate", "held_out", "known", "positives", "negatives", "auc"]
    want = sorted((tuple(r) for r in direct.select(columns).collect()), key=repr)
    for size in (10**6, 40):
        got = W.held_out_candidate_aucs(known, ["a", "b"], weights, folds, rows_per_range=size)
        rows_ = sorted((tuple(r) for r in got.select(columns).collect()), key=repr)
        assert [r[:6] for r in rows_] == [r[:6] for r in want]
        assert [r[6] for r in rows_] == [None if r[6] is None else pytest.approx(r[6], abs=1e-12) for r in want]


def test_many_calibration_models_advance_together(spark):
    """Every model equals its own fit; no parameter passes through the driver."""
    rows = spark.range(600 * 12).select(
        (F.col("id") % 600).alias("target"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, 1.0).otherwise(0.0).alias("gold"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(99)) / 99 + 0.005).alias("score"),
    )
    fits = {r.target: r for r in P.fit_platt(rows).collect()}
    assert len(fits) == 600
    assert {r.status for r in fits.values()} == {"fitted", "identity_insufficient_classes"}
    data = {}
    for r in rows.collect():
        data.setdefault(r.target, []).append((math.log(r.score / (1 - r.score)), r.gold))
    for target in range(0, 600, 40):
        fit, points = fits[target], data[target]
        if fit.status != "fitted":
            assert min(sum(g for _, g in points), sum(1 - g for _, g in points)) < 3
            continue
        loss = lambda a, b: sum(math.log1p(math.exp(-abs(a * z + b))) + max(a * z + b, 0) - g * (a * z + b) for z, g in points) / len(points) + 0.01 * ((a - 1) ** 2 + b * b)  # noqa: B023, E731
        best = loss(fit.slope, fit.intercept)
        for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
            a, b = min(max(fit.slope + da, 0.05), 10), min(max(fit.intercept + db, -6), 6)
            assert best <= loss(a, b) + 1e-12
