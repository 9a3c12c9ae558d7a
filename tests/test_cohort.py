from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.core import ContractError, durable
from cohort_spark.operators import cohort as C
from cohort_spark.operators import contracts as K
from cohort_spark.operators import folds as D
from cohort_spark.operators import placement as P


@pytest.fixture(scope="module")
def patients(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(40):
        rows.append((f"p{s % 30}", f"s{s}", "ab"[s % 2], int(rng.random() < 0.4), None if rng.random() < 0.5 else int(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "patient_id string, study_id string, site string, target_a int, target_b int")


def test_folds_are_disjoint_balanced_and_repeatable(patients):
    options = {"group": "patient_id", "targets": ["target_a", "target_b"], "n_splits": 4, "restarts": 8}
    first = D.assign_folds(patients, **options)
    again = {r.study_id: r.fold for r in D.assign_folds(patients, **options).collect()}
    assert {r.study_id: r.fold for r in first.collect()} == again
    K.assert_group_disjoint(first, "patient_id")
    K.assert_train_valid_disjoint(first, validation_fold=1, keys=["study_id", "patient_id"])
    per = first.groupBy("fold").agg(F.sum("target_a").alias("p"), F.count("target_b").alias("k")).collect()
    assert len(per) == 4
    assert max(r.p for r in per) - min(r.p for r in per) <= 2
    assert max(r.k for r in per) - min(r.k for r in per) <= 2
    quality = D.fold_objective(first, ["target_a", "target_b"], n_splits=4).first()
    hashed = patients.withColumn("fold", (F.pmod(F.xxhash64("patient_id"), F.lit(4))).cast("int"))
    worse = D.fold_objective(hashed, ["target_a", "target_b"], n_splits=4).first()
    assert quality.objective <= worse.objective


def test_slices_place_about_as_well_as_one_task(spark):
    """Waves of slices carry holdings; the balance stays near that of one search over all profiles."""
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    table = spark.range(6000).select(
        F.concat(F.lit("g"), F.when(draw(9, 3) == 0, F.lit(0)).otherwise(F.col("id") % 3500).cast("string")).alias("g"),
        *[(draw(k, 10) < k).cast("int").alias(f"t{k}") for k in range(1, 6)],
        F.when(draw(7, 100) < 2, 1).when(draw(7, 100) < 60, 0).alias("rare"),
    )
    targets = [*(f"t{k}" for k in range(1, 6)), "rare"]
    matrix = durable(D.group_matrix(table, "g", targets))
    options = {"n_splits": 5, "seed": 3, "restarts": 6}
    placed, whole, _ = P.place_profiles(matrix, **options)
    profiles = placed.count()
    assert profiles > 200
    sliced, parted, _ = P.place_profiles(matrix, **options, slice_rows=40)
    waved, waves = P._waves(matrix.withColumns({"load": F.col("size"), "name": F.xxhash64("group")}), 40)
    assert waves > 2
    assert waved.groupBy("wave", "slice").count().agg(F.max("count")).first()[0] < 200
    # The group of a third of all rows makes both uneven.
    assert parted < 2 * whole + 1e-3
    assert sliced.select(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))).first()[0] == matrix.count()
    assigned = P.place_groups(matrix, **options, slice_rows=40, rows_per_task=100)
    assert assigned.count() == assigned.select("group").distinct().count() == matrix.count()
    joined = table.join(assigned, table["g"] == assigned["group"])
    assert D.fold_objective(joined, targets, n_splits=5).first().objective == pytest.approx(parted, abs=1e-9)


def test_pouring_is_the_cheapest_way():
    rng = np.random.default_rng(5)
    for _ in range(200):
        folds, restarts = int(rng.integers(2, 5)), 2
        cost, square = rng.normal(size=(restarts, folds)) * rng.choice([0, 1, 5]), rng.random(restarts) + 0.1
        copies = rng.integers(1, 8, restarts)
        got = P._pour(cost, square, copies)
        for r in range(restarts):
            price = lambda n: 2 * (n * cost[r]).sum() + square[r] * (n * n).sum()  # noqa: B023, E731
            ways = [np.array(n) for n in itertools.product(range(copies[r] + 1), repeat=folds) if sum(n) == copies[r]]
            assert got[r].sum() == copies[r]
            assert price(got[r]) == pytest.approx(min(map(price, ways)))


def test_fold_inputs_are_checked(patients):
    with pytest.raises(ContractError, match="binary"):
        D.assign_folds(patients.withColumn("target_a", F.lit(3)), group="patient_id", targets=["target_a"])
    with pytest.raises(ContractError, match="missing values"):
        D.assign_folds(patients.withColumn("patient_id", F.lit(None).cast("string")), group="patient_id", targets=["target_a"])
    with pytest.raises(ContractError, match="fewer groups"):
        D.assign_folds(patients.limit(2), group="study_id", targets=["target_a"], n_splits=5)
    leaky = patients.withColumn("fold", (F.col("study_id") == "s0").cast("int"))
    with pytest.raises(ContractError, match="span"):
        K.assert_group_disjoint(leaky, "patient_id")


def test_leakage_groups(spark):
    table = spark.createDataFrame([("a", "shared"), ("b", " shared "), ("c", None), ("d", "unique")], "StudyInstanceUID string, PatientID string")
    got = {r.StudyInstanceUID: (r.leakage_group, r.group_source) for r in C.leakage_group(table).collect()}
    assert got == {
        "a": ("shared", "PatientID"),
        "b": ("shared", "PatientID"),
        "c": ("study::c", "PatientID"),
        "d": ("unique", "PatientID"),
    }
    alone = C.leakage_group(table.where("StudyInstanceUID <> 'b'")).collect()
    assert {r.group_source for r in alone} == {"StudyInstanceUID"}


def test_training_cohort(spark):
    train = spark.createDataFrame([(f"s{i}", 1.0 if i == 0 else 0.0 if i == 1 else None) for i in range(10)], "StudyInstanceUID string, ACL double")
    weak = spark.createDataFrame(
        [(f"s{i}", 0.05 + 0.1 * i, 0.1 + i * 0.8 / 9) for i in range(10)],
        "StudyInstanceUID string, ACL__semantic_probability double, ACL__rule_probability double",
    )
    inventory = spark.createDataFrame([(f"s{i}", f"p{i // 2}") for i in range(10)], "StudyInstanceUID string, PatientID string")
    cohort = C.training_cohort(train, weak, inventory, ["ACL"], n_splits=2, restarts=4)
    rows = {r.StudyInstanceUID: r for r in cohort.collect()}
    assert len(rows) == 10 and rows["s0"].group_source == "PatientID"
    assert rows["s0"].ACL__train == 1.0 and rows["s1"].ACL__train == 0.0
    assert rows["s5"].ACL__train == pytest.approx(0.5 * 0.55 + 0.5 * (0.1 + 4 / 9), abs=1e-6)
    assert (rows["s0"].ACL__gold_mask, rows["s5"].ACL__gold_mask) == (1, 0)
    assert rows["s0"].ACL__train_fold_0 == 1.0 and rows["s9"].ACL__train_fold_1 is not None
    K.assert_group_disjoint(cohort, "leakage_group")
    audit = C.training_audit(cohort, ["ACL"]).first()
    assert audit.gold_study_count == 2
    split = D.fold_split(cohort, ["ACL"], validation_fold=1)
    D.assert_split_filled(split)
    with pytest.raises(ContractError, match="unique"):
        C.training_cohort(train.union(train), weak, inventory, ["ACL"], n_splits=2)
    with pytest.raises(Exception, match="weak probabilities"):
        C.weak_rows(train, weak.withColumn("ACL__rule_probability", F.lit(3.0)), ["ACL"]).collect()


@pytest.mark.parametrize("limit", [None, 3])
def test_proxy_marks_the_top_share(spark, limit):
    rows = [(f"s{i}", "t", 1.0 if i == 0 else 0.0 if i < 4 else None, i / 20) for i in range(20)]
    table = spark.createDataFrame(rows, "StudyInstanceUID string, target string, gold double, weak double")
    got = {r.StudyInstanceUID: r.proxy for r in C.stratify_proxy(table, rows_per_task=limit).collect()}
    assert {k for k, v in got.items() if v} == {"s0", "s14", "s15", "s16", "s17", "s18", "s19"}


def test_external_labels(spark):
    studies = spark.createDataFrame([("a",), ("b",)], "StudyInstanceUID string")
    external = spark.createDataFrame([("b", 0.2), ("a", 0.8)], "uid string, t double")
    got = {r.StudyInstanceUID: r.t__rule_probability for r in C.align_external(external, studies, ["t"], external_id="uid").collect()}
    assert got == {"a": 0.8, "b": 0.2}
    with pytest.raises(ContractError, match="differ"):
        C.align_external(external.limit(1), studies, ["t"], external_id="uid")
    with pytest.raises(ContractError, match="t is in"):
        C.align_external(external.withColumn("t", F.lit(1.2)), studies, ["t"], external_id="uid")
