"""Queries whose own files and state must grow no faster than their tables."""

from __future__ import annotations

import unicodedata
from datetime import timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.functions import text as X
from cohort_spark.operators import audit as A
from cohort_spark.operators import blending as B
from cohort_spark.operators import labels as L
from cohort_spark.operators import manifest as M
from cohort_spark.operators import metrics as E
from cohort_spark.operators import vector_auc as W
from cohort_spark.streaming import status as S
from testbed import ingest_queries as Q


def test_image_files_do_not_grow_with_the_key(spark, tmp_path):
    rows = [(2_000_001, 1), (2_000_003, 2), (2_000_007, 3), (2_000_199, 4)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("images-*"))
    found = {r.file: (r.number, r.coordinate, r.readable) for r in Q.ordering_headers(spark, str(tmp_path)).collect()}
    assert found == {2_000_001: (1, 1_000_000.5, True), 2_000_003: (None, None, False), 2_000_007: (None, None, False), 2_000_199: (4, 1_000_099.5, True)}
    (folder,) = set(root.glob("images-*")) - before
    assert sum(f.stat().st_size for f in folder.glob("*.dcm")) < 100_000


def test_groups_of_one_slot_are_settled_together(spark, tmp_path):
    """Calls to Python follow the slots, not the groups; alarms of several groups meet in one timer."""
    first = [("a", "1", 3, "2020-01-01"), ("a", "2", None, "2020-01-01"), ("b", "1", 2, "2020-01-01"), (None, "1", 1, "2020-01-01"), ("d", None, 2, "2020-01-02")]
    first += [("e", "1", None, "2020-01-04"), ("null", "1", 2, "2020-01-04"), ('q"\\', "1", 1, "2020-01-04"), ("z", "1", 1, "2020-01-08T06:00:00")]
    second = [("b", "2", 2, "2020-01-09"), ("a", "3", 3, "2020-01-09"), ("q\"\\", "2", 1, "2020-01-09"), ("y", "1", 1, "2020-02-10")]
    schema, out = "g string, m string, n int, t timestamp", []
    with S.state_store(spark):
        for batch in (first, second):
            rows = spark.createDataFrame(batch, "g string, m string, n int, t string").selectExpr("g", "m", "n", "cast(t AS timestamp) AS t")
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            found = S.group_status(stream, group=["g"], member="m", expected="n", event_time="t", late="12 hours", wait=timedelta(days=3), keep=timedelta(days=60), slots=1)
            query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            out.append(sorted(((r.g, r.status, r.found, r.expected) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr))
    at_first = [(None, "complete", 1, 1), ("a", "incomplete", 2, 3), ("b", "incomplete", 1, 2), ("d", "incomplete", 0, 2)]
    at_first += [("e", "incomplete", 1, None), ("null", "incomplete", 1, 2), ('q"\\', "complete", 1, 1), ("z", "complete", 1, 1)]
    assert out[0] == sorted(at_first, key=repr)
    assert out[1] == sorted([*at_first, ("a", "late", 3, 3), ("b", "late", 2, 2), ("y", "complete", 1, 1)], key=repr)


def test_status_keys_of_several_types_read_back(spark, tmp_path):
    rows = spark.sql("SELECT 9007199254740993 AS k, date'2020-01-02' AS d, timestamp'2020-01-02 03:04:05.123456' AS s, 1.10BD AS c, cast('NaN' AS double) AS f, 'm' AS m, 1 AS n, timestamp'2020-01-01' AS t UNION ALL SELECT NULL, NULL, NULL, NULL, 0.1D, 'm', 1, timestamp'2020-01-01'")
    rows.write.parquet(f"{tmp_path}/in")
    keys = ["k", "d", "s", "c", "f"]
    with S.state_store(spark):
        found = S.group_status(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), group=keys, member="m", expected="n", event_time="t")
        assert found.schema[:5].simpleString() == rows.select(*keys).schema.simpleString()
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, seen.select(*keys).collect())) == sorted(map(repr, rows.select(*keys).collect()))


def test_scripts_and_tokens_of_any_text_without_matching_every_token(spark):
    texts = ["", None, "The knee, and the joint.", "épanchement du genou: ªº K", "Колено и the ставa", "γόνατο ñ x²the ①de", "日本 ひらがな the", "ab1the2la_de", "𝔘the 𐐷 la"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    words = {w for t in (X.LATIN_MARKERS, X.CYRILLIC_MARKERS) for ws in t.values() for w in ws}
    total = lambda t: sum(unicodedata.category(c)[0] == "L" for c in t)
    profile = {r.k: r.n for r in L.script_profile(docs, "t", ["k"]).groupBy("k").agg(F.sum("letters").alias("n")).collect()}
    assert profile == {i: total(t) for i, t in enumerate(texts) if t and total(t)}
    runs = lambda t: "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("No", "Nl") else " " for c in t).split()
    found = {r.k: r.m for r in docs.where("t IS NOT NULL").select("k", X.marker_tokens(F.lower("t")).alias("m")).collect()}
    assert {k: sorted(m) for k, m in found.items()} == {i: sorted(words & set(runs(t.lower()))) for i, t in enumerate(texts) if t is not None}
    plan = L.with_language(docs, "t", is_composed=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


HEADERS = (
    "StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, dicom_path string, SpatialSliceCoordinate double, "
    "InstanceNumber bigint, PatientID string, Manufacturer string, MagneticFieldStrength double"
)


def _headers(spark, rows):
    """A header table that counts the rows read from it."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, HEADERS).mapInArrow(count, HEADERS), read


ROWS = [
    ("s1", "a", "1", "s1/a/1", 2.0, 1, "p", None, 1.5), ("s1", "a", "1", "s1/a/2", 2.0, 2, "p", "m", 1.5), ("s1", "a", None, "x/3", None, 3, "p", "m", None),
    ("s2", "b", "4", "s2/b/4", float("nan"), 1, None, "n", 3.0), ("s2", "b", "5", "s2/b/5", 1.0, 2, None, "n", float("nan")), ("s2", None, "6", "f", 0.0, 1, None, "n", 3.0),
    ("s3", None, "7", "g", -0.0, None, "q", "n", 3.0), (None, "c", "8", "h/i", 7.0, 1, "q", "n", 3.0), ("s4", "c", "9", "h/j", 8.0, 2, "", "n", 3.0),
]


def test_manifest_reads_its_headers_twice(spark):
    slices, read = _headers(spark, ROWS)
    found = {(r.StudyInstanceUID, r.SeriesInstanceUID): (r.slice_count, r.unique_sop_count, r.Manufacturer) for r in M.series_manifest(slices).collect()}
    assert found == {("s1", "a"): (3, 1, "m"), ("s2", "b"): (2, 2, "n"), ("s2", None): (1, 1, "n"), ("s3", None): (1, 1, "n"), (None, "c"): (1, 1, "n"), ("s4", "c"): (1, 1, "n")}
    assert read.value == 2 * len(ROWS)
    sliced = M.series_manifest(slices, rows_per_task=1, rows_per_chunk=2)
    assert sliced.schema.simpleString() == M.series_manifest(slices).schema.simpleString()
    again = {(r.StudyInstanceUID, r.SeriesInstanceUID): (r.slice_count, r.unique_sop_count, r.Manufacturer) for r in sliced.where("chunk = 0").collect()}
    assert again == found


@pytest.mark.parametrize("rows", [ROWS, []])
def test_header_audit_is_its_single_audits_from_one_reading(spark, rows):
    slices, read = _headers(spark, rows)
    got = A.header_audit(slices)
    assert read.value == len(rows)
    plain = spark.createDataFrame(rows, HEADERS)
    single = {
        "totals": A.totals(plain), "missingness": A.missingness(plain), "duplicate_identifier_rows": A.duplicate_ids(plain),
        "series_slice_distribution": A.group_size_distribution(plain), "series_slice_frequency": A.group_size_frequency(plain),
        "geometry": A.ordering_reliability(plain), "categorical_distributions": A.value_distributions(plain),
        "relative_path_depth_distribution": A.path_depths(plain),
    }
    want = A.assemble_audit(spark, single)
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_fusion_holds_one_range_or_one_batch_at_a_time(spark, monkeypatch):
    """Scores that crowd, tie or lie far off, in small batches: what Python holds follows the set sizes, not the rows."""
    rng = np.random.default_rng(5)
    near = lambda i: 0.5 if i % 3 == 0 else float(0.5 + rng.random() * 1e-6)
    rows = [(i % 3, t, int(rng.random() < 0.5), near(i), near(i + 1)) for i in range(3000) for t in ("x", None)] + [(0, "x", 1, 1e9, -1e9)]
    known = spark.createDataFrame(rows, "fold int, target string, gold int, a double, b double").repartition(3)
    range_sums, packed = W._range_sums, W._packed

    def checked_sums(*args):
        work = range_sums(*args)

        def checked(table):
            cells = sum(len(x.as_py()) // 8 for x in table["scores"])
            assert cells <= 400 and table.num_rows <= 6, (cells, table.num_rows)
            return work(table)

        return checked

    def checked_packed(*args):
        work = packed(*args)

        def checked(batches):
            for out in work(batches):
                assert out.nbytes < 4_000_000, out.nbytes
                yield out

        return checked

    weights, folds = B.simplex_weights(2, 0.005), [0, 1, 2]
    monkeypatch.setattr(W, "_range_sums", checked_sums)
    monkeypatch.setattr(W, "_packed", checked_packed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = W.held_out_candidate_aucs(known, ["a", "b"], weights, folds, rows_per_range=200).where("candidate IN (0, 77, 200)").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fanned = known.select("fold", "target", "gold", B._fan_out([F.lit(0.0) + F.lit(u) * F.col("a") + F.lit(v) * F.col("b") for u, v in weights])).where("candidate IN (0, 77, 200)")
    want = B.held_out_aucs(E.score_counts(fanned, ["fold", "candidate"], check=False), folds, ["candidate"]).collect()
    key = lambda r: (r.target or "", r.candidate, r.held_out)
    found, direct = {key(r): r for r in got}, {key(r): r for r in want}
    assert len(found) == 18 and found.keys() == direct.keys()
    for k, r in direct.items():
        assert (found[k].known, found[k].positives, found[k].negatives) == (r.known, r.positives, r.negatives)
        assert found[k].auc == pytest.approx(r.auc, abs=1e-12)
