from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.core import ContractError
from cohort_spark.operators import audit as A
from cohort_spark.operators import features, metrics
from cohort_spark.plans import stages
from cohort_spark.sources import records as R
from cohort_spark.sources import sinks, tables, units
from cohort_spark.sources.headers import header_failures, read_ordering_headers
from cohort_spark.streaming import ingest
from testbed.image_files import image_file
from testbed.views import load

SF = "/root/testdata/sf0.001"
TARGETS = ("quality", "toxic")


def test_metadata_to_sampling(spark, tmp_path):
    out = stages.metadata_stage(load(spark, SF, "slices"), load(spark, SF, "descriptors"))
    assert out["inventory"].count() == 150
    plan = stages.selection_stage(out["manifest"], slices_per_series=2)["plan"]
    assert plan.count() == 150 * 6
    sinks.write_audit(out["audit"], str(tmp_path / "audit"))
    document = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "audit")).collect()))
    assert document["totals"][0]["dicom_count"] == 6000


def test_evaluation_and_delivery(spark, tmp_path):
    oof = load(spark, SF, "oof")
    out = stages.evaluation_stage(oof, TARGETS, iterations=20)
    assert {r.target for r in out["metrics"].collect()} == set(TARGETS)
    wide = oof.select("StudyInstanceUID", *[f"{t}__prediction" for t in TARGETS])
    sample = load(spark, SF, "sample")
    done = stages.delivery_stage({"a": wide, "b": wide}, sample, TARGETS, calibration=out["parameters"])
    sinks.write_delivery(done, str(tmp_path / "delivery"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "delivery")).collect()]
    assert len(lines) == 201
    header = "StudyInstanceUID," + ",".join(TARGETS)
    assert [i for i, line in enumerate(lines) if line == header] == [0]
    first = sample.orderBy("position").first().StudyInstanceUID
    assert any(line.startswith(first + ",") for line in lines)


def test_ledger_and_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    raw = spark.createDataFrame([("a", '{"k": 1}'), ("b", '{"k": 2'), ("c", None)], "path string, body string")
    parsed = R.parse_json(raw, "body", schema)
    assert [r.k for r in R.good_records(parsed).collect()] == [1]
    assert {r.path for r in R.failed_records(parsed).collect()} == {"b", "c"}
    own = R.parse_with(raw, "body", lambda text: json.loads(text), schema)
    kinds = {r.path: r.error_type for r in R.failed_records(own).collect()}
    assert kinds == {"b": "JSONDecodeError", "c": "TypeError"}
    sinks.write_parts(R.good_records(parsed).coalesce(1), str(tmp_path / "parts"))
    assert tables.read_parts(spark, str(tmp_path / "parts")).count() == 1
    sinks.write_table(raw, str(tmp_path / "t.csv"))
    assert tables.read_table(spark, str(tmp_path / "t.csv")).count() == 3
    sinks.write_ledger(R.failed_records(parsed), str(tmp_path / "ledger.jsonl"))
    assert tables.read_table(spark, str(tmp_path / "ledger.jsonl")).count() == 2
    with pytest.raises(ContractError):
        tables.read_table(spark, "x.txt")
    files = tables.file_inventory(spark, str(tmp_path)).collect()
    assert all(not r.path.startswith("/") for r in files) and files
    with pytest.raises(ValueError):
        units.sample_units(raw, 21, "path")
    (tmp_path / "runs" / "e1").mkdir(parents=True)
    (tmp_path / "runs" / "e1" / "m.json").write_text('{"macro_auc": 0.7}')
    row = tables.read_metric_files(spark, str(tmp_path / "runs" / "*" / "m.json")).first()
    assert (row.experiment, row.macro_auc) == ("e1", 0.7)


def test_stream_resumes_with_new_files_only(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    source = tmp_path / "in"
    rows = spark.createDataFrame([("a", '{"k": 1}'), ("b", "{")], "path string, body string")
    options = {
        "body": "body",
        "schema": schema,
        **{k: str(tmp_path / k) for k in ("output", "ledger", "manifest", "checkpoint")},
    }

    def run():
        stream = ingest.record_stream(spark, str(source), rows.schema, files_per_trigger=1)
        ingest.ingest_stream(stream, **options).awaitTermination()
        return spark.read.parquet(options["manifest"]).agg(F.sum("discovered"), F.sum("failed"), F.count("*")).first()

    rows.coalesce(1).write.mode("append").parquet(str(source))
    assert tuple(run()) == (2, 1, 1)
    assert tuple(run()) == (2, 1, 1)
    rows.withColumn("path", F.concat("path", F.lit("2"))).coalesce(1).write.mode("append").parquet(str(source))
    assert tuple(run()) == (4, 2, 2)
    assert spark.read.parquet(options["output"]).count() == 2


def test_audit_document_has_every_row(spark, tmp_path):
    """Many rows, repeated rows, an empty node and a name that needs quoting; NaN is refused."""
    nodes = {
        "many": spark.range(3000).selectExpr("id", "cast(null AS string) AS x"),
        "empty": spark.range(0).toDF("a"),
        'odd "name"': spark.createDataFrame([(1,), (1,), (2,)], "a int"),
        "text": spark.createDataFrame([("a,\n]\"",)], "t string"),
    }
    audit = A.assemble_audit(spark, nodes)
    sinks.write_audit(audit, str(tmp_path / "audit"))
    document = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "audit")).collect()))
    assert set(document) == set(nodes)
    assert sorted(r["id"] for r in document["many"]) == list(range(3000)) and document["many"][0]["x"] is None
    assert document["empty"] == [] and document['odd "name"'] == [{"a": 1}, {"a": 1}, {"a": 2}] and document["text"] == [{"t": "a,\n]\""}]
    broken = A.assemble_audit(spark, {"x": spark.createDataFrame([(float("nan"),)], "v double")})
    with pytest.raises(Exception, match="NaN"):
        sinks.write_audit(broken, str(tmp_path / "broken"))


def test_totals_and_sketches_of_parts(spark):
    rows = spark.range(5000).selectExpr(
        "concat('p', id % 40) AS PatientID", "concat('t', id % 300) AS StudyInstanceUID", "concat('e', id % 900) AS SeriesInstanceUID",
        "if(id % 10 = 0, null, concat('o', id % 4000)) AS SOPInstanceUID", "id % 7 AS part",
    )
    exact = A.totals(rows).first().asDict()
    assert exact == {"dicom_count": 5000, "study_count": 300, "series_count": 900, "sop_count": 3600, "patient_count_if_recoverable": 40}
    united = A.united_totals(A.total_sketches(rows, ["part"])).first().asDict()
    whole = A.totals(rows, approximate=True).first().asDict()
    for found in (united, whole):
        assert found["dicom_count"] == 5000
        assert all(abs(found[k] - exact[k]) <= 0.02 * exact[k] for k in exact)
    none = A.totals(rows.limit(0).drop("PatientID")).first().asDict()
    assert none == {"dicom_count": 0, "study_count": 0, "series_count": 0, "sop_count": 0, "patient_count_if_recoverable": None}
    assert A.totals(rows.withColumn("PatientID", F.lit(None).cast("string"))).first()["patient_count_if_recoverable"] is None


def test_fingerprints_promotion_and_placeholders(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name, body in (("a.bin", b"abc"), ("b.bin", bytes(3)), ("none.bin", b"")):
        (tmp_path / "files" / name).write_bytes(body)
    found = {r.path.rsplit("/", 1)[-1]: r.digest for r in tables.fingerprint_files(spark, str(tmp_path / "files")).collect()}
    assert found == {"a.bin": hashlib.sha256(b"abc").hexdigest(), "b.bin": hashlib.sha256(bytes(3)).hexdigest()}
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.75), ("c", 0.75), ("d", None)], "experiment string, macro_auc double")
    rows = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3)], "experiment string, v int")
    sinks.promote(metrics.leaderboard(scores), rows, str(tmp_path / "best"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "best")).collect()) == [2, 3]
    reports = spark.createDataFrame([("s1", ["one.", "two."]), ("s2", []), ("s3", None)], "StudyInstanceUID string, sentences array<string>")
    encoded = features.with_placeholder(reports)
    assert sorted(tuple(r) for r in encoded.collect()) == [("s1", "one."), ("s1", "two."), ("s2", "No report text."), ("s3", "No report text.")]


def test_ordering_headers_of_files(spark, tmp_path):
    """All syntaxes, long headers, files without tags, and files that are none."""
    axial = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    good = {
        "study/series/a.dcm": image_file(3, [0.0, 0.0, 7.5], axial),
        "study/series/b": image_file(2, [1.0, 2.0, 3.5], axial, padding=200_000),
        "study/series/c.dcm": image_file(1, None, None, syntax="1.2.840.10008.1.2"),
        "study/other/d.dcm": image_file(None, [0.0, 0.0, -1.0], axial, syntax="1.2.840.10008.1.2.2"),
        "study/other/e.dcm": image_file(9, [0.0, 0.0, 1.0], axial)[:-4108],
    }
    bad = {"study/other/empty.dcm": b"", "study/other/text.txt": b"no image" * 99, "study/other/cut.dcm": image_file(1, [0.0] * 3, axial)[:200], "study/other/odd.dcm": image_file(1, None, None)[:170] + bytes(300)}
    for name, body in {**good, **bad}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    headers = read_ordering_headers(spark, str(tmp_path), leading_bytes=512, files_per_partition=2)
    rows = {r.path: r for r in headers.collect()}
    assert set(rows) == {*good, *bad}
    assert {p for p, r in rows.items() if r.error_type} == set(bad)
    assert rows["study/series/a.dcm"].ImagePositionPatient == [0.0, 0.0, 7.5] and rows["study/series/b"].InstanceNumber == 2
    assert rows["study/series/c.dcm"].ImagePositionPatient is None and rows["study/series/c.dcm"].InstanceNumber == 1
    assert rows["study/other/d.dcm"].ImageOrientationPatient == axial and rows["study/other/e.dcm"].InstanceNumber == 9
    assert header_failures(headers).first().asDict() == {"discovered": 9, "readable": 5, "failed": 4}
    out = stages.file_stage(spark, str(tmp_path))
    ordered = {r.SeriesInstanceUID: r for r in out["manifest"].collect()}
    assert [p.rsplit("/", 1)[-1] for p in ordered["series"].ordered_dicom_paths] == ["c.dcm", "b", "a.dcm"]
    assert out["failures"].count() == 4
