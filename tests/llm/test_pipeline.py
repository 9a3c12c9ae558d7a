from __future__ import annotations

import pytest
import test_contamination
import test_similar
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Rows before and after every stage."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    out = [rows]
    for number, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(number))
        stage(spark, rows, SF).write.parquet(path)
        rows = spark.read.parquet(path)
        out.append(rows)
    return out


def test_columns_and_order(staged):
    assert [name for name, _ in P.STAGES][0] == "quality classifier" and len(P.STAGES) == 5
    for rows in staged[1:-1]:
        assert sorted(rows.columns) == sorted(staged[0].columns)
    assert staged[-1].columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_follows_labels(spark, staged):
    kept = {r.doc_id for r in staged[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in kept) == (r.quality == 1) for r in labels]
    assert sum(right) / len(right) > 0.93


def test_one_of_each_group(staged):
    before = [(r.doc_id, r.text) for r in staged[1].collect()]
    sets = []
    for doc_id, text in before:
        w = test_similar.WORD.findall(text.lower())
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    group = {d: d for d, _ in sets}
    for _ in range(3):
        for i, (d, a) in enumerate(sets):
            for e, b in sets[:i]:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[d] = group[e] = min(group[d], group[e])
    assert sorted(r.doc_id for r in staged[2].select("doc_id").collect()) == sorted(set(group.values()))


def test_contaminated_documents_go(spark, staged):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r.doc_id for r in staged[2].collect() if not test_contamination.brute(r.text, items)[4])
    assert sorted(r.doc_id for r in staged[3].collect()) == want


def test_mix_repeats_and_thins(staged):
    copies = {r.doc_id: r["count"] for r in staged[4].groupBy("doc_id").count().collect()}
    assert set(copies) <= {r.doc_id for r in staged[3].select("doc_id").collect()}
    assert 1 <= min(copies.values()) and max(copies.values()) <= 3


def test_all_tokens_are_in_the_files(staged):
    mixed = staged[4].count()
    last = staged[5].orderBy("start").collect()
    assert len(last) == mixed
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(last, last[1:], strict=False))


def test_run(spark, staged):
    got = P.run(spark, SF).agg(F.count("*"), F.sum("ids_crc32"), F.max("start")).first()
    assert got == staged[5].agg(F.count("*"), F.sum("ids_crc32"), F.max("start")).first()


def test_stages_take_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words are here", "en", None, 4)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            assert stage(spark, docs, SF).count() <= 3 * max(1, len(rows))
