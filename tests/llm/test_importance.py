from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import bytes as B
from cohort_spark.llm import importance as I
from cohort_spark.llm.registry import QUERIES

DOCS = "doc_id bigint, text string, quality string"


def corpus(rng, n=300):
    pool = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 60))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "clash"))
    return rows


def test_counts_cover_all_texts_and_batches_do_not_matter(spark):
    rows = corpus(random.Random(1), 60) + [(100, None, ""), (101, "", ""), (102, "one", "")]
    got = I.bucket_counts(spark.createDataFrame(rows, DOCS).repartition(7))
    want = np.zeros(I.BUCKETS, np.int64)
    for _, text, _ in rows:
        found, bounds = I.features(*B.raw(pa.array([text], pa.string())))
        assert bounds[-1] == len(found)
        n = len((text or "").split())
        assert len(found) == sum(max(0, n - k + 1) for k in (1, 2, 3, 1, 2))
        want += np.bincount(found, minlength=I.BUCKETS)
    assert (got == want).all()


def test_kth_largest_against_sorting(spark):
    rng = random.Random(2)
    for values in ([5], [3] * 9, [rng.randrange(-(10**18), 10**18) for _ in range(200)], [rng.randrange(6) for _ in range(50)]):
        frame = spark.createDataFrame([(v,) for v in values], "v bigint")
        ordered = sorted(values, reverse=True)
        for k in {1, len(values) // 2 + 1, len(values)}:
            edge, left = I.kth_largest(frame, k, bins=16)
            assert edge == ordered[k - 1]
            assert left == k - sum(v > edge for v in values)


def test_top_k_is_exact_with_ties(spark):
    rows = [(i, 7 if i % 3 else 9) for i in range(30)] + [(None, 7), (99, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, _imp_key bigint")
    for k in (0, 4, 10, 15, 31, 50):
        kept = [r.doc_id for r in frame.where(I.among_top(frame, k)).collect()]
        key = lambda r: (-r[1], -1 if r[0] is None else r[0])
        want = [r[0] for r in sorted((r for r in rows if r[1] is not None), key=key)[:k]]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_gumbel_draw_follows_weights(spark):
    rows = [(i, 0.0 if i % 2 else float(I.TEMPERATURE * np.log(3))) for i in range(8000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, _imp_score double").withColumn("_imp_key", I.key_of())
    kept = [r.doc_id for r in frame.where(I.among_top(frame, 400)).collect()]
    assert len(kept) == 400
    assert 0.68 < sum(i % 2 == 0 for i in kept) / 400 < 0.82
    assert kept == [r.doc_id for r in frame.where(I.among_top(frame, 400)).collect()]


def test_resample_rejects_junk_and_keeps_the_rest(spark):
    rows = corpus(random.Random(4)) + [(None, "word1 word2 word3 " * 9, ""), (7, corpus(random.Random(4))[7][1], ""), (500, None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 300, 2)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    kept = I.resample(docs, labels, below=0.01)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not [i for i in ids if i is not None and (i % 5 == 0)]
    assert len([i for i in ids if i is not None]) >= 230


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int")
    assert I.resample(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b c", ""), (2, "", "")], DOCS)
    assert [r.doc_id for r in I.resample(some, labels).collect()] == [1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_hidden_labels(spark, sf):
    """Half of the labels are hidden from the fit; the draw must treat those rows like the shown ones."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "quality")
    hidden = F.pmod(F.xxhash64(F.lit("hide"), F.col("doc_id")), F.lit(2)) == 0
    kept = I.resample(docs, labels.where(~hidden)).select("doc_id", F.lit(True).alias("kept"))
    rows = labels.join(kept, "doc_id", "left").groupBy("quality", hidden.alias("hidden")).agg(F.count("kept") / F.count("*")).collect()
    share = {(r[0], r[1]): r[2] for r in rows}
    for shown_or_hidden in (True, False):
        assert share[1, shown_or_hidden] >= 0.95
        assert share[0, shown_or_hidden] <= 0.05


def test_score_does_not_depend_on_neighbours_or_own_label(spark):
    rows = corpus(random.Random(8), 80)
    docs = spark.createDataFrame(rows + rows[:5], DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(40)] + [(1, 0), (6, None)], "doc_id bigint, quality int")
    one = {(r.doc_id, r._imp_score) for r in I.score_all(docs.repartition(1), labels).slim().collect()}
    many = {(r.doc_id, r._imp_score) for r in I.score_all(docs.repartition(9), labels).slim().collect()}
    assert one == many
    assert len(one) == len(rows)


def test_clashing_columns(spark):
    rows = corpus(random.Random(4), 60)
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.selectExpr("*", "'a' AS _imp_score", "'b' AS _imp_key", "'c' AS row", "'d' AS label", "'e' AS fold", "1 AS score", "2 AS slot")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 60, 2)], "doc_id bigint, quality int")
    out = I.resample(clash, labels)
    assert out.columns == clash.columns
    assert {(r._imp_score, r._imp_key, r["row"], r.label, r.fold, r.score, r.slot) for r in out.collect()} == {("a", "b", "c", "d", "e", 1, 2)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in I.resample(docs, labels).collect())


def test_query_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op1_importance_resampling"](spark, sf)
    judged = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = [r.kept == (r.quality == 1) for r in judged]
    assert np.mean(right) > 0.95
