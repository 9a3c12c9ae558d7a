from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import toxicity as X
from cohort_spark.llm.registry import QUERIES

DOCS = "doc_id bigint, text string, toxic string"
BAD = ["vile", "rotten", "FOUL", "nasty"]


def corpus(rng, n):
    pool = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(pool) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "!!", "***"])
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, rng.randrange(2), int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(1), 900)
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels[:500] + [(5, 0, 0), (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    chain, held, targets = X.train(docs, known, X.default_categories())
    assert chain.categories == ["toxic_prose", "toxic_junk", "toxic"]
    assert np.mean((held[:, 2] > 0) == (targets["toxic"] > 0)) > 0.97
    judged = X.predict(docs, chain).select("doc_id", X.flagged().alias("flag")).collect()
    right = [r.flag == (labels[r.doc_id][2] == 1) for r in judged if r.doc_id >= 500]
    assert len(judged) == 900 and np.mean(right) > 0.98


def test_later_models_use_earlier_probabilities():
    # The second category is the first one, with words that say nothing: only the chain can tell.
    rng = np.random.default_rng(2)
    y = rng.random(600) < 0.5
    words = [np.unique(np.append(rng.integers(10, 400, 20), rng.integers(1, 5) if y[i] else rng.integers(5, 9))).astype(np.uint64) for i in range(600)]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    chain, held = X.fit_chain(np.concatenate(words), first, {"a": y.astype(int), "b": y.astype(int)}, np.arange(600) % 3)
    assert chain.models[1].earlier[0] > 0
    assert np.mean((held[:, 0] > 0) == y) > 0.95
    # Every out-of-fold value comes from a model without the row: shuffled targets are not learnt.
    noise = rng.random(600) < 0.5
    _, held = X.fit_chain(np.concatenate(words), first, {"n": noise.astype(int)}, np.arange(600) % 3)
    assert np.mean((held[:, 0] > 0) == noise) < 0.6


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "vile", "z")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain, _, _ = X.train(docs, none, X.default_categories())
    rows = X.predict(docs, chain).collect()
    assert len(rows) == 3 and len({r["_tox_toxic"] for r in rows}) == 1
    one_class = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    chain, _, _ = X.train(docs, one_class, X.default_categories())
    assert X.predict(docs, chain).where(X.flagged()).count() == 0
    assert X.predict(docs.limit(0), chain).count() == 0


def test_query_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity_chain"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    joined = rows.withColumnRenamed("toxic", "flag").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert joined.where((F.col("toxic") == 0) & F.col("flag")).count() <= 2
    assert joined.where((F.col("toxic") == 1) & F.col("flag")).count() >= 40
