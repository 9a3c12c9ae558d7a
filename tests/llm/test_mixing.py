from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import mixing as M
from cohort_spark.llm.registry import QUERIES

DOCS = "doc_id bigint, text string, source string"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by filling step by step: what is above a limit is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > most * sizes[s]]
        if not over:
            return {**full, **{s: left * weight[s] / w for s in rest}}
        full |= {s: most * sizes[s] for s in over}


def corpus(rng, sources, n=300):
    return [(i, " ".join("w" * 3 for _ in range(rng.randrange(40))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 1000, 10_000]) for s in [None, "", "a", "B", "é", "ab"][: 2 + seed]}
    rows = [(s, n) for s, n in sizes.items()] + [("zz", 50)]
    sizes["zz"] = 50
    got = {r.source: r for r in M.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(sizes)
    for s, r in got.items():
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.rate == pytest.approx(want[s] / sizes[s] if sizes[s] else 0.0)


@pytest.mark.parametrize("broadcast", [100, 0])
def test_copies_follow_rate_and_draw(spark, broadcast):
    rows = corpus(random.Random(1), ["a", "b", None]) + [(7, "x y", "a"), (7, "x y", "a"), (None, "z", "b"), (900, None, "c"), (901, "", None)]
    docs = spark.createDataFrame(rows, DOCS)
    table = M.targets(docs.select("source", M.size_of(docs["text"]).alias("size")))
    rate = {r.source: r.rate for r in table.collect()}
    out = M.with_copies(docs, table, broadcast=broadcast).collect()
    assert len(out) == len(rows)
    for r in out:
        key = f"{M.SEED}:{'null' if r.doc_id is None else r.doc_id}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        whole = int(rate[r.source])
        assert r["_mix_copies"] == whole + (u < rate[r.source] - whole)


def test_mix_repeats_rows_under_any_column_names(spark):
    rows = corpus(random.Random(2), ["a", "b"], 80) + [(3, "one two", "a")] * 2 + [(None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.selectExpr("*", "1 AS _mix_rate", "'x' AS _mix_source", "2 AS _mix_copies", "3 AS row", "4 AS one", "5 AS size")
    plain = Counter((r.doc_id, r.text, r.source) for r in M.mix(docs).collect())
    out = M.mix(clash)
    assert out.columns == clash.columns
    kept = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in kept) == plain
    assert {(r["_mix_rate"], r["_mix_source"], r["_mix_copies"], r["row"], r["one"], r["size"]) for r in kept} == {(1, "x", 2, 3, 4, 5)}
    assert max(plain.values()) <= 9


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert M.mix(docs).count() == 0
    assert M.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], DOCS)).count() == 0


def test_taken_words_come_near_the_target(spark):
    rows = QUERIES["op7_mix_sources"](spark, "/root/testdata/sf0.1").collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
    docs = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source").collect()}
    for r in rows:
        taken[docs[r.doc_id]] += r.taken
        target[docs[r.doc_id]] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.1 * t + 25_000
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.03 * sum(target.values())
