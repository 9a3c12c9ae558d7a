from __future__ import annotations

import random
import re

import numpy as np
import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import similar
from cohort_spark.llm.components import components
from cohort_spark.llm.overlap import Lists
from cohort_spark.llm.registry import QUERIES
from cohort_spark.llm.shared_keys import Layout

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def planted(rng, n):
    pool = [f"W{i}" for i in range(300)]
    rows = []
    common = " ".join(rng.choice(pool) for _ in range(40))
    for base in range(n):
        words = [rng.choice(pool) for _ in range(rng.choice([1, 3, 6, 8, 30, 60, 200]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(copy) or 1)
                copy[k : k + 1] = rng.choice([[], ["x"], ["y", "new"]])
            rows.append((base * 10 + len(rows), " ".join(copy) + (" " + common if base % 4 == 0 else "")))
    hot = [rng.choice(pool) for _ in range(120)]
    for i in range(60):
        copy = list(hot)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(120)] = rng.choice(pool)
        rows.append((100_000 + i, " ".join(copy).lower()))
    rows += [(None, rows[3][1]), (None, "alone without id"), (5, rows[9][1]), (6, None), (7, ""), (8, " \n"), (9, "a"), (10, "A")]
    return rows


@pytest.mark.parametrize(("seed", "options"), [
    (1, {}), (2, {"block": 7, "task_sets": 5, "plan": Layout(6, 5)}), (3, {"block": 25, "plan": Layout(3, 40)}),
])
def test_against_brute_force(spark, seed, options):
    rows = planted(random.Random(seed), 25)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, chunk string, n int")
    got = similar.join_similar(docs, words=4, percent=85, **options).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_lists_with_long_ones_apart():
    rng = np.random.default_rng(1)
    common = np.arange(1000, 1100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.choice(900, 8 + i % 5, replace=False).astype(np.uint64)])) for i in range(300)]
    sets += [np.sort(np.concatenate([common[:90], np.array([5, 6, 7], np.uint64)])), common]
    sets.sort(key=len)
    lists = Lists(np.concatenate(sets), np.array([len(s) for s in sets]))
    for q in (0, 3, 150, 301):
        want = [
            i for i, s in enumerate(sets)
            if 100 * len(o := np.intersect1d(s, sets[q])) >= 85 * (len(s) + len(sets[q]) - len(o))
        ]
        assert lists.partners(sets[q], percent=85).tolist() == want
    apart = Lists(np.array([2, 4, 6], np.uint64), np.array([3]))
    assert not len(apart.partners(np.array([1, 2, 3, 4, 5], np.uint64)))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    del root[300]
    assert got == {x: r for x, r in root.items() if got.get(x) is not None or any(x in e and e[0] != e[1] for e in edges)}


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "a"), (1, text + " more", "b"), (1, text + " more", "b"), (2, "other words here", "c"), (4, None, "d"), (None, text, "e"), (5, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tie string")
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.tie for r in kept.collect()) == ["b", "c", "d", "f"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert similar.join_similar(docs).count() == 0
    assert similar.one_of_each(docs).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_jaccard_join"](spark, sf).collect()), key=str) == brute(rows)
