from __future__ import annotations

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import runs as R
from cohort_spark.llm.registry import QUERIES


def brute(w, exponent=4, least=6):
    """Every run by trying each period at each place; its smallest period only."""
    found, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[i + k] == w[i + k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def text(rng):
    n, letters = rng.randrange(70), "ab" if rng.random() < 0.4 else "abcd"
    if rng.random() < 0.3:
        return [rng.choice(letters) for _ in range(n)]
    w = []
    while len(w) < n:
        loop = [rng.choice(["a", "b", "é", "Ab"]) for _ in range(rng.randrange(1, 7))]
        w += (loop * 30)[: rng.randrange(1, 40)]
    return w


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 5), (4, 30), (5, 1)])
def test_runs_against_brute_force(exponent, least):
    rng = random.Random(exponent * 100 + least)
    for _ in range(150):
        words = [text(rng) for _ in range(rng.randrange(5))]
        spaced = [rng.choice(["", " \n"]) + rng.choice([" ", "\t", "\n\n"]).join(w) + rng.choice(["", "  "]) for w in words]
        n, runs, kept = R.runs_of(pa.array(spaced, pa.string()), exponent=exponent, least=least)
        for w, size, row, rest in zip(words, n.to_pylist(), runs.to_pylist(), kept.to_pylist(), strict=True):
            expected = brute(w, exponent, least)
            assert size == len(w)
            assert [(x["start"], x["length"], x["period"]) for x in row] == expected
            assert rest == collapsed(w, expected)


def test_words_of_thue_and_fibonacci():
    """No fourth powers in either; both are full of smaller repeats."""
    thue, fib = [0], ["a", "ab"]
    while len(thue) < 1 << 12:
        thue += [1 - x for x in thue]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + fib[-2])
    for letters in ("".join(map(str, thue)), fib[-1]):
        _, runs, kept = R.runs_of(pa.array([" ".join(letters)]))
        assert runs.to_pylist() == [[]]
        assert kept.to_pylist() == [" ".join(letters)]


def test_long_texts():
    rng = random.Random(1)
    loop = [str(rng.randrange(10**6)) for _ in range(5_000)]
    one = " ".join(["a"] * 200_000)
    _, runs, kept = R.runs_of(pa.array([one, " ".join(["x", "y", *loop * 5, loop[0]]), "b " * 9]))
    assert runs.to_pylist() == [
        [{"start": 0, "length": 200_000, "period": 1}],
        [{"start": 2, "length": 25_001, "period": 5_000}],
        [{"start": 0, "length": 9, "period": 1}],
    ]
    assert kept.to_pylist() == ["a", " ".join(["x", "y", *loop]), "b"]


def test_suffix_order():
    rng = random.Random(7)
    for _ in range(60):
        code = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        order, ranks = R.suffix_order(pa.array(code).to_numpy())
        assert order.tolist() == sorted(range(len(code)), key=lambda i: code[i:])
        shared = R.common_prefixes(order[:-1], order[1:], ranks).tolist()
        for i, j, n in zip(order[:-1].tolist(), order[1:].tolist(), shared, strict=True):
            assert code[i : i + n] == code[j : j + n] and code[i + n : i + n + 1] != code[j + n : j + n + 1] or max(i, j) + n == len(code)


def test_defined_cases(spark):
    rows = [(1, "a " * 8), (1, "a " * 8), (None, None), (2, ""), (3, " \n"), (None, "a b " * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = docs.selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS n_words")
    for source in (docs, clash):
        out = R.periodic_runs(source)
        assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
        got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
        assert got == [(0, 0, [], ""), (0, 10, [(0, 10, 2)], "a b"), (1, 8, [(0, 8, 1)], "a"), (1, 8, [(0, 8, 1)], "a"), (2, 0, [], ""), (3, 0, [], "")]
    assert R.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(docs, exponent=1)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(text(rng)) if i % 3 else " ".join(str(k) for k in range(rng.randrange(400)))) for i in range(300)]
    rows += [(None, "a a a a a a a"), (301, None), (301, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    looped, expected = 0, []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, source in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", source or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            looped += 1
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        s, length, q = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        expected.append(
            (doc_id, len(found), s, length, q, 1000 * length // q if q else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(w, found)))
        )
    assert looped > 10
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
