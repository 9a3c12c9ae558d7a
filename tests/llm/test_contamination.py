from __future__ import annotations

import hashlib
import random
import re

import pytest

from cohort_spark.llm import contamination
import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm.registry import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for key, item in items:
        w = WORD.findall(lower(item))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if key is None else str(key))
    joined = ",".join(sorted(found))
    return (
        len(words), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(),
        len(hit) > 0 and 20 * len(hit) >= len(words),
    )


@pytest.mark.parametrize("block", [10_000, 60])
def test_against_brute_force(spark, block):
    rng = random.Random(5)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 20, 40]))) for i in range(25)]
    items += [(None, text(15)), (90, None), (91, ""), (92, "..."), (3, text(14))]
    docs = [(i, text(rng.choice([0, 5, 30, 300]))) for i in range(40)]
    docs += [(100 + i, text(50) + " - " + lower(items[i][1]).upper() + ", " + text(20)) for i in range(25)]
    docs += [(None, text(30)), (7, None), (8, ""), (9, "W0 w0é"), (9, "W0 w0é")]
    # Long-item-only tables exercise the pair filter, all lengths the short items.
    for chosen in (items, [x for x in items if x[1] and len(x[1].split()) > 12]):
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        bench = spark.createDataFrame(chosen, "item_id bigint, text string")
        found = contamination.scan(frame, bench, block_tokens=block)
        rows = found.select(
            "doc_id", "text", "_bench_n_words", contamination.n_hit().alias("n"), "_bench_items",
            contamination.contaminated().alias("c"),
        ).collect()
        assert len(rows) == len(docs)
        for r in rows:
            sha = hashlib.sha256(",".join(sorted(r["_bench_items"])).encode()).hexdigest()
            got = (r["_bench_n_words"], r["n"], len(r["_bench_items"]), sha, r["c"])
            assert got == brute(r["text"], chosen)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id bigint, text string, item_id string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.decontaminate(docs, none).collect() == docs.collect()
    assert contamination.scan(docs.limit(0), none).count() == 0


def test_cut_spans(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before it: {item.upper()}. After."), (2, None), (3, "none")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in contamination.cut_spans(docs, bench).collect()}
    assert got == {1: "Before it: . After.", 2: None, 3: "none"}
    kept = {r.doc_id for r in contamination.decontaminate(docs, bench).collect()}
    assert kept == {2, 3}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_decontaminate"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items)
