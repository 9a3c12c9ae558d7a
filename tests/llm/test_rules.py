from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from cohort_spark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["a", "b", "été", "x###", "|", "w\x0b", "$5", "😀"]
    texts = [" ".join(rng.choice(pool[: rng.randrange(2, 9)]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["one", "two", " ", "", "one "]) for _ in range(30)) for _ in range(10)]
    texts += [None, "", " \n\t", "one", "one two", "a b c", "a b c a b c", "x " * 5000, "y z\n" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    rows = rules.judge(docs, sample_rows=20).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (*[r[f"_rule_{c}"] for c in rules.BASE], r["_rule_base_failed"])
        assert got == brute(r.text), repr(r.text)[:100]
        assert not (r["_rule_base_failed"] and r["_rule_kept"])
        assert r.n_words == "clash"


def test_order_changes_work_not_verdict(spark):
    good = " ".join(f"word{i} of" for i in range(60))
    bad = [good.upper(), good.replace(" ", "!! "), good.replace(" ", " | "), "\n".join([good, "x"] * 3), None]
    docs = spark.createDataFrame(list(enumerate([good, *bad])), "doc_id bigint, text string")
    counted = rules.base_counts(docs)
    table = rules.default_rules()
    for order in (list(table), list(table)[::-1]):
        kept = counted.where(rules.verdict(table, order)).select("doc_id").collect()
        assert [r.doc_id for r in kept] == [0]
    assert sorted(rules.cascade_order(counted, table)) == sorted(table)


def test_costly_rule_waits_for_cheap_rejections(spark):
    docs = spark.createDataFrame([("a " * 100,)], "text string")
    table = {"slow": F.raise_error(F.lit("asked")).cast("boolean"), "fast": F.lit(True)}
    assert not rules.base_counts(docs).select(rules.verdict(table, ["fast", "slow"]).alias("k")).first().k


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
