from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import divergence as D
from cohort_spark.llm.registry import QUERIES

COLUMNS = "doc_id bigint, text string, lang string, source string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, least=10, top=10):
    """All rows of the audit by plain counting."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        mine = {s: {t: c[t] for t in kept} for (la, s), c in groups.items() if la == lang}
        all_of = {t: sum(c[t] for c in mine.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        share, whole = {s: p(c) for s, c in mine.items()}, p(all_of)
        for s in mine:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            terms = [(-f(share[s][t], whole[t]), t.encode()) for t in kept if mine[s][t] and share[s][t] > whole[t]]
            out += [(lang, s, "pair", item.decode(), -v, k) for k, (v, item) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", item.decode(), -v, k) for k, (v, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def corpus(rng, n=160):
    words = ["the", "The", "ÄB", "Äb", "naïve", "a1b", "x", "İ", "日本", "é", "�", "z-z"] + [f"w{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", "Z", None])
        text = rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(30)))
        rows.append((i, text, lang, source))
    return [*rows, *rows[:9], (None, "rare", "xx", "only"), (None, None, "yy", "one"), (None, "", "yy", "two")]


def test_audit_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    monkeypatch.setattr(D, "SHARD_ROWS", 20)
    assert sorted(map(tuple, D.audit(docs).collect())) == brute(rows)
    assert sorted(map(tuple, D.audit(docs, least_docs=1, top=3).collect())) == brute(rows, 1, 3)


def test_clashing_columns_and_empty_table(spark):
    rows = corpus(random.Random(4), 40)
    docs = spark.createDataFrame(rows, COLUMNS)
    clash = docs.selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS first", "5 AS rank", "6 AS value", "7 AS shard")
    out = D.audit(clash, least_docs=2)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == brute(rows, 2)
    assert D.audit(docs.limit(0)).count() == 0


def test_held_counts_are_merged_or_sent(monkeypatch):
    rows = corpus(random.Random(5), 60)
    batch = pa.RecordBatch.from_pylist([{"text": t or "", "lang": a or "", "source": s or ""} for _, t, a, s in rows])
    whole = {k[:3]: k[3:] for k in zip(*D.count_terms(batch).to_pydict().values(), strict=True)}
    monkeypatch.setattr(D, "PIECE_BYTES", 60)
    for held in (0, 30, 10**6):
        monkeypatch.setattr(D, "HELD_ROWS", held)
        got = defaultdict(lambda: (0, 0))
        for part in D._counts(iter([batch])):
            for *key, n, docs in zip(*part.to_pydict().values(), strict=True):
                got[tuple(key)] = (got[tuple(key)][0] + n, got[tuple(key)][1] + docs)
        assert dict(got) == whole


def test_shares_are_exact_for_large_counts():
    rng = random.Random(6)
    for _ in range(300):
        total, kept = rng.randrange(10 ** rng.randrange(1, 16)), rng.randrange(1, 10**6)
        count = [rng.randrange(total + 1) for _ in range(5)] + [0, total]
        assert D.share(pa.array(count).to_numpy(), total, kept).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in count]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = QUERIES["op13_source_divergence"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == brute(rows)
