from __future__ import annotations

import hashlib
import random

import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import repeats
from cohort_spark.llm.registry import QUERIES
from cohort_spark.llm.shared_keys import Layout


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row, by a table of all 50-byte strings."""
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    texts = [(order(d), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, t), (doc_id, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((doc_id, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def planted(rng, n):
    word = lambda: "".join(rng.choice("abcdeéfg") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(20, 400)], " ".join(word() for _ in range(rng.randrange(30)))]
        rows.append((i, " ".join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(0, n, 3)]
    rows += [(None, rows[1][1]), (None, rows[1][1]), (3, rows[3][1]), (4, rows[5][1]), (900, None), (901, ""), (902, "x" * 49)]
    rows += [(903, "ab" * 300), (904, "ab" * 200 + "c"), (2000, "x" * 5000), (2001, "x" * 70)]
    return rows


@pytest.mark.parametrize(("seed", "hot", "layout"), [(1, 10**6, Layout(1, 1)), (2, 10**6, Layout(9, 5)), (3, 3, Layout(5, 4))])
def test_against_brute_force(spark, seed, hot, layout, monkeypatch):
    rows = planted(random.Random(seed), 60)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, chunk string")
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs, hot=hot, plan=layout).collect()), key=str)
    got = [(a, b, c, d, bytes(e)) for a, b, c, d, e in got]
    assert got == brute(rows)


def test_segments_do_not_change_results(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    data = np.array([rng.choice(b"abc ") for _ in range(3000)], np.uint8)
    at = np.array([0, 0, 700, 720, 769, 1500, 3000])
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    cut = repeats.runs(data, at)
    covered = [w for a, b in zip(cut.start, cut.end, strict=True) for w in range(a, b)]
    assert covered == [w for a, b in zip(at[:-1], at[1:], strict=True) for w in range(a, b - 49)]
    names = repeats._names(data)
    assert all((names[a:b] == n).all() for a, b, n in zip(cut.start, cut.end, cut.name, strict=True))


def test_two_long_documents_share_a_line_template(spark):
    """One name has more different strings than an index can hold, in two documents only."""
    rng = random.Random(11)
    template = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(63))
    log = lambda: "".join(f"{rng.getrandbits(112):028x}{template}{rng.getrandbits(112):028x}\n" for _ in range(20_000))
    texts = [log(), log()]
    first = {texts[0][i : i + 50] for i in range(len(texts[0]) - 49)}
    gone = bytearray(len(texts[1]))
    for i in range(len(gone) - 49):
        if texts[1][i : i + 50] in first:
            gone[i : i + 50] = b"\1" * 50
    kept = "".join(c for c, g in zip(texts[1], gone, strict=True) if not g).encode()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, digest=True).collect()}
    assert (got[0]["n_removed"], got[1]["n_removed"]) == (0, sum(gone)) and sum(gone) >= 20_000 * 63
    assert bytes(got[1]["kept"]) == hashlib.sha256(kept).digest()


def test_index_finds_runs_and_intervals_without_search(monkeypatch):
    """A step of the stream looks up one length; rows find their run and interval by a directory."""
    import numpy as np

    from cohort_spark.llm import run_index

    rng = random.Random(3)
    base = bytes(rng.choice(b"ab ") for _ in range(300))
    parts = [base[a : a + rng.randrange(50, 111)] for a in (rng.randrange(180) for _ in range(80))]
    owners = np.array([rng.randrange(20) for _ in parts], np.int64)
    first = {}
    for part, owner in zip(parts, owners.tolist(), strict=True):
        for i in range(len(part) - 49):
            first[part[i : i + 50]] = min(first.get(part[i : i + 50], owner), owner)
    sought, plain = [], np.searchsorted
    monkeypatch.setattr(run_index.np, "searchsorted", lambda a, v, **k: sought.append(np.size(v)) or plain(a, v, **k))
    index = run_index.RunIndex(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), owners, 50)
    assert index.stream().tolist() == [first[p[i : i + 50]] for p in parts for i in range(len(p) - 49)]
    assert sum(sought) <= max(map(len, parts))


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows)]
    got = sorted((tuple(r) for r in QUERIES["op10_remove_repeats"](spark, sf).collect()), key=str)
    assert got == sorted(want, key=str)
