"""Every operator and stage on nulls, empty texts, repeated rows, an empty table and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from cohort_spark.llm import contamination, divergence, importance, main_text, mixing, repeats, rules, runs, secrets, similar, surrogates, token_files, toxicity
from cohort_spark.llm.registry import table
from cohort_spark.llm.token_query import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = (
    "row label fold score _imp_score _imp_key _imp_id slot part _sim_own _sim_id _sim_tie root tie own_id kept_id n_shingles component_id _bench_runs _bench_items "
    "_bench_n_words _mix_rate _mix_copies _mix_source one size rate _pii_kinds _pii_redrawn redrawn kinds at of kind normal _sec_spans v _tox_id _tox_text _tox_0 "
    "_rule_kept _rule_n_words chunk bucket keys counts levels runs collapsed n_words term n docs first shard value rank html start n_bytes kept c0"
).split()


def documents(spark):
    long = " ".join(f"long{i % 977}" for i in range(30_000))
    rows = [
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, "one two three four five six", None, None), (3, None, "en", "a"),
        (4, "", "", ""), (4, "", "", ""), (5, " \n\t ", "de", "b"), (None, "one two three four five six", "en", "a"), (None, None, None, None), (6, long, "en", "b"),
        (7, "token = abcdef123456 mail a.b@c.org", "fr", None), (8, "éé \U0001f600 x", "es", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


def toxic(spark, docs):
    chain, *_ = toxicity.train(docs, table(spark, SF, "labels"), toxicity.default_categories())
    return toxicity.predict(docs, chain)


OPERATORS = {
    "importance": lambda s, d: importance.resample(d, table(s, SF, "labels")),
    "token files": lambda s, d: (lambda p: token_files.read_tokens(*token_files.write_tokens(d, p), p))(tokenizer_path()),
    "similar": lambda s, d: similar.join_similar(d),
    "surrogates": lambda s, d: surrogates.replace(d, b"k"),
    "rules": lambda s, d: rules.judge(d),
    "contamination": lambda s, d: contamination.scan(d, table(s, SF, "benchmark")),
    "cut spans": lambda s, d: contamination.cut_spans(d, table(s, SF, "benchmark")),
    "mixing": lambda s, d: mixing.mix(d),
    "secrets": lambda s, d: secrets.scan(d, secrets.train(d)),
    "toxicity": toxic,
    "repeats": lambda s, d: repeats.remove_repeats(d),
    "main text": lambda s, d: main_text.extract(d, html="text", keep=("doc_id",)),
    "runs": lambda s, d: runs.periodic_runs(d),
    "divergence": lambda s, d: divergence.audit(d),
    **{f"stage {name}": lambda s, d, f=f: f(s, d, SF) for name, f in corpus_pipeline.STAGES},
}
# Rows that come back for each row that goes in: all, or as many as the operator's rule says.
WHOLE = {"token files", "similar", "surrogates", "rules", "contamination", "cut spans", "secrets", "toxicity", "repeats", "main text", "runs", "stage token files"}


def kept_of(frame, names):
    return sorted(repr(tuple(r[c] for c in names)) for r in frame.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    run, docs = OPERATORS[name], documents(spark)
    clash = docs.selectExpr("*", *[f"'clash' AS `{n}`" for n in NAMES])
    plain = run(spark, docs)
    rows = plain.count()
    assert rows == docs.count() if name in WHOLE else rows >= 0
    out = run(spark, clash)
    same = [c for c in plain.columns if c in out.columns and c not in NAMES]
    assert same
    assert kept_of(out, same) == kept_of(plain, same)
    if set(clash.columns) <= set(out.columns) and name.startswith("stage"):
        assert {tuple(r[n] for n in NAMES) for r in out.collect()} <= {("clash",) * len(NAMES)}
    assert run(spark, docs.limit(0)).count() == 0
