from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import token_files
from cohort_spark.llm.encoding import Encoder
from cohort_spark.llm.registry import QUERIES
from cohort_spark.llm.token_query import tokenizer_path

ODD = [
    "", " ", "  ", "\n", "a", "don't we'll they've I'm you'd it's we're 's 't", "x'tly y'really z'llama", "''s !'s  's\n's",
    "a  b   c\n\nd \t e\r\n f ", "été naïve ñandú straße", "3.14 12,000 1e10 ²³ ½", "中文字符 mixed text", "emoji 😀 here",
    "<|endoftext|> in a text", "tabs\t\tand nbsp wide", "CAN'T 'S 'll'", "ends with '", "'", "it'", "a 'r", "b've'd", "x́y", "　z", "՘ՙ",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def expected(encoder, text):
    return encoder.library.encode(text, add_special_tokens=False).ids


def test_parts_agree_with_whole_texts(encoder):
    rng = random.Random(1)
    alphabet = ["a", "Z", "é", "9", "'", " ", "  ", "\n", "\t", "!", "-", "re", "ll", "s", "t", "ß", " ", "²", "٣"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for ids, text in zip(encoder.encode(texts), texts, strict=True):
        assert ids.tolist() == expected(encoder, text), repr(text)
    assert [x.tolist() for x in encoder.encode([t for t in texts if t.isascii()])] == [
        expected(encoder, t) for t in texts if t.isascii()
    ]


def round_trip(spark, encoder, rows, tmp_path, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    root, parts = token_files.write_tokens(docs, tokenizer_path(), str(tmp_path / "files"), **options)
    got = token_files.read_tokens(root, parts, tokenizer_path()).orderBy("start").collect()
    assert len(got) == len(rows)
    start = 0
    ordered = sorted(rows, key=lambda r: (-1, "") if r[0] is None else (r[0], ""))
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    want = sorted(((r[0], tuple([*expected(encoder, r[1] or ""), 2])) for r in rows), key=str)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    sums = sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str)
    assert sums == sorted(((d, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for d, t in want), key=str)
    return root


def test_round_trip_over_many_files(spark, encoder, tmp_path):
    rows = [(i * 3 % 101, f"{t} number {i}", "x") for i, t in enumerate(ODD * 4)]
    rows += [(None, "no id", None), (5, None, None), (6, "", None), (7, "same", None), (7, "same", None), (7, "other", None)]
    rows += [(10_000, "long text " * 40_000, None)]
    root = round_trip(spark, encoder, rows, tmp_path, file_bytes=60_000)
    import os

    names = sorted(os.listdir(root))
    assert sum(n.startswith("tokens-") for n in names) > 2 and all(n.endswith(".bin") for n in names)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    root, parts = token_files.write_tokens(docs, tokenizer_path(), str(tmp_path / "none"))
    assert token_files.read_tokens(root, parts, tokenizer_path()).count() == 0


def test_query_against_library(spark, encoder):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    rows = QUERIES["op2_token_files"](spark, sf).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array([*expected(encoder, texts[r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
