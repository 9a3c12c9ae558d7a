"""Query of the token files."""

from __future__ import annotations

import os

from cohort_spark.llm import token_files
from cohort_spark.llm.registry import query, table


def tokenizer_path() -> str:
    """The byte-level vocabulary; CORPUS_TOKENIZER names another file."""
    named = os.environ.get("CORPUS_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op2_token_files(spark, sf_dir):
    """Place, length and checksum of every document's tokens, from the files they were written to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path()
    root, parts = token_files.write_tokens(docs, path)
    return token_files.read_tokens(root, parts, path)
