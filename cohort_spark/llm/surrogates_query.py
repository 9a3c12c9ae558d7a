"""Query of the surrogates for personal data."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cohort_spark.llm import surrogates
from cohort_spark.llm.registry import query, table


@query()
def op4_pii_surrogates(spark, sf_dir):
    """Entities per kind, and the text with surrogates, of every document; CORPUS_PII_KEY sets the key."""
    key = os.environ.get("CORPUS_PII_KEY", "test key").encode()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = surrogates.replace(docs, key)
    of = lambda kind: F.size(F.filter("_pii_kinds", lambda k: k == kind)).cast("bigint")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in surrogates.KINDS], "text")
