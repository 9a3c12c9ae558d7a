"""Query of the removal of repeated passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.llm import repeats
from cohort_spark.llm.registry import query, table


@query()
def op10_remove_repeats(spark, sf_dir):
    """What every document loses to earlier ones, and the hash of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeats.remove_repeats(docs, digest=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
