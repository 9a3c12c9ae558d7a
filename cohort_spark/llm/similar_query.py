"""Query of the Jaccard join."""

from __future__ import annotations

from cohort_spark.llm import similar
from cohort_spark.llm.registry import query, table


@query()
def op3_jaccard_join(spark, sf_dir):
    """Set size, component and number of links of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar.join_similar(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")
