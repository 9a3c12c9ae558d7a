"""Query of the toxicity chain."""

from __future__ import annotations

from cohort_spark.llm import toxicity
from cohort_spark.llm.registry import query, table


@query()
def op9_toxicity_chain(spark, sf_dir):
    """Probabilities of all categories and the verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    categories = toxicity.default_categories()
    chain, _, _ = toxicity.train(docs, table(spark, sf_dir, "labels"), categories)
    judged = toxicity.predict(docs, chain)
    return judged.select("doc_id", *toxicity.names(list(categories)), toxicity.flagged().alias("toxic"))
