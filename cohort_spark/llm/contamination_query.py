"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.llm import contamination
from cohort_spark.llm.registry import query, table


@query()
def op6_decontaminate(spark, sf_dir):
    """Hit words and items of every document against all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_bench_n_words").alias("n_words"),
        contamination.n_hit().alias("n_hit"),
        F.size("_bench_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_bench_items"), ","), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )
