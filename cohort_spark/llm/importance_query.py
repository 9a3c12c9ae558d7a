"""Query of the importance resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.llm import importance
from cohort_spark.llm.registry import query, table


@query()
def op1_importance_resampling(spark, sf_dir):
    """Log importance of every document and whether the draw keeps it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    draw = importance.score_all(docs, table(spark, sf_dir, "labels"))
    slim = draw.slim()
    return slim.select("doc_id", F.col("_imp_score").alias("importance"), importance.among_top(slim, draw.k).alias("kept"))
