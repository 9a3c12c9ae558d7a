"""Query of the main text of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.llm import main_text
from cohort_spark.llm.registry import query, table


@query()
def op11_main_text(spark, sf_dir):
    """The article of every page and its length."""
    found = main_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
