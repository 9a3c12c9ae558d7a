"""Collects the queries of the operators; importing it registers them."""

from __future__ import annotations

from cohort_spark.llm import contamination_query, divergence_query, importance_query, main_text_query, mixing_query, repeats_query, rules_query, runs_query, secrets_query, similar_query, surrogates_query, token_query, toxicity_query  # noqa: F401
from cohort_spark.llm.registry import QUERIES, SQL  # noqa: F401
