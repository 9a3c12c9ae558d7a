"""Query of the rule cascade and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.llm import rules
from cohort_spark.llm.registry import query, table

SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
u AS (SELECT r, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: struct_pack(i := i, k := [ws[i], ws[i + 1], ws[i + 2]]))) AS x FROM w),
g AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.k) AS n FROM u),
p AS (SELECT r, i, lag(i, 1, -10) OVER (PARTITION BY r ORDER BY i) AS last FROM g WHERE n > 1),
q AS (SELECT r, sum(least(3, i - last)) AS n FROM p GROUP BY r),
c AS (
  SELECT w.r, doc_id, text, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '^\pL$'))) AS ones
  FROM w LEFT JOIN q ON w.r = q.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * (len(text) - len(replace(text, '!', ''))) > 3 * n_words
    OR 2 * len(regexp_extract_all(text, '\p{Lu}{2,}')) > n_words
    OR 2 * len(regexp_extract_all(text, '\pL')) < word_chars OR 2 * ones > n_words) AS kept
FROM b
"""


@query(SQL)
def op5_quality_rules(spark, sf_dir):
    """Base counts of every document and the verdict of the rule cascade."""
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        *[F.col(f"_rule_{c}").alias(c) for c in rules.BASE],
        F.col("_rule_base_failed").alias("base_failed"),
        F.col("_rule_kept").alias("kept"),
    )
