"""Query of the source divergence audit and its SQL twin."""

from __future__ import annotations

from cohort_spark.llm import divergence
from cohort_spark.llm.registry import query, table

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
k AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
full_c AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS t FROM full_c GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (t + 2 * k.v) AS p
  FROM full_c JOIN t USING (lang, source) JOIN k USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL),
m AS (SELECT lang, sum(n) AS t FROM l GROUP BY lang),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (t + 2 * k.v) AS q FROM l JOIN m USING (lang) JOIN k USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query(SQL)
def op13_source_divergence(spark, sf_dir):
    """Divergence of every pair of sources and each source's most typical terms, by language."""
    return divergence.audit(table(spark, sf_dir, "documents"))
