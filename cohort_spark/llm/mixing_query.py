"""Query of the source mix and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.core import durable
from cohort_spark.llm import mixing
from cohort_spark.llm.registry import query, table

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
so AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ra AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS r FROM so),
we AS (SELECT *, 1 + r % 3 AS w, 3 * source_size AS cap FROM ra),
fi AS (
  SELECT *, (SELECT sum(source_size) FROM we) - coalesce(sum(cap) OVER o, 0) AS left_size,
    (SELECT sum(w) FROM we) - coalesce(sum(w) OVER o, 0) AS left_w
  FROM we WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
le AS (
  SELECT CAST(left_size AS DOUBLE) / CAST(left_w AS DOUBLE) AS level FROM fi
  WHERE cap >= w * (CAST(left_size AS DOUBLE) / CAST(left_w AS DOUBLE)) ORDER BY cap / w, r LIMIT 1),
ta AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), w * coalesce((SELECT level FROM le), 0.0)) AS target FROM we),
rt AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM ta)
SELECT d.doc_id, d.size, t.source_size, t.target,
  d.size * (CAST(floor(t.rate) AS BIGINT) + CASE WHEN
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0
    < t.rate - floor(t.rate) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN rt t ON d.source IS NOT DISTINCT FROM t.source
""".replace(' COLLATE "binary"', "")


@query(SQL)
def op7_mix_sources(spark, sf_dir):
    """Words that the mix takes of every document; weights 1, 2, 3 in turn, targets to 3 times a source."""
    docs = table(spark, sf_dir, "documents")
    sized = durable(docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")))
    chosen = mixing.with_copies(sized, mixing.targets(sized))
    return chosen.select(
        "doc_id",
        "size",
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("size") * F.col("_mix_copies")).alias("taken"),
        F.col("_mix_copies").alias("copies"),
    ).drop("copies")
