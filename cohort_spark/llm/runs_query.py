"""Query of the periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import settled
from cohort_spark.llm import runs
from cohort_spark.llm.registry import query, table


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where about a tenth of the texts end in a loop; a row without ``doc_id`` has none.

    With h = crc32 of the decimal doc_id and g = floor(h / 10), a text with h % 10 = 0 repeats its words
    from a = g % n on with the period 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    rows = settled(docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")), "w", F.col("w"))
    rows = rows.withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)")
    )
    looped = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query()
def op12_periodic_runs(spark, sf_dir):
    """Runs of every document, its longest one, and the hash of the text without the repeats."""
    found = runs.periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("from_end"), (-r["period"]).alias("less")))
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumns({"top": longest, "listed": listed})
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.from_end")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.less")).alias("period"),
        F.expr("1000 * top.length div -top.less").alias("exponent_milli"),
        _sha(F.col("listed")).alias("runs_sha256"),
        _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
