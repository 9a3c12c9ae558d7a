"""Mix sources to target weights by repeating and thinning documents.

Sizes are summed per source, the wanted words are filled up to a repetition limit, and every document
is emitted ``floor(rate)`` times plus once more with the rest of the rate as probability.

Defined cases: a null or empty text has size 0 and is never repeated more than its source's rate says;
a null source is a source of its own, last in order; a source of size 0 has target 0 and rate 0; rows
with the same ``doc_id`` are separate documents that share a draw; an empty table mixes to an empty
one. Further columns pass through ``mix`` under any name; ``with_copies`` adds columns that start with ``_mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import durable
from cohort_spark.skew import running_totals

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
# Sources up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``.

    Sources in code point order (null last) take the weights in turn. The words of all sources are
    shared by weight; no target exceeds ``most`` times its source, and what is cut off is shared
    again. With sources in order of limit / weight, all before some place stand at their limit and
    the rest share ``(all - limits before) / (weights from here on)``: the first source that this
    share does not lift above its limit gives the share.
    """
    sources = durable(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    ranked = running_totals(
        sources, [], [F.col("source").asc_nulls_last()], {"_mix_rank": F.lit(1).cast("bigint")}
    )
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighed = durable(
        ranked.withColumn("_mix_w", turn[(F.col("_mix_rank") % len(weights)).cast("int")].cast("bigint"))
        .withColumn("_mix_cap", F.col("source_size") * most)
    )
    whole = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
        F.coalesce(F.sum("_mix_w"), F.lit(0)).alias("w"),
    ).first()
    filled = running_totals(
        weighed,
        [],
        [(F.col("_mix_cap") / F.col("_mix_w")).asc(), F.col("_mix_rank").asc()],
        {"_mix_caps": F.col("_mix_cap"), "_mix_ws": F.col("_mix_w")},
    )
    share = (F.lit(whole.size) - F.col("_mix_caps")) / (F.lit(whole.w) - F.col("_mix_ws"))
    free = filled.where(F.col("_mix_cap") >= F.col("_mix_w") * share)
    level = free.agg(
        F.min_by(share, F.struct(F.col("_mix_cap") / F.col("_mix_w"), F.col("_mix_rank")))
    ).first()[0]
    target = F.least(
        F.col("_mix_cap").cast("double"),
        F.col("_mix_w") * F.lit(float(level if level is not None else 0.0)),
    )
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return durable(weighed.select("source", "source_size", target.alias("target"), rate.alias("rate")))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the identifier."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(
    docs: DataFrame, sources: DataFrame, *, seed: str = SEED, broadcast: int = BROADCAST_SOURCES
) -> DataFrame:
    """Documents with ``_mix_size``, their source's figures and ``_mix_copies``."""
    table = sources.select(
        F.col("source").alias("_mix_source"),
        F.col("source_size").alias("_mix_source_size"),
        F.col("target").alias("_mix_target"),
        F.col("rate").alias("_mix_rate"),
    )
    if sources.limit(broadcast + 1).count() <= broadcast:
        table = F.broadcast(table)
    joined = docs.join(table, docs["source"].eqNullSafe(table["_mix_source"]))
    extra = draw(F.col("doc_id"), seed) < F.col("_mix_rate") - F.floor("_mix_rate")
    copies = F.floor("_mix_rate").cast("bigint") + extra.cast("bigint")
    return joined.withColumn("_mix_copies", copies).drop("_mix_source")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as its rate and draw say."""
    sizes = docs.select("source", size_of(F.col("text")).alias("size"))
    table = targets(sizes, weights=weights, most=most)
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    chosen = with_copies(rows, table, seed=seed).where("_mix_copies > 0")
    one = F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies").cast("int"))).alias("one")
    return chosen.select("row", one).select("row.*")
