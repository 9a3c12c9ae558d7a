"""How far the sources of a language differ in their words.

1. Each task runs its texts through Arrow's kernels (``ascii_lower``, ``split_pattern_regex``,
   ``dictionary_encode``, hash ``group_by``) and sends partial counts: occurrences and documents per
   (language, source, term). A task merges its pieces before it sends them.
2. The partial counts are added up by (language, term), which also finds the terms that enough
   documents of the language have. The kept counts are stored once.
3. The terms of each language are dealt to shards by hash. A shard turns its counts into columns, one
   per source, and computes its part of every pair's divergence and its own best terms.
4. The shards' sums are added and ranked.

A shard holds about ``SHARD_ROWS`` counts, however common the language, and works on blocks of terms,
so its memory does not follow the vocabulary. No text is shuffled. Nothing is broadcast by hand.

With c occurrences of a term among N of V kept terms, p = 1 + floor(10^9 (c + 2) / (N + 2 V)) and two
values differ by f = floor((p - q)^2 / (p + q)). All of it is done in whole numbers, which are exact up
to N + 2 V = 9 * 10^15.

Defined cases: a null text, language or source counts as empty; every row is a document of its own,
repeated or not; a (language, source) without terms has the count 0 everywhere; a language without
kept terms has pairs of value 0; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.core import durable
from cohort_spark.llm import bytes as B

# Bytes between terms: all but ASCII letters and the bytes of other characters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
PIECE_BYTES = 4 << 20
# Partial counts that a task holds before it merges them, or sends them if merging does not help.
HELD_ROWS = 400_000
SHARD_ROWS = 100_000
BLOCK_CELLS = 1 << 18
SCALE_DIGITS = 3  # three times a factor of 1000

PARTS = "lang string, source string, term string, n bigint, docs bigint"
FOUND = "lang string, source string, part string, item string, value bigint"


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents per language, source and term of one batch of ``lang, source, text``.

    Each (language, source) has one more row with an empty term, so that none is lost.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN)
    terms, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(terms, "")
    coded = terms.filter(full).dictionary_encode()
    pairs = pa.table({"doc": doc.filter(full), "term": coded.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    place = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
    per = place.take(pairs["doc"]).append_column("term", pairs["term"]).append_column("n", pairs["count_all"])
    sums = per.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count")])
    found = pa.table(
        {
            "lang": sums["lang"],
            "source": sums["source"],
            "term": coded.dictionary.take(sums["term"].combine_chunks()),
            "n": sums["n_sum"],
            "docs": sums["n_count"],
        }
    )
    seen = place.group_by(["lang", "source"]).aggregate([])
    zeros = pa.array(np.zeros(len(seen), np.int64))
    none = pa.table({"lang": seen["lang"], "source": seen["source"], "term": pa.array([""] * len(seen)), "n": zeros, "docs": zeros})
    return pa.concat_tables([found, none])


def _merge(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for piece in B.pieces(batch, "text", PIECE_BYTES):
            held.append(count_terms(piece))
            rows += len(held[-1])
            if rows > HELD_ROWS:
                held = [_merge(held)]
                rows = len(held[0])
                if 2 * rows > HELD_ROWS:
                    yield from held.pop().to_batches()
                    rows = 0
    if held:
        yield from _merge(held).to_batches()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10) -> DataFrame:
    """``lang, source, term, n, first`` of all terms that enough documents of the language have.

    ``first`` is 1 for one row of each (language, term). Each (language, source) also has a row with
    an empty term.
    """
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    parts = docs.select(*columns).mapInArrow(_counts, PARTS)
    # One exchange by (lang, term) serves the sums per source and those over all sources.
    added = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    all_docs = F.sum("docs").over(term)
    first = (F.row_number().over(term.orderBy("source")) == 1) & (F.col("term") != "")
    return (
        added.select("lang", "source", "term", "n", all_docs.alias("all_docs"), first.cast("int").alias("first"))
        .where((F.col("all_docs") >= least_docs) | (F.col("term") == ""))
        .select("lang", "source", "term", "n", "first")
    )


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) of every count, by long division."""
    whole = np.int64(total + 2 * kept)
    rest = count.astype(np.int64) + 2
    out = rest // whole
    rest = rest - out * whole
    for _ in range(SCALE_DIGITS):
        rest = rest * 1000
        digit = rest // whole
        out = out * 1000 + digit
        rest -= digit * whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


def _best(terms: list[str], value: np.ndarray, top: int) -> list[tuple[str, int]]:
    if len(value) > top:
        near = np.flatnonzero(value >= np.partition(value, -top)[-top])
        terms, value = [terms[i] for i in near.tolist()], value[near]
    return sorted(zip(terms, value.tolist(), strict=True), key=lambda x: (-x[1], x[0].encode()))[:top]


def compare(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """One shard's part of all pairs' divergences, and its ``top`` terms of every source.

    ``counts`` has ``source, term, n``; ``groups`` has ``lang, source, total, lang_total, kept`` of every
    source of the language.
    """
    groups = groups.sort_by("source")
    sources = groups["source"].to_pylist()
    totals, size = groups["total"].to_pylist(), len(sources)
    lang, lang_total, kept = (groups[c][0].as_py() for c in ("lang", "lang_total", "kept"))
    coded = counts["term"].combine_chunks().dictionary_encode()
    names = coded.dictionary
    column = pc.index_in(counts["source"], value_set=groups["source"]).to_numpy()
    row, n = coded.indices.to_numpy(), counts["n"].to_numpy()
    order = np.argsort(row, kind="stable")
    row, column, n = row[order], column[order], n[order]
    sums = np.zeros((size, size), np.int64)
    best: list[list[tuple[str, int]]] = [[] for _ in sources]
    step = max(1, BLOCK_CELLS // size)
    for low in range(0, len(names), step):
        high = min(low + step, len(names))
        a, b = np.searchsorted(row, [low, high])
        block = np.zeros((size, high - low), np.int64)
        block[column[a:b], row[a:b] - low] = n[a:b]
        whole = share(block.sum(axis=0), lang_total, kept)
        p = np.stack([share(block[i], totals[i], kept) for i in range(size)])
        for i in range(size):
            sums[i, i + 1 :] += gap(p[i + 1 :], p[i]).sum(axis=1)
            over = np.flatnonzero((block[i] > 0) & (p[i] > whole))
            here = names.take(pa.array(over + low)).to_pylist()
            found = best[i] + _best(here, gap(p[i][over], whole[over]), top)
            best[i] = _best([t for t, _ in found], np.array([v for _, v in found], np.int64), top)
    sums += sums.T
    out = [(sources[i], "pair", sources[j], int(sums[i, j])) for i in range(size) for j in range(size) if i != j]
    out += [(sources[i], "term", t, v) for i in range(size) for t, v in best[i]]
    source, part, item, value = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table(
        {
            "lang": pa.array([lang] * len(out), pa.string()),
            "source": pa.array(source, pa.string()),
            "part": pa.array(part, pa.string()),
            "item": pa.array(item, pa.string()),
            "value": pa.array(value, pa.int64()),
        }
    )


def audit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = 10,
    top: int = 10,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language.

    Part ``pair`` has one row per other source with the divergence summed over all kept terms. Part
    ``term`` has the ``top`` terms that the source uses more than its language does.
    """
    counts = durable(term_counts(docs, text=text, lang=lang, source=source, least_docs=least_docs))
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    per_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("kept"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    groups = per_source.join(per_lang, "lang").select("lang", "source", "total", "lang_total", "kept", numbers)
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard")
    # New column identities: both sides of the cogroup come from one table.
    groups = groups.toDF(*groups.columns)
    dealt = counts.where(F.col("term") != "").select("lang", shard, "source", "term", "n").toDF("lang", "shard", "source", "term", "n")
    found = (
        dealt.groupBy("lang", "shard")
        .cogroup(groups.groupBy("lang", "shard"))
        .applyInArrow(lambda left, right: compare(left, right, top), FOUND)
    )
    added = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    out = added.withColumn("rank", F.row_number().over(ranked))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top))
