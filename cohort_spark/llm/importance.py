"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two bag-of-n-gram models over ``BUCKETS`` hashed features are counted: one on target text (labelled
rows of good quality, a bounded sample), one on the raw text (every document). A document's log
importance is the mean log ratio of its n-grams, drawn to 0 for few n-grams. Adding Gumbel noise and taking the k largest draws k
documents without replacement in proportion to their weights.

Features are n-grams of word forms (capitals, letters, digits, other characters, length, same as the
word before or a near one) and of the words themselves, so that layout, repetition and vocabulary
all count. N-grams that the target has not shown fall back to the raw model: ``BACK_OFF`` expected
occurrences are added to both sides, so a rare one says little and only a common one that the target
lacks says much.

The target rows are dealt to ``FOLDS`` folds by a hash of their text. A labelled target row is scored
by models without its fold, so its own words (and those of its copies) do not speak for it, and the
rows without a label are judged on the same scale. ``k`` follows the labels: as many documents as lie
above a low quantile of the labelled target rows' importance, lowered by a quarter of the way to the
same quantile from above of the labelled other rows, if those lie below. Random keys come from a hash
of seed and ``doc_id``; reruns agree.

Defined cases: a null or empty text has no n-grams, importance ``EMPTY`` and is never drawn; ties
are drawn by ``doc_id`` (null first); rows with the same ``doc_id`` share the noise; a row's importance
depends on its own text and label only, not on its batch; of several labels of one ``doc_id`` the best
counts; without labelled target rows every document with text is kept; an empty table gives an empty
one. Further columns pass through under any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.core import durable
from cohort_spark.llm import bytes as B

BUCKETS = 1 << 16
# Labelled target rows that fit the target model and the cut; drawn by a hash of doc_id.
TARGET_ROWS = 20_000
# Share of labelled target rows that may lie below the cut.
BELOW = 0.001
# N-grams of no evidence that every document is given, so that a few n-grams do not decide alone.
PRIOR = 32
# Importance (mean log ratio) that weighs as much as one unit of Gumbel noise.
TEMPERATURE = 0.004
EMPTY = -1e6
SEED = "imp-1"
# Occurrences that both models are given for every n-gram.
BACK_OFF = 1.0
FOLDS = 5
# Of the way from the target rows' quantile down to the other rows'.
MARGIN = 0.25
_PARTS = 64
# Task sums that are added up together; the sums of these groups are added last.
_SLOTS = 512
# Log ratios are whole billionths, so that sums do not depend on their order.
_UNIT = 1e9


def _forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A small number for the outer form of each word, repetition included."""
    length = ends - starts
    offset = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=offset[1:])
    letters = data[mask]
    upper = (letters >= 65) & (letters <= 90)
    lower = ((letters >= 97) & (letters <= 122)) | (letters >= 128)
    digit = (letters >= 48) & (letters <= 57)
    count = lambda flags: np.add.reduceat(flags.astype(np.int32), offset)
    capitals, small, digits = count(upper), count(lower), count(digit)
    other = length - capitals - small - digits
    level = lambda a: np.minimum(a, 2)
    last = letters[offset + length - 1].astype(np.int64)
    last = np.where((last >= 33) & (last < 128) & ~upper[offset + length - 1] & ~lower[offset + length - 1], last, 0)
    form = level(capitals) * 81 + level(small) * 27 + level(digits) * 9 + level(other) * 3 + (length > 12)
    form = form.astype(np.int64) * 128 + last
    word = B.hashes(B.LOWER[data], mask, starts, ends)
    same = np.zeros(len(word), np.int64)
    for back in range(1, 5):
        equal = word[back:] == word[:-back]
        for k in range(back):
            at = first[:-1] + k
            at = at[(at >= back) & (at < len(word))] - back
            equal[at] = False
        same[back:] = np.where((same[back:] == 0) & equal, 1 + (back > 1), same[back:])
    return form * 3 + same


def features(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, and the texts' bounds in that array."""
    starts, ends, first, mask = B.words(data, at, B.NOT_SPACE)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    form = B.mix(_forms(data, starts, ends, first, mask).astype(np.uint64) + np.uint64(1))
    word = B.hashes(B.LOWER[data], mask, starts, ends)
    number = np.arange(n)
    doc_end = first[1:][np.searchsorted(first, number, side="right") - 1]
    kinds = []
    for source, sizes, salt in ((form, (1, 2, 3), 11), (word, (1, 2), 23)):
        for size in sizes:
            gram = B.mix(B.grams(source, size) ^ np.uint64(salt * 97 + size))
            whole = number[: len(gram)] + size <= doc_end[: len(gram)]
            kinds.append((number[: len(gram)][whole], gram[whole]))
    order = np.argsort(np.concatenate([k[0] for k in kinds]), kind="stable")
    place = np.concatenate([k[0] for k in kinds])[order]
    bucket = (np.concatenate([k[1] for k in kinds])[order] % np.uint64(buckets)).astype(np.int64)
    return bucket, np.searchsorted(place, first)


def bucket_counts(docs: DataFrame, *, text: str = "text", fold: str | None = None, folds: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams per bucket over all texts, or a row of them per value of ``fold``.

    One fixed-size array per task is cut into slices, which are added up in two steps.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, buckets), np.int64)
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                found, bounds = features(*B.raw(piece.column("text")), buckets)
                if folds > 1:
                    found = found + np.repeat(piece.column("fold").to_numpy().astype(np.int64), np.diff(bounds)) * buckets
                total += np.bincount(found, minlength=folds * buckets).reshape(folds, buckets)
        if total.any():
            slices = np.array_split(total.ravel(), _PARTS)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(range(_PARTS), pa.int32()), "n": pa.array([s.tolist() for s in slices], pa.list_(pa.int64()))}
            )

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.asarray(x.values) for x in rows["n"])
        return pa.table({"part": rows["part"][:1], "n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    rows = docs.select(F.col(f"`{text}`").alias("text"), (F.col(f"`{fold}`") if fold else F.lit(0)).cast("int").alias("fold"))
    schema = "part int, n array<bigint>"
    counted = rows.mapInArrow(count, schema).withColumn("slot", F.spark_partition_id() % _SLOTS)
    some = counted.groupBy("part", "slot").applyInArrow(add, schema)
    sums = some.groupBy("part").applyInArrow(add, schema).collect()
    total = np.zeros(folds * buckets, np.int64)
    if sums:
        total = np.concatenate([np.array(r["n"], np.int64) for r in sorted(sums, key=lambda r: r["part"])])
    return total.reshape(folds, buckets) if folds > 1 else total


def log_ratio(target: np.ndarray, raw: np.ndarray, back_off: float = BACK_OFF) -> np.ndarray:
    """Log of target over raw probability per bucket; both are given ``back_off`` more occurrences."""
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + back_off) / (expected + back_off))


def importance(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``row`` and ``label`` as they are, with ``score``, the mean log ratio of the n-grams of ``row.text``.

    ``ratios`` has one table for every ``fold`` and a last one for rows without.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.rint(ratios * _UNIT).astype(np.int64))
    schema = T.StructType([docs.schema["row"], docs.schema["label"], T.StructField("score", T.DoubleType())])
    place = docs.schema["row"].dataType.names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        size = tables.shape[1]
        for batch in batches:
            texts = batch.append_column("text", batch.column("row").field(place))
            for piece in B.pieces(texts, "text"):
                found, bounds = features(*B.raw(piece.column("text")), size)
                n = np.diff(bounds)
                fold = piece.column("fold").to_numpy().astype(np.int64)
                values = tables.ravel()[found + np.repeat(fold, n) * size]
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
                mean = np.where(n > 0, np.diff(sums[bounds]) / _UNIT / (n + PRIOR), EMPTY)
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("label"), pa.array(mean)], names=schema.names)

    return docs.select("row", "label", "fold").mapInArrow(score, schema)


def key_of(temperature: float = TEMPERATURE, seed: str = SEED, doc_id: str = "doc_id") -> Column:
    """Importance over temperature plus Gumbel noise from a hash of seed and ``doc_id``, in billionths."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 52)).cast("double")
    u = (draw + 0.5) / F.lit(float(1 << 52))
    key = F.col("_imp_score") / F.lit(temperature) - F.log(-F.log(u))
    return F.when(F.col("_imp_score") > EMPTY, F.floor(key * 1e9).cast("bigint"))


def kth_largest(values: DataFrame, k: int, *, bins: int = 4096) -> tuple[int, int]:
    """The k-th largest of a whole-number column ``v``, and how many of its equals are among the k.

    The range is cut into ``bins`` parts, of which only the counts reach the driver; the part that
    holds the k-th value is cut again until it holds a single value.
    """
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = values.where(F.col("v").between(low, high))
        wide = "cast({} as decimal(20,0))".format
        part = F.expr(f"({wide('v')} - {wide(repr(str(low)))}) div {wide(repr(str(width)))}")
        counts = {r["part"]: r["n"] for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        for chosen in sorted(counts, reverse=True):
            if k <= counts[chosen]:
                break
            k -= counts[chosen]
        low, high = low + chosen * width, min(high, low + (chosen + 1) * width - 1)
    return low, k


def among_top(slim: DataFrame, k: int) -> Column:
    """Whether a row with ``doc_id, _imp_key`` is one of the k largest keys of ``slim``.

    Equal keys at the edge are taken by ``doc_id``, null first; rows equal in both share a decision.
    """
    key = F.col("_imp_key")
    present = slim.where(key.isNotNull())
    if k >= present.count():
        return key.isNotNull()
    if k <= 0:
        return F.lit(False)
    edge, left = kth_largest(present.select(key.alias("v")), k)
    # The order of two's complement without its sign: smaller identifiers are larger values.
    order = F.when(F.col("doc_id").isNull(), F.lit((1 << 63) - 1)).otherwise(F.bitwise_not(F.col("doc_id").cast("bigint")))
    last, _ = kth_largest(present.where(key == edge).select(order.alias("v")), left)
    return F.coalesce((key > edge) | ((key == edge) & (order >= last)), F.lit(False))


def _sample(labels: DataFrame, quality: int, rows: int, seed: str) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return labels.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, *, target_rows: int, seed: str) -> DataFrame:
    """``row, label, fold`` of every row: label 1, 0 or null, and the fold of target rows (else ``FOLDS``).

    At most ``target_rows`` ``doc_id`` of each quality are labelled, so their list is small enough to broadcast.
    """
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = _sample(best, 1, target_rows, seed).unionByName(_sample(best, 0, target_rows, seed))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(F.broadcast(known), F.col("row.doc_id") == F.col("doc_id"), "left")
    fold = F.when(F.col("quality") == 1, F.pmod(F.xxhash64(F.lit(seed), F.col("row.text")), F.lit(FOLDS))).otherwise(FOLDS)
    return joined.select("row", F.col("quality").cast("int").alias("label"), fold.cast("int").alias("fold"))


@dataclass
class Draw:
    """All rows with ``_imp_score`` and ``_imp_key`` beside ``row``, stored once, and the number to draw."""

    rows: DataFrame
    k: int

    def slim(self) -> DataFrame:
        return self.rows.select(F.col("row.doc_id").alias("doc_id"), "_imp_score", "_imp_key")


def score_all(
    docs: DataFrame,
    labels: DataFrame,
    *,
    target_rows: int = TARGET_ROWS,
    below: float = BELOW,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
) -> Draw:
    """Score and key of every row; ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id, quality``."""
    rows = labelled(docs, labels, target_rows=target_rows, seed=seed)
    target = rows.where(F.col("fold") < FOLDS).select(F.col("row.text").alias("text"), "fold")
    per_fold = bucket_counts(target, fold="fold", folds=FOLDS)
    raw, whole = bucket_counts(docs), per_fold.sum(axis=0)
    ratios = np.stack([*(log_ratio(whole - own, raw) for own in per_fold), log_ratio(whole, raw)])
    scored = importance(rows, ratios).withColumnRenamed("score", "_imp_score")
    key = key_of(temperature, seed, doc_id="row.doc_id")
    stored = durable(scored.select("row", "label", "_imp_score", key.alias("_imp_key")))
    with_text = stored.where(F.col("_imp_score") > EMPTY)
    level = lambda label, share: F.percentile(F.when(F.col("label") == label, F.col("_imp_score")), F.lit(share))
    good, bad = with_text.where("label IS NOT NULL").agg(level(1, below), level(0, 1 - below)).first()
    cut = -math.inf if good is None else good
    if bad is not None and bad < cut:
        cut -= MARGIN * (cut - bad)
    return Draw(stored, with_text.where(F.col("_imp_score") >= F.lit(cut)).count())


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The drawn documents, with the columns of ``docs``."""
    draw = score_all(docs, labels, **options)
    slim = draw.slim()
    kept = draw.rows.withColumn("doc_id", F.col("row.doc_id")).where(among_top(slim, draw.k))
    return kept.select("row.*")
