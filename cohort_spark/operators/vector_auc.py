"""AUC of many weightings or many candidate scores of the same rows, without a copy of a row for each.

*Replicates* share the order of the scores and differ in the weights of the rows. The rows are put in
order once, and every task adds up vectors (one number per replicate) along its part of the order.

*Candidates* differ in the scores. A task scores a piece of the rows for one candidate after the other
and sends, per candidate and score range, sorted arrays in one row, equal scores counted; the pairs
within a range are counted on these arrays and those across ranges from the ranges' totals. The ranges
of a candidate hold equally many rows, however its scores are spread, so no step holds more of a target
than one range or one piece.

Areas are whole numbers (twice the count of ordered pairs) until the last division.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.core import durable

# Rows of one part of the order, and rows that meet their replicates' weights at once.
ROWS_PER_SLICE = 4_096
BLOCK = 1_024
# Rows of one score range of a candidate, and sampled rows that place a bound between two ranges.
ROWS_PER_RANGE = 50_000
ROWS_PER_BOUND = 200
# Rows that a task scores at once, sorted scores of one batch that it sends, and scores that meet their pairs at once.
ROWS_PER_PIECE = 32_768
CELLS_PER_BATCH = 131_072
SCORES_AT_ONCE = 4_096

# A draw is four hexadecimal digits of a digest, which serves eight replicates.
DIGITS = 4
PER_DIGEST = 32 // DIGITS
LEVELS = 16**DIGITS
# Draws below the first number weigh 0, below the second 1, ...: Poisson(1).
POISSON = [round(LEVELS * sum(math.exp(-1.0) / math.factorial(j) for j in range(i + 1))) for i in range(8)]


def draws(identifiers: Sequence[str | None], replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (identifiers x replicates): md5 of ``identifier:block:seed``, four digits each."""
    blocks = -(-replicates // PER_DIGEST)
    raw = b"".join(hashlib.md5(f"{i or ''}:{b}:{seed}".encode()).digest() for i in identifiers for b in range(blocks))
    numbers = np.frombuffer(raw, ">u2").reshape(len(identifiers), blocks * PER_DIGEST)[:, :replicates]
    return np.searchsorted(np.array(POISSON), numbers, side="right").astype(np.int64)


class _Order:
    """Sums along the ordered rows of one target: the first and the last score apart, the rest in one."""

    def __init__(self, target: str) -> None:
        self.target, self.rows = target, []
        self.open: list | None = None
        self.inner: list | None = None

    def _row(self, kind: str, score: float, positives: np.ndarray, negatives: np.ndarray, area: np.ndarray) -> None:
        self.rows.append((self.target, kind, score, positives.tolist(), negatives.tolist(), area.tolist()))

    def _close(self, last: bool) -> None:
        score, positives, negatives = self.open
        if last or not self.rows:
            self._row("tie", score, positives, negatives, np.zeros_like(positives))
            return
        if self.inner is None:
            self.inner = [score, np.zeros_like(positives), np.zeros_like(positives), np.zeros_like(positives)]
        self.inner[3] += positives * (2 * self.inner[2] + negatives)
        self.inner[1] += positives
        self.inner[2] += negatives

    def add(self, score: float, positives: np.ndarray, negatives: np.ndarray) -> None:
        if self.open and self.open[0] == score:
            self.open[1] += positives
            self.open[2] += negatives
            return
        if self.open:
            self._close(last=False)
        self.open = [score, positives, negatives]

    def end(self) -> list[tuple]:
        if self.open:
            self._close(last=True)
        if self.inner is not None:
            self._row("inner", *self.inner)
        return self.rows


_SUMS = "target string, kind string, score double, positives array<bigint>, negatives array<bigint>, area array<bigint>"


def _along(replicates: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: _Order | None = None
        done: list[tuple] = []
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                targets, scores = part.column("target").to_pylist(), part.column("score").to_numpy()
                weights = draws(part.column("identifier").to_pylist(), replicates, seed)
                gold = part.column("gold").to_numpy()
                same = [i == 0 or targets[i] != targets[i - 1] or scores[i] != scores[i - 1] for i in range(len(targets))]
                first = np.flatnonzero(same)
                positives = np.add.reduceat(weights * (gold == 1)[:, None], first, axis=0)
                negatives = np.add.reduceat(weights * (gold == 0)[:, None], first, axis=0)
                for k, i in enumerate(first.tolist()):
                    if order is None or order.target != targets[i]:
                        done += order.end() if order else []
                        order = _Order(targets[i])
                    order.add(float(scores[i]), positives[k].copy(), negatives[k].copy())
        done += order.end() if order else []
        if done:
            names = ["target", "kind", "score", "positives", "negatives", "area"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*done, strict=True), strict=True)))

    return work


def resampled_aucs(known: DataFrame, *, replicates: int, seed: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``target, replicate, auc`` over resampled identifiers; null when a class is absent.

    ``known`` has ``identifier, target, gold, score``, gold 0 or 1. The rows are shuffled once, as they
    are; rows of one score may be dealt to several tasks.
    """
    rows = known.select(F.col("identifier").cast("string"), "target", F.col("gold").cast("int").alias("gold"), (F.col("score") + F.lit(0.0)).alias("score"))
    slices = max(1, -(-rows.count() // rows_per_slice))
    spread = [F.col("target"), F.col("score"), F.xxhash64("identifier")]
    ordered = rows.repartitionByRange(slices, *spread).sortWithinPartitions("target", "score")
    sums = ordered.mapInArrow(_along(replicates, seed), _SUMS)
    zipped = F.arrays_zip("positives", "negatives", "area")
    flat = sums.select("target", "kind", "score", F.posexplode(zipped).alias("replicate", "x")).select("target", "kind", "score", "replicate", "x.*")
    added = flat.groupBy("target", "replicate", "kind", "score").agg(*[F.sum(c).alias(c) for c in ("positives", "negatives", "area")])
    before = Window.partitionBy("target", "replicate").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("negatives").over(before), F.lit(0))
    tied = F.when(F.col("kind") == "tie", F.col("positives") * F.col("negatives")).otherwise(F.col("area"))
    whole = added.withColumn("area", tied + 2 * F.col("positives") * below)
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return whole.groupBy("target", "replicate").agg(F.when(pairs > 0, F.sum("area") / 2 / pairs).alias("auc"))


_PACKED = "target string, candidate int, range int, scores binary, codes binary, counts binary"
_PACKED_ARROW = pa.schema(
    [("target", pa.string()), ("candidate", pa.int32()), ("range", pa.int32()), ("scores", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())]
)
_RANGES = "target string, candidate int, range int, positives array<bigint>, negatives array<bigint>, area array<bigint>"
_AUCS = "target string, candidate int, held_out {fold}, known bigint, positives bigint, negatives bigint, auc double"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in pieces of one size, whatever the size of the batches."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, ROWS_PER_PIECE - rows)
            waiting.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == ROWS_PER_PIECE:
                yield pa.Table.from_batches(waiting)
                waiting, rows = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _mixed(weights: Sequence[float], columns: Sequence[np.ndarray]) -> np.ndarray:
    score = np.zeros(len(columns[0]))
    for w, x in zip(weights, columns, strict=True):
        score = score + w * x
    return np.where(np.isfinite(score), score, -np.inf)


def _bounds(rows: DataFrame, sources: Sequence[str], candidates: np.ndarray, size: int, ranges: int) -> np.ndarray:
    """Per candidate, the scores between its ranges. They only deal the rows, so a sample places them."""
    if ranges < 2:
        return np.empty((len(candidates), 0))
    share = min(1.0, ranges * ROWS_PER_BOUND / size)
    drawn = rows.select(*sources).sample(share, seed=1).toArrow()
    columns = [drawn[s].to_numpy() for s in sources]
    at = np.arange(1, ranges) * drawn.num_rows // ranges
    return np.array([np.sort(_mixed(w, columns))[at] if drawn.num_rows else [] for w in candidates])


def _packed(sources: Sequence[str], candidates: np.ndarray, folds: list, bounds: np.ndarray):
    small = _code_type(len(folds))

    def cells(piece: pa.Table) -> Iterator[tuple]:
        fold = piece["fold"].combine_chunks()
        code = 2 * pc.index_in(fold, pa.array(folds, fold.type)).to_numpy(zero_copy_only=False) + piece["gold"].to_numpy()
        code = code.astype(small)
        columns = [piece[s].to_numpy() for s in sources]
        targets = piece["target"].combine_chunks().dictionary_encode("encode")
        at = targets.indices.to_numpy()
        for t, name in enumerate(targets.dictionary.to_pylist()):
            mine = np.flatnonzero(at == t)
            mine = mine[np.argsort(code[mine], kind="stable")]
            own, values = code[mine], [x[mine] for x in columns]
            for c, weights in enumerate(candidates):
                score = _mixed(weights, values)
                order = np.argsort(score, kind="stable")
                score, codes = score[order], own[order]
                new = np.ones(len(score), bool)
                new[1:] = (score[1:] != score[:-1]) | (codes[1:] != codes[:-1])
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(score))).astype(np.uint32)
                score, codes = score[first], codes[first]
                cuts = [0, *np.searchsorted(score, bounds[c]).tolist(), len(score)]
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        # Counts of one each are left out.
                        several = counts[a:b] if (counts[a:b] > 1).any() else counts[:0]
                        yield name, c, r, score[a:b].tobytes(), codes[a:b].tobytes(), several.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for piece in _pieces(batches):
            for cell in cells(piece):
                out.append(cell)
                held += len(cell[3]) // 8
                if held >= CELLS_PER_BATCH:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), _PACKED_ARROW.types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in columns], schema=_PACKED_ARROW)


def _code_type(folds: int) -> type:
    """A code is twice the number of the fold plus the gold."""
    return np.uint8 if folds <= 128 else np.uint16


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[column]])


def _counts(table: pa.Table) -> np.ndarray:
    rows = zip(table["scores"], table["counts"], strict=True)
    return np.concatenate([np.frombuffer(n.as_buffer(), np.uint32) if len(n.as_buffer()) else np.ones(len(s.as_buffer()) // 8, np.uint32) for s, n in rows])


def _range_sums(folds: int):
    kind = _code_type(folds)

    def work(table: pa.Table) -> pa.Table:
        scores = _joined(table, "scores", np.float64)
        order = np.argsort(scores)
        scores, codes, counts = scores[order], _joined(table, "codes", kind)[order], _counts(table)[order]
        new = np.append(True, scores[1:] != scores[:-1])
        row = np.cumsum(new)
        cuts = np.append(np.flatnonzero(new)[::SCORES_AT_ONCE], len(scores)).tolist()
        positives, negatives, area = np.zeros(folds, np.int64), np.zeros(folds, np.int64), np.zeros((folds, folds), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = row[a:b] - row[a]
            n = int(here[-1]) + 1
            grid = np.bincount(here * (2 * folds) + codes[a:b], counts[a:b], n * 2 * folds).astype(np.int64).reshape(n, folds, 2)
            q, p = grid[:, :, 0], grid[:, :, 1]
            area += p.T @ (2 * (negatives + np.cumsum(q, axis=0)) - q)
            positives += p.sum(axis=0)
            negatives += q.sum(axis=0)
        head = table.slice(0, 1).select(["target", "candidate", "range"])
        for name, x in {"positives": positives, "negatives": negatives, "area": area.ravel()}.items():
            head = head.append_column(name, pa.array([x.tolist()], pa.list_(pa.int64())))
        return head

    return work


def _held_out(folds: list, fold_type: pa.DataType):
    n = len(folds)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        positives, negatives, area = (
            table[c].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("positives", "negatives", "area")
        )
        below = np.cumsum(negatives, axis=0) - negatives
        whole = area.sum(axis=0).reshape(n, n) + 2 * positives.T @ below
        p, q = positives.sum(axis=0), negatives.sum(axis=0)
        rows = []
        for k, fold in enumerate(folds):
            rest = np.arange(n) != k
            a, b = int(p[rest].sum()), int(q[rest].sum())
            if a + b:
                twice = int(whole[np.ix_(rest, rest)].sum())
                rows.append((fold, a + b, a, b, twice / 2 / (float(a) * float(b)) if a and b else None))
        cells = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [fold_type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        out = [pa.array([table[c][0].as_py()] * len(rows), k) for c, k in (("target", pa.string()), ("candidate", pa.int32()))]
        out += [pa.array(x, k) for x, k in zip(cells, kinds, strict=True)]
        return pa.table(out, names=["target", "candidate", "held_out", "known", "positives", "negatives", "auc"])

    return work


def held_out_candidate_aucs(
    known: DataFrame, sources: Sequence[str], candidates: Sequence[Sequence[float]], folds: list, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``target, candidate, held_out, known, positives, negatives, auc`` of weighted sums of the sources.

    ``known`` has ``fold, target, gold`` and the sources, gold 0 or 1; each AUC is over the rows of the
    other folds. A sum that is not finite is below all others.
    """
    # Read to count them, to place the ranges and to score them.
    rows = durable(
        known.select("fold", "target", F.col("gold").cast("int").alias("gold"), *[F.col(s).cast("double").alias(s) for s in sources])
    )
    size, weights = rows.count(), np.array(candidates, float)
    bounds = _bounds(rows, sources, weights, size, max(1, -(-size // rows_per_range)))
    pieces = rows.repartition(max(1, -(-size // ROWS_PER_PIECE)))
    packed = pieces.mapInArrow(_packed(list(sources), weights, folds, bounds), _PACKED)
    sums = packed.groupBy("target", "candidate", "range").applyInArrow(_range_sums(len(folds)), _RANGES)
    fold = known.schema["fold"].dataType.simpleString()
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16()}[fold]
    return sums.groupBy("target", "candidate").applyInArrow(_held_out(folds, arrow), _AUCS.format(fold=fold))
