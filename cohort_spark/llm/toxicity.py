"""Toxicity by classifier chains.

Categories are predicted one after the other by linear models over the distinct words of a text;
each model also gets the log odds of all earlier categories. Those inputs come, in training, from
models that did not see the row (folds), and in prediction from the final models.

The models are fitted on at most ``LABELLED_ROWS`` labelled rows, drawn by a hash of ``doc_id``, with
at most ``VOCABULARY`` words of them; every document is judged over its whole text.

Words are runs of letters, digits and non-ASCII characters in lower case, so capitals and attached
symbols hide nothing. Defined cases: a null or empty text gets the probabilities of no words; rows
with the same ``doc_id`` are judged one by one, and of repeated labels each flag counts if any row has it; null labels are left out; without
labels, or with one class only, a category has its smoothed share as probability everywhere; an
empty table gives an empty one. Columns pass through; the added ones start with ``_tox_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.llm import bytes as B

LABELLED_ROWS = 6_000
VOCABULARY = 50_000
LEAST_DOCUMENTS = 3
# Words of more than this share of the labelled rows say nothing about one of them.
COMMON = 0.3
FOLDS = 3
STEPS = 60
# Words of the vocabulary that one model looks at.
SCREENED = 1000
PENALTY = 0.1
SEED = "tox-1"


def _word_hashes(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the words before each text."""
    data, at = B.raw(batch.column(text))
    data = B.LOWER[data]
    starts, ends, first, mask = B.words(data, at, B.ALNUM)
    return B.hashes(data, mask, starts, ends), first


@dataclass
class Rows:
    """Distinct vocabulary words of some texts: word number and text number of each."""

    word: np.ndarray
    row: np.ndarray
    count: int


def present(hashed: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> Rows:
    """Which vocabulary words each text has."""
    count = len(first) - 1
    if not len(vocabulary) or not len(hashed):
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), count)
    at = np.searchsorted(vocabulary, hashed)
    at[at == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[at] == hashed)
    row = np.repeat(np.arange(count), np.diff(first))[known]
    pair = np.unique(row * len(vocabulary) + at[known])
    return Rows(pair % len(vocabulary), pair // len(vocabulary), count)


@dataclass
class Linear:
    """Weights per word and per earlier category, and the bias."""

    word: np.ndarray
    earlier: np.ndarray
    bias: float

    def log_odds(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(rows.row, self.word[rows.word], rows.count) + earlier @ self.earlier


def _minimise(loss, at: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    cost, gradient = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, used = -gradient, []
        for s, g in reversed(moves):
            a = (s @ direction) / (s @ g)
            direction = direction - a * g
            used.append(a)
        if moves:
            s, g = moves[-1]
            direction = direction * ((s @ g) / (g @ g))
        else:
            direction = direction / max(1.0, float(np.abs(gradient).sum()))
        for (s, g), a in zip(moves, reversed(used), strict=True):
            direction = direction + s * (a - (g @ direction) / (s @ g))
        slope, step = gradient @ direction, 1.0
        while step > 1e-6:
            new_cost, new_gradient = loss(at + step * direction)
            if new_cost <= cost + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, g = step * direction, new_gradient - gradient
        if s @ g > 1e-12:
            moves = [*moves[1 - memory :], (s, g)]
        done = cost - new_cost < 1e-6 * max(1.0, cost)
        at, cost, gradient = at + s, new_cost, new_gradient
        if done:
            break
    return at


def fit_linear(rows: Rows, earlier: np.ndarray, target: np.ndarray, use: np.ndarray, words: int) -> Linear:
    """Logistic regression on the rows ``use``; words scaled by their log count ratio between the classes."""
    y = target.astype(float)
    share = (y[use].sum() + 0.5) / (use.sum() + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y[use].sum() < use.sum():
        return Linear(np.zeros(words), np.zeros(earlier.shape[1]), bias)
    mine = use[rows.row]
    word, row = rows.word[mine], rows.row[mine]
    for_class = lambda flags: np.bincount(word[flags[row]], minlength=words) + 0.5
    yes, no = for_class(y > 0), for_class(y == 0)
    n_yes, n_no = y[use].sum() + 1, (1 - y)[use].sum() + 1
    scale = np.abs(np.log(yes / n_yes) - np.log(no / n_no))
    # Only the words whose split between the classes is the least likely by chance take part.
    both = yes + no
    unlikely = yes * np.log(yes / (both * n_yes / (n_yes + n_no))) + no * np.log(no / (both * n_no / (n_yes + n_no)))
    chosen = np.sort(np.argsort(-unlikely, kind="stable")[:SCREENED])
    number = np.full(words, -1)
    number[chosen] = np.arange(len(chosen))
    row, word = row[number[word] >= 0], number[word][number[word] >= 0]
    scale, n = scale[chosen], len(chosen)
    wide = np.clip(earlier, -8, 8) / 4
    weight, side = np.zeros(words), np.zeros(earlier.shape[1])

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, s, b = v[:n], v[n:-1], v[-1]
        z = b + np.bincount(row, (w * scale)[word], rows.count) + wide @ s
        error = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0)
        cost = np.where(use, np.logaddexp(0, z) - y * z, 0.0).sum() + PENALTY / 2 * (v[:-1] @ v[:-1])
        gradient = np.concatenate([np.bincount(word, error[row], n) * scale, wide.T @ error, [error.sum()]])
        gradient[:-1] += PENALTY * v[:-1]
        return cost, gradient

    found = _minimise(loss, np.concatenate([np.zeros(n + earlier.shape[1]), [bias]]))
    weight, side, bias = np.zeros(words), found[n:-1], found[-1]
    weight[chosen] = found[:n] * scale
    return Linear(weight, side / 4, float(bias))


@dataclass
class Chain:
    """The categories in order and their models."""

    categories: list[str]
    vocabulary: np.ndarray
    models: list[Linear]

    def log_odds(self, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One column per category."""
        rows = present(hashed, first, self.vocabulary)
        out = np.zeros((rows.count, 0))
        for model in self.models:
            z = model.log_odds(rows, np.clip(out, -8, 8))
            out = np.column_stack([out, z])
        return out


def fit_chain(
    hashed: np.ndarray, first: np.ndarray, targets: Mapping[str, np.ndarray], fold: np.ndarray, *, vocabulary: int = VOCABULARY
) -> tuple[Chain, np.ndarray]:
    """The chain and the out-of-fold log odds of its categories."""
    words, inverse = np.unique(hashed, return_inverse=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = np.unique(inverse * (len(first)) + row) // len(first) if len(hashed) else np.zeros(0, np.int64)
    documents = np.bincount(pairs, minlength=len(words))
    fit = np.flatnonzero((documents >= LEAST_DOCUMENTS) & (documents <= max(COMMON * (len(first) - 1), LEAST_DOCUMENTS)))
    fit = np.sort(fit[np.argsort(-documents[fit], kind="stable")[:vocabulary]])
    chosen = words[fit]
    rows = present(hashed, first, chosen)
    models: list[Linear] = []
    known = np.zeros((rows.count, 0))
    for target in targets.values():
        everyone = np.ones(rows.count, bool)
        held = np.zeros(rows.count)
        for k in range(FOLDS):
            part = fit_linear(rows, known, target, everyone & (fold != k), len(chosen))
            held[fold == k] = part.log_odds(rows, np.clip(known, -8, 8))[fold == k]
        models.append(fit_linear(rows, known, target, everyone, len(chosen)))
        known = np.column_stack([known, held])
    return Chain(list(targets), chosen, models), known


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, Column],
    *,
    text: str = "text",
    labelled_rows: int = LABELLED_ROWS,
    seed: str = SEED,
) -> tuple[Chain, np.ndarray, dict[str, np.ndarray]]:
    """Fit on a bounded sample; ``categories`` are conditions on the columns of ``labels``, in chain order.

    Returns the chain, out-of-fold log odds and targets of the sample.
    """
    named = {f"_tox_{i}": c.cast("int") for i, c in enumerate(categories.values())}
    flags = labels.select(F.col("doc_id").alias("_tox_id"), *[c.alias(n) for n, c in named.items()]).dropna()
    sample = (
        flags.groupBy("_tox_id")
        .agg(*[F.max(n).alias(n) for n in named])
        .orderBy(F.xxhash64(F.lit(seed), F.col("_tox_id")), "_tox_id")
        .limit(labelled_rows)
    )
    joined = docs.select("doc_id", F.col(f"`{text}`").alias("_tox_text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_tox_id"))

    flag_names = list(named)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "_tox_text"):
                hashed, first = _word_hashes(piece, "_tox_text")
                distinct = [np.unique(hashed[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(d) for d in distinct])]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(distinct)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(n) for n in ("doc_id", *flag_names)] + [words], names=["doc_id", *flag_names, "words"]
                )

    schema = ", ".join(["doc_id bigint", *[f"{n} int" for n in named], "words array<bigint>"])
    table = joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), *named, "_tox_text").mapInArrow(extract, schema)
    found = table.toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    words = found["words"].combine_chunks()
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    hashed = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ids = found["doc_id"].to_numpy().astype(np.int64).view(np.uint64)
    fold = (B.mix(ids + np.uint64(1)) % np.uint64(FOLDS)).astype(np.int64)
    targets = {c: found[n].to_numpy() for c, n in zip(categories, named, strict=True)}
    chain, held = fit_chain(hashed, first, targets, fold)
    return chain, held, targets


def predict(docs: DataFrame, chain: Chain, *, text: str = "text") -> DataFrame:
    """Documents with ``_tox_<category>``, the probability of each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"_tox_{c}" for c in chain.categories]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in added]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, text):
                odds = shared.value.log_odds(*_word_hashes(piece, text))
                columns = [pa.array(1 / (1 + np.exp(-np.clip(odds[:, i], -700, 700)))) for i in range(len(added))]
                yield pa.RecordBatch.from_arrays([*[piece.column(f.name) for f in kept], *columns], names=schema.names)

    return docs.mapInArrow(judge, schema)


def default_categories() -> dict[str, Column]:
    """Toxic prose and toxic junk first; whether a text is toxic at all is asked last, knowing both."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return {"toxic_prose": toxic & good, "toxic_junk": toxic & ~good, "toxic": toxic}


def flagged(category: str = "toxic", threshold: float = 0.5) -> Column:
    """True where the probability reaches the threshold."""
    return F.col(f"_tox_{category}") >= threshold


def names(categories: Sequence[str]) -> list[Column]:
    """The probabilities under plain names."""
    return [F.col(f"_tox_{c}").alias(f"p_{c}") for c in categories]
