"""Quality rules as a short-circuit cascade, all in SQL expressions.

The base counts are computed for every document. The remaining rules each reject documents; their
rejection rate and running time are estimated on a sample, and the cascade asks them in order of
rejections per second, so that a costly rule only sees what cheap ones let pass. A document is kept
when no rule rejects it, so the order changes the work and never the verdict.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows
are judged one by one; an empty table (or sample) leaves the rules in the given order; further
columns pass through, and the added ones start with ``_rule_``.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import durable, settled

SAMPLE_ROWS = 1000
LEAST_WORDS = 50
MOST_REPEATED = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WORD = r"[^\x20\x09-\x0D]+"


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    return settled(df, f"_rule_{name}", value)


def _long(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_rule_`` columns with the base counts of every whole text.

    Words of repeated 3-word windows: the windows' hashes are sorted with their places, so equal
    windows are neighbours; the places of those, in order, each cover at most 3 further words.
    """
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    spaces, symbols = " \t\n\x0b\f\r", "#*$%&|<>"
    df = docs.withColumns(
        {
            "_rule_word_chars": _long(F.length(F.translate(source, spaces, ""))),
            "_rule_n_symbols": _long(F.length(source) - F.length(F.translate(source, symbols, ""))),
        }
    )
    df = _with(df, "lines", F.filter(F.split(source, "\n"), lambda x: x.rlike(_WORD)))
    df = df.withColumns(
        {
            "_rule_n_lines": _long(F.size("_rule_lines")),
            "_rule_n_dup_lines": _long(F.size("_rule_lines") - F.size(F.array_distinct("_rule_lines"))),
        }
    ).drop("_rule_lines")
    df = _with(
        df, "h", F.transform(F.regexp_extract_all(source, F.lit(f"({_WORD})")), lambda w: F.xxhash64(w))
    )
    df = df.withColumn("_rule_n_words", _long(F.size("_rule_h")))
    h = F.col("_rule_h")
    places = F.slice(h, F.lit(1), F.greatest(F.col("_rule_n_words").cast("int") - 2, F.lit(0)))
    windows = F.transform(
        places,
        lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")),
    )
    df = _with(df, "sorted", F.sort_array(windows)).drop("_rule_h")
    around = F.col("_rule_sorted")
    again = F.filter(
        around,
        lambda x, j: F.coalesce(F.get(around, j - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(around, j + 1)["h"] == x["h"], F.lit(False)),
    )
    df = _with(df, "again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_rule_sorted")
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        "_rule_again",
        state,
        lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")),
        lambda s: s["n"],
    )
    return _with(df, "n_repeat_words", covered).drop("_rule_again")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    n = F.col("_rule_n_words")
    return (n < LEAST_WORDS) | (F.col("_rule_n_repeat_words") * 100 > n * MOST_REPEATED)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def default_rules(text: str = "text") -> dict[str, Column]:
    """Further reasons to reject; true rejects."""
    n = F.col("_rule_n_words")
    t = F.col(f"`{text}`")
    return {
        "symbols": F.col("_rule_n_symbols") * 10 > n * 3,
        "duplicate_lines": F.col("_rule_n_dup_lines") * 2 > F.col("_rule_n_lines"),
        "short_words": F.col("_rule_word_chars") < n * 2,
        "long_words": F.col("_rule_word_chars") > n * 20,
        "exclamations": _matches(t, "!") * 10 > n * 3,
        "capitals": _matches(t, r"\p{Lu}{2,}") * 2 > n,
        "few_letters": _matches(t, r"\p{L}") * 2 < F.col("_rule_word_chars"),
        "one_letter_words": _matches(t, r"(?<![^\x20\x09-\x0D])\p{L}(?![^\x20\x09-\x0D])") * 2 > n,
    }


def _seconds(df: DataFrame, rule: Column) -> tuple[float, int]:
    start = time.perf_counter()
    rejected = df.agg(F.count_if(rule)).first()[0]
    return time.perf_counter() - start, rejected


def cascade_order(
    counted: DataFrame, rules: Mapping[str, Column], *, sample_rows: int = SAMPLE_ROWS
) -> list[str]:
    """Rule names by rejections per second on ``sample_rows`` documents, the most first."""
    sample = durable(counted.limit(sample_rows)).coalesce(1)
    _seconds(sample, F.lit(False))
    idle, _ = _seconds(sample, F.lit(False))
    worth = {}
    for name, rule in rules.items():
        took, rejected = _seconds(sample, rule)
        worth[name] = rejected / max(took - idle, 1e-3)
    return sorted(rules, key=lambda name: -worth[name])


def verdict(rules: Mapping[str, Column], order: Sequence[str]) -> Column:
    """True for kept; conditions are asked in order and only as far as needed."""
    out = F.when(base_failed(), False)
    for name in order:
        out = out.when(F.coalesce(rules[name], F.lit(False)), False)
    return out.otherwise(True)


def judge(
    docs: DataFrame,
    rules: Mapping[str, Column] | None = None,
    *,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Documents with the base counts, ``_rule_base_failed`` and ``_rule_kept``."""
    rules = default_rules(text) if rules is None else rules
    order = cascade_order(base_counts(docs.limit(sample_rows), text), rules, sample_rows=sample_rows)
    counted = base_counts(docs, text)
    return counted.withColumns({"_rule_base_failed": base_failed(), "_rule_kept": verdict(rules, order)})
