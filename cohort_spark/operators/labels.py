"""Weak labels from reports: language, sections, lexicon evidence, semantic scores, audits.

A report is one row from beginning to end, so labelling needs no shuffle and no join: sentences,
term matches and verdicts are nested values, and only the fan-out to targets adds rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import durable, finite, require_columns, settled
from cohort_spark.functions import text as X
from cohort_spark.functions.lexicon import KNEE, Lexicon
from cohort_spark.functions.probability import sigmoid_margin
from cohort_spark.operators.metrics import auc
from cohort_spark.skew import exact_quantiles

# Characters of context that decide negation (fixed values).
CONTEXT_BEFORE = 100
CONTEXT_AFTER = 60
# Negation markers that also count after the term (fixed values).
AFTER_MARKERS = ("intact", "normal")

# Verdict per status: probability, binary label, confidence (fixed values).
VERDICTS = {
    "positive": (0.95, 1, 0.9),
    "uncertain": (0.5, None, 0.25),
    "negative": (0.05, 0, 0.85),
    "mentioned_without_status": (0.5, None, 0.15),
    "not_mentioned": (0.5, None, 0.0),
}


def composed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the NFKC form of a text column, null as empty.

    The only Python in this module. It is a step of its own, so that expressions over the result
    are not folded into the function's arguments and evaluated again.
    """
    return df.withColumn(name, X.nfkc(F.coalesce(F.col(text), F.lit(""))))


def with_language(
    df: DataFrame, text: str, *, name: str = "detected", is_composed: bool = False
) -> DataFrame:
    """Add the detected language of a text column as a struct; ``is_composed`` skips NFKC."""
    staged = df if is_composed else composed(df, text, "_nfkc")
    source = F.col(text) if is_composed else F.col("_nfkc")
    tokens = settled(staged, "_tokens", X.marker_tokens(X.casefold(source)))
    parts = _with_scripts(tokens, text)
    detected = X.language_of(F.col("_scripts"), F.col("_total"), F.col("_tokens"))
    return settled(parts, name, detected).drop("_total", "_scripts", "_nfkc", "_tokens")


def _with_scripts(df: DataFrame, text: str) -> DataFrame:
    """Add ``_total``, the number of letters, and ``_scripts``.

    ASCII letters are Latin and only counted; the costly classes see the other characters. All
    letters are taken only from a text with letters that are not Latin.
    """
    counted = settled(df, "_ascii", X.ascii_letters(F.col(text)))
    beyond = settled(counted, "_beyond", X.letters(X.beyond_ascii(F.col(text))))
    sized = settled(beyond, "_latin", F.col("_ascii") + X.latin_letters(F.col("_beyond")))
    total = sized.withColumn("_total", F.col("_ascii") + F.length("_beyond"))
    lettered = settled(total, "_letters", F.when(F.col("_latin") < F.col("_total"), X.letters(F.col(text))))
    scripts = X.script_counts(F.col("_letters"), F.col("_total"), F.col("_latin"))
    return settled(lettered, "_scripts", scripts).drop("_ascii", "_beyond", "_latin", "_letters")


def script_profile(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Letters per writing system, one row per (text, script)."""
    profile = _with_scripts(df.select(*keep, text), text).select(*keep, F.inline_outer("_scripts"))
    return profile.where(F.col("script").isNotNull())


def parse_reports(df: DataFrame, text: str) -> DataFrame:
    """Add normalised text, sections and the sentences of the section bodies."""
    tidy = settled(composed(df, text, "_nfkc"), "normalized_text", X.tidy(F.col("_nfkc"))).drop("_nfkc")
    parsed = settled(tidy, "sections", X.sections(F.col("normalized_text")))
    return settled(parsed, "sentences", X.section_sentences(F.col("sections")))


# --- term matching -------------------------------------------------------------------------------


def _quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _whole_word(term: str) -> str:
    """The term between non-word characters; the literal comes first, which scans fastest."""
    literal = _quoted(term)
    return f"{literal}(?<![{X.WORD}]{literal})(?![{X.WORD}])"


def _term_table(lexicon: Lexicon) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(target).alias("target"),
                F.lit(term.casefold()).alias("term"),
                F.lit(_whole_word(term.casefold())).alias("pattern"),
                F.lit(target in lexicon.needs_marker).alias("needs_marker"),
            )
            for target, terms in lexicon.terms.items()
            for term in terms
        ]
    )


def _markers_for(lexicon: Lexicon, kind: str, language: Column) -> Column:
    table = lexicon.markers(kind)
    empty = F.array().cast("array<string>")

    def words(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else empty

    chosen = words(table["unknown"])
    for name, values in table.items():
        if name != "unknown":
            chosen = F.when(language == name, words(values)).otherwise(chosen)
    return chosen


def _holds(text: Column, markers: Column) -> Column:
    return F.exists(markers, lambda m: F.contains(text, m))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference would be evaluated per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _contexts(folded: Column, term: Column) -> Column:
    """Left and right context of every whole-word match of a term.

    Splitting at the matches gives the pieces between them. A context is rebuilt from the nearest
    pieces only: each carries the term, so as many pieces as context characters always suffice.
    """

    def around(pieces: Column) -> Column:
        def one(i: Column) -> Column:
            first = F.greatest(i - CONTEXT_BEFORE, F.lit(0))
            before = F.slice(pieces["left"], first + 1, i - first + 1)
            after = F.slice(pieces["right"], i + 2, F.lit(CONTEXT_AFTER + 1))
            return F.struct(
                F.right(
                    F.call_function("array_join", before, term["term"]), F.lit(CONTEXT_BEFORE)
                ).alias("before"),
                F.left(
                    F.call_function("array_join", after, term["term"]), F.lit(CONTEXT_AFTER)
                ).alias("after"),
            )

        last = F.size(pieces["left"]) - 2
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one))

    def cut(pieces: Column) -> Column:
        return F.struct(
            F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT_BEFORE))).alias("left"),
            F.transform(pieces, lambda p: F.left(p, F.lit(CONTEXT_AFTER))).alias("right"),
        )

    pieces = F.split(folded, term["pattern"], -1)
    found = _let(pieces, lambda p: _let(cut(p), around))
    return F.coalesce(found, F.array().cast("array<struct<before:string,after:string>>"))


def with_matches(
    df: DataFrame,
    lexicon: Lexicon,
    *,
    sentences: str,
    language: Column,
    text: str | None = None,
) -> DataFrame:
    """Add ``matches``: every term occurrence as (target, term, position, sentence, status).

    Sentences are first reduced to those that contain some term as plain text. ``text`` names the
    column the sentences come from, which is tested once for plain characters instead of each.
    """
    terms = _term_table(lexicon)
    plain = X.is_plain(F.col(text)) if text else F.forall(sentences, X.is_plain)
    staged = settled(df, "_plain", plain).withColumns(
        {
            "_folded": F.transform(sentences, lambda s: X.casefold(s, F.col("_plain"))),
            "_negation": _markers_for(lexicon, "negation", language),
            "_uncertainty": _markers_for(lexicon, "uncertainty", language),
            "_pathology": _markers_for(lexicon, "pathology", language),
        }
    )
    numbered = F.transform(
        F.arrays_zip(F.col("_folded").alias("folded"), F.col(sentences).alias("sentence")),
        lambda s, i: F.struct(
            i.alias("position"), s["sentence"].alias("sentence"), s["folded"].alias("folded")
        ),
    )
    words = F.array(*[F.lit(t) for t in sorted({t.casefold() for ts in lexicon.terms.values() for t in ts})])
    hits = staged.withColumn(
        "_hits", F.filter(numbered, lambda s: F.exists(words, lambda t: F.contains(s["folded"], t)))
    )

    def judged(s: Column) -> Column:
        return F.struct(
            s["position"].alias("position"),
            s["sentence"].alias("sentence"),
            s["folded"].alias("folded"),
            _holds(s["folded"], F.col("_uncertainty")).alias("uncertain"),
            _holds(s["folded"], F.col("_pathology")).alias("pathology"),
        )

    judged_hits = settled(hits, "_judged", F.transform("_hits", judged))
    after_markers = F.filter(
        F.transform("_negation", lambda m: F.trim(m)), lambda m: m.isin(*AFTER_MARKERS)
    )
    ready = judged_hits.withColumn("_after", after_markers)

    def status(s: Column, t: Column, c: Column) -> Column:
        negated = _holds(c["before"], F.col("_negation")) | _holds(c["after"], F.col("_after"))
        return (
            F.when(negated, "negative")
            .when(s["uncertain"], "uncertain")
            .when(t["needs_marker"] & ~s["pathology"], "mention")
            .otherwise("positive")
        )

    def of_term(s: Column, t: Column) -> Column:
        return F.transform(
            _contexts(s["folded"], t),
            lambda c: F.struct(
                t["target"].alias("target"),
                t["term"].alias("term"),
                s["position"].alias("position"),
                s["sentence"].alias("sentence"),
                status(s, t, c).alias("status"),
            ),
        )

    def of_sentence(s: Column) -> Column:
        found = F.filter(terms, lambda t: F.contains(s["folded"], t["term"]))
        return F.flatten(F.transform(found, lambda t: of_term(s, t)))

    return settled(ready, "matches", F.flatten(F.transform("_judged", of_sentence))).drop(
        "_plain", "_folded", "_negation", "_uncertainty", "_pathology", "_hits", "_judged", "_after"
    )


def lexicon_matches(matched: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per term occurrence."""
    return matched.select(*keep, F.inline_outer("matches")).where(F.col("target").isNotNull())


def label_targets(matched: DataFrame, targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Verdict of every (report, target), reports without a mention included.

    Precedence: positive, uncertain, negative, mentioned. Evidence keeps each sentence once, in
    order of appearance.
    """
    # Each target's row carries its own matches only, settled as generator output.
    def own(target: str) -> Column:
        mine = F.filter("matches", lambda m: m["target"] == target)
        return F.struct(F.lit(target).alias("target"), mine.alias("_mine"))

    fanned = matched.select(*keep, F.inline(F.array(*[own(t) for t in targets])))

    def seen(name: str) -> Column:
        return F.exists("_mine", lambda m: m["status"] == name)

    status = (
        F.when(seen("positive"), "positive")
        .when(seen("uncertain"), "uncertain")
        .when(seen("negative"), "negative")
        .when(F.size("_mine") > 0, "mentioned_without_status")
        .otherwise("not_mentioned")
    )
    decided = fanned.withColumn("status", status)
    chosen = F.filter(
        "_mine",
        lambda m: (m["status"] == F.col("status"))
        | (F.col("status") == "mentioned_without_status"),
    )

    def verdict(index: int, kind: str) -> Column:
        value = F.lit(None).cast(kind)
        for name, values in VERDICTS.items():
            value = F.when(F.col("status") == name, F.lit(values[index]).cast(kind)).otherwise(value)
        return value

    return decided.select(
        *keep,
        "target",
        verdict(0, "double").alias("weak_probability"),
        verdict(1, "int").alias("weak_label"),
        verdict(2, "double").alias("weak_confidence"),
        F.col("status").alias("weak_status"),
        F.array_distinct(F.transform(chosen, lambda m: m["sentence"])).alias("evidence"),
    )


def label_corpus(
    reports: DataFrame,
    *,
    text: str = "Report",
    keep: Sequence[str] = ("StudyInstanceUID",),
    lexicon: Lexicon = KNEE,
    targets: Sequence[str] | None = None,
) -> DataFrame:
    """Weak labels of all reports in long form, with language, confidence and script."""
    require_columns(reports, [text, *keep])
    lexicon = lexicon if targets is None else lexicon.restricted(targets)
    parsed = parse_reports(reports.select(*keep, text), text)
    detected = with_language(parsed, "normalized_text", is_composed=True)
    matched = with_matches(
        detected,
        lexicon,
        sentences="sentences",
        language=F.col("detected.language"),
        text="normalized_text",
    ).select(
        *keep,
        F.col("detected.language").alias("language"),
        F.col("detected.confidence").alias("language_confidence"),
        F.col("detected.script").alias("dominant_script"),
        "matches",
    )
    kept = [*keep, "language", "language_confidence", "dominant_script"]
    return label_targets(matched, lexicon.targets, kept)


def weak_label_audit(labels: DataFrame) -> DataFrame:
    """Coverage, gold AUC and accuracy of determinate labels per target.

    Needs ``target, gold, weak_probability, weak_label``. These cells are stored once, because both
    aggregations read them and labelling is the costly part.
    """
    labels = durable(labels.select("target", "gold", "weak_probability", "weak_label"))
    gold = finite(F.col("gold"))
    determinate = F.col("weak_label").isNotNull()
    counted = labels.groupBy("target").agg(
        F.count(gold).alias("gold_known"),
        F.count_if(determinate).alias("weak_determinate"),
        F.avg(determinate.cast("double")).alias("weak_coverage"),
        F.avg(
            F.when(
                gold.isNotNull() & determinate, (F.col("weak_label") == gold.cast("int")).cast("double")
            )
        ).alias("gold_determinate_accuracy"),
    )
    scored = auc(labels.select("target", "gold", F.col("weak_probability").alias("score")))
    return counted.join(scored.select("target", F.col("auc").alias("gold_auc")), "target")


def status_counts(labels: DataFrame) -> DataFrame:
    """Reports per (target, status)."""
    return labels.groupBy("target", "weak_status").agg(F.count("*").alias("n"))


# --- corpus --------------------------------------------------------------------------------------


def corpus_languages(reports: DataFrame, text: str) -> DataFrame:
    """Reports and mean confidence per detected language and dominant script."""
    detected = with_language(reports.select(F.coalesce(text, F.lit("")).alias("_text")), "_text")
    return detected.groupBy(
        F.col("detected.language").alias("language"), F.col("detected.script").alias("script")
    ).agg(F.count("*").alias("n"), F.avg("detected.confidence").alias("mean_confidence"))


# Length quantiles reported for a corpus (fixed values).
LENGTH_QUANTILES = {
    "q0": 0.0,
    "q10": 0.1,
    "q25": 0.25,
    "q50": 0.5,
    "q75": 0.75,
    "q90": 0.9,
    "q99": 0.99,
    "q100": 1.0,
}


def length_quantiles(reports: DataFrame, text: str) -> DataFrame:
    """Exact quantiles of the report lengths; equal lengths are combined first."""
    lengths = reports.select(F.length(F.coalesce(text, F.lit(""))).alias("length"))
    return exact_quantiles(lengths, [], "length", LENGTH_QUANTILES)


def duplicate_texts(reports: DataFrame, text: str) -> DataFrame:
    """Groups of reports with the same normalised, folded text.

    Texts are replaced by a digest before the shuffle and combined map-side, so a group of copies
    of any size costs one row per task.
    """
    tidy = composed(reports.select(text), text, "_nfkc").select(X.tidy(F.col("_nfkc")).alias("_tidy"))
    return (
        tidy.select(X.casefold(F.col("_tidy")).alias("_text"))
        .where(F.col("_text") != "")
        .groupBy(F.sha2("_text", 256).alias("digest"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )


def duplicate_summary(reports: DataFrame, text: str) -> DataFrame:
    """Number of duplicate groups, reports in them and the largest group."""
    return duplicate_texts(reports, text).agg(
        F.count("*").alias("group_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("study_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("maximum_group_size"),
    )


def corpus_totals(reports: DataFrame, text: str) -> DataFrame:
    """Reports and missing reports."""
    return reports.agg(
        F.count("*").alias("row_count"), F.count_if(F.col(text).isNull()).alias("missing_reports")
    )


# --- semantic scores -----------------------------------------------------------------------------


def semantic_margin(similarities: DataFrame, scale: float = 10.0) -> DataFrame:
    """Probability from the best positive and the best negative similarity."""
    return similarities.withColumn(
        "probability",
        sigmoid_margin(F.col("positive_similarity") - F.col("negative_similarity"), scale),
    )
