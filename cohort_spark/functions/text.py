"""Text expressions: Unicode normalisation, folding, sections, sentences, script and language.

Everything but Unicode composition and rare case folding is a built-in expression. Texts made only
of characters that the built-ins treat exactly skip the Arrow function (it receives null for them).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's notions of space and word character: as a list for trimming, and in Java's syntax.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = r"[\s\x1c-\x1f]"
WORD = r"\p{L}\p{N}_"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"

# Characters that NFKC leaves alone and whose case folding is lower case, but for two letters.
PLAIN = (
    r"\x00-\x7f"
    r"À-įıĴ-ľŁ-ňŊ-ž"
    r"ΆΈ-ΊΌΎΏΑ-ΡΣ-ία-ώ"
    r"Ѐ-џ"
    r"–—‘’“”"
)


def is_plain(text: Column) -> Column:
    """True when the built-in expressions normalise and fold the text exactly.

    ASCII is removed before the costlier test.
    """
    return ~beyond_ascii(text).rlike(f"[^{PLAIN}]")


def beyond_ascii(text: Column) -> Column:
    """The characters of a text that are not ASCII, in order."""
    return F.regexp_replace(text, r"[\x00-\x7f]+", "")


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition."""
    return F.coalesce(_nfkc(F.when(~is_plain(text), text)), text)


@cache
def _fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters whose folding differs, to one letter and to several; from Python's data."""
    single, several = {}, {}
    for point in range(0x20000):
        c = chr(point)
        folded = c.casefold()
        if folded == c or c.lower() != c or unicodedata.normalize("NFKC", c) != c:
            continue
        (single if len(folded) == 1 else several)[c] = folded
    return single, several


def casefold_plain(text: Column) -> Column:
    """Case folding of plain text: lower case, sharp s doubled, final sigma unified."""
    lower = F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))
    return F.replace(lower, F.lit("ß"), F.lit("ss"))


def _casefold_any(text: Column) -> Column:
    single, several = _fold_tables()
    folded = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    for letter, parts in several.items():
        folded = F.replace(folded, F.lit(letter), F.lit(parts))
    return folded


def casefold(text: Column, plain: Column | None = None) -> Column:
    """Case folding of composed text; ``plain`` says that the short form suffices."""
    plain = is_plain(text) if plain is None else plain
    return F.when(plain, casefold_plain(text)).otherwise(_casefold_any(text))


def strip(text: Column) -> Column:
    """Remove surrounding white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def tidy(text: Column) -> Column:
    """White-space part of the normalisation: one space, trimmed lines, no blank lines."""
    lines = F.split(F.replace(text, F.lit("\0"), F.lit(" ")), LINE_END, -1)
    trimmed = F.transform(lines, lambda line: strip(F.regexp_replace(line, r"[\t ]{2,}|\t", " ")))
    return F.array_join(F.filter(trimmed, lambda line: line != ""), "\n")


def normalize_text(text: Column) -> Column:
    """Composed text with tidy white space; accents and case stay."""
    return tidy(nfkc(text))


# Section headers: a short line start that ends in a colon (fixed pattern).
HEADER = rf"(?imdU)^([{WORD}À-žΑ-ωА-я' -]{{2,40}}){SPACE}*:{SPACE}*"
# Sentence boundaries: space after closing punctuation, or line ends (fixed pattern).
BOUNDARY = rf"(?U)(?<=[.!?;:]){SPACE}+|\n+"


def sections(text: Column) -> Column:
    """Sections of a normalised text as an array of (name, text).

    Text without headers is one ``report`` section; text before the first header is ``preamble``.
    Names are lower case.
    """
    headers = F.regexp_extract_all(text, F.lit(HEADER), F.lit(1))
    bodies = F.split(text, HEADER, -1)
    named = F.transform(
        headers,
        lambda h, i: F.struct(
            strip(casefold_plain(h)).alias("name"), strip(F.get(bodies, i + 1)).alias("text")
        ),
    )
    opening = strip(F.get(bodies, F.lit(0)))
    preamble = F.when(
        opening != "", F.array(F.struct(F.lit("preamble").alias("name"), opening.alias("text")))
    ).otherwise(F.array().cast("array<struct<name:string,text:string>>"))
    whole = F.array(F.struct(F.lit("report").alias("name"), text.alias("text")))
    return (
        F.when(text == "", F.array().cast("array<struct<name:string,text:string>>"))
        .when(F.size(headers) == 0, whole)
        .otherwise(F.concat(preamble, named))
    )


def sentences(text: Column) -> Column:
    """Clause-sized pieces of a text, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, BOUNDARY, -1), strip), lambda s: s != "")


def section_sentences(parsed: Column) -> Column:
    """Sentences of all section bodies, in order."""
    return F.flatten(F.transform(parsed, lambda s: sentences(s["text"])))


# --- scripts and languages -----------------------------------------------------------------------

# Writing systems in order of precedence, as classes of letters. Letters whose names carry no
# writing system, such as ordinal signs, count as OTHER.
SCRIPTS = {
    "LATIN": r"\p{IsLatin}&&[\p{Lu}\p{Ll}\p{Lt}\p{Lo}]&&[^\u00aa\u00ba\u212a\u212b]",
    "CYRILLIC": r"\p{IsCyrillic}&&\p{L}",
    "GREEK": r"\p{IsGreek}&&\p{L}&&[^\u2126]",
    "ARABIC": r"[\p{IsArabic}\u0640]&&\p{L}",
    "THAI": r"\p{IsThai}&&\p{L}",
    "HEBREW": r"\p{IsHebrew}&&\p{L}",
    "HANGUL": r"\p{IsHangul}&&\p{L}",
    "HIRAGANA": r"[\p{IsHiragana}\u30fc\uff70]&&\p{L}",
    "KATAKANA": r"\p{IsKatakana}&&\p{L}",
    "CJK": r"\p{IsHan}&&\p{Lo}&&[^\u3006]",
}
# Languages implied by a writing system (fixed values).
SCRIPT_LANGUAGES = {
    "GREEK": "el",
    "ARABIC": "ar",
    "THAI": "th",
    "HEBREW": "he",
    "HANGUL": "ko",
    "HIRAGANA": "ja",
    "KATAKANA": "ja",
    "CJK": "zh",
}
# Marker words per language (fixed values).
LATIN_MARKERS = {
    "en": ("the", "and", "of", "no", "without", "findings", "impression", "knee", "joint"),
    "es": ("de", "la", "el", "sin", "hallazgos", "impresión", "rodilla", "articulación"),
    "fr": ("de", "la", "le", "sans", "conclusion", "genou", "articulation", "épanchement"),
    "de": ("der", "die", "das", "und", "kein", "keine", "beurteilung", "knie", "gelenk"),
    "it": ("di", "la", "il", "senza", "conclusioni", "ginocchio", "articolazione"),
    "nl": ("de", "het", "een", "en", "geen", "conclusie", "knie", "gewricht"),
    "tr": ("ve", "bir", "yok", "bulgular", "sonuç", "diz", "eklem"),
    "pt": ("de", "do", "da", "sem", "achados", "conclusão", "joelho", "articulação"),
    "hr": ("je", "bez", "nalaz", "zaključak", "koljeno", "zglob"),
    "ro": ("și", "de", "fără", "concluzii", "genunchi", "articulație"),
    "mt": ("tal", "għal", "mingħajr", "irkoppa", "ġog"),
}
CYRILLIC_MARKERS = {
    "bg": ("на", "и", "без", "заключение", "коляно", "става"),
    "mn": ("ба", "үгүй", "дүгнэлт", "өвдөг", "үе"),
}


def letters(text: Column) -> Column:
    """The letters of a text, in order."""
    return F.regexp_replace(text, r"[^\p{L}]+", "")


def ascii_letters(text: Column) -> Column:
    """Number of ASCII letters, all of which are Latin."""
    return F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))


def latin_letters(only_letters: Column) -> Column:
    """Number of Latin letters in a run of letters."""
    return F.length(F.regexp_replace(only_letters, f"[^[{SCRIPTS['LATIN']}]]+", ""))


def script_counts(only_letters: Column, total: Column, latin: Column) -> Column:
    """Letters per writing system as an array of (script, letters), largest first.

    Ties go to the script that is seen first. ``total`` and ``latin`` are the lengths of all and of
    the Latin letters; a text in Latin only is settled by them.
    """
    mixed = latin < total

    def entry(letters_of: Column, script: Column, first: Column) -> Column:
        return F.struct(
            (-letters_of).alias("order"), first.alias("first"), script.alias("script")
        )

    classes = F.array(
        *[F.struct(F.lit(s).alias("script"), F.lit(f"[{c}]").alias("letter")) for s, c in SCRIPTS.items()],
        F.struct(
            F.lit("OTHER").alias("script"),
            F.lit("[^" + "".join(f"[{c}]" for c in SCRIPTS.values()) + "]").alias("letter"),
        ),
    )
    counted = F.transform(
        classes,
        lambda c: entry(
            F.length(only_letters) - F.length(F.regexp_replace(only_letters, c["letter"], F.lit(""))),
            c["script"],
            F.regexp_instr(only_letters, c["letter"]),
        ),
    )
    only_latin = F.array(entry(total, F.lit("LATIN"), F.lit(1)))
    present = F.filter(F.when(mixed, counted).otherwise(only_latin), lambda e: e["order"] < 0)
    return F.transform(
        F.array_sort(present),
        lambda e: F.struct(e["script"].alias("script"), (-e["order"]).alias("letters")),
    )


def _marker_scores(tokens: Column, markers: dict[str, Sequence[str]]) -> Column:
    """Marker hits per language as (-hits, language), best first."""
    scores = [
        F.struct(
            (-F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))).alias("order"),
            F.lit(language).alias("language"),
        )
        for language, words in markers.items()
    ]
    return F.array_sort(F.array(*scores))


def marker_tokens(folded: Column) -> Column:
    """The distinct letter runs of a folded text that are marker words of some language."""
    words = sorted({w for t in (LATIN_MARKERS, CYRILLIC_MARKERS) for ws in t.values() for w in ws})
    runs = F.split(folded, r"[^a-z\p{L}\p{No}\p{Nl}]+", -1)
    return F.array_intersect(runs, F.array(*[F.lit(w) for w in words]))


def language_of(scripts: Column, total: Column, tokens: Column) -> Column:
    """Language, confidence, script, script share and marker hits, from the parts above."""
    top = F.get(scripts, F.lit(0))
    script = F.coalesce(top["script"], F.lit("EMPTY"))
    share = F.when(total > 0, top["letters"] / total).otherwise(0.0)
    direct = F.lit(None).cast("string")
    for name, language in SCRIPT_LANGUAGES.items():
        direct = F.when(script == name, language).otherwise(direct)
    # Only the marker table of the dominant script is evaluated.
    ranked = F.when(script == "LATIN", _marker_scores(tokens, LATIN_MARKERS)).when(
        script == "CYRILLIC", _marker_scores(tokens, CYRILLIC_MARKERS)
    )
    hits = F.coalesce(-F.get(ranked, F.lit(0))["order"], F.lit(0))
    margin = hits - F.coalesce(-F.get(ranked, F.lit(1))["order"], F.lit(0))
    settled = (hits >= 2) & (margin > 0)
    return F.struct(
        F.when(direct.isNotNull(), direct)
        .when(settled, F.get(ranked, F.lit(0))["language"])
        .otherwise("unknown")
        .alias("language"),
        F.when(direct.isNotNull(), F.least(F.lit(1.0), share))
        .when(settled, F.least(F.lit(0.99), F.lit(0.45) + 0.08 * hits + 0.07 * margin) * share)
        .otherwise(0.0)
        .alias("confidence"),
        script.alias("script"),
        share.alias("script_fraction"),
        F.when(direct.isNotNull(), 0).otherwise(hits).alias("marker_hits"),
    )
