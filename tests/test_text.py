"""Text expressions against Python's own regular expressions and Unicode data."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cohort_spark.core import ContractError
from cohort_spark.functions import lexicon as Y
from cohort_spark.functions import text as X
from cohort_spark.operators import labels as L

SAMPLES = [
    "Findings: ACL rupture is present. No fracture.\r\n\r\n  Impression :\tnormal; stable ",
    "Ein großer Erguß. ΣΟΦΟΣ ΟΔΌΣ: ΡΉΞΗ του χιαστού! İstanbul ŞİŞ",
    "ligne une\x0bligne deux ligne trois\x85 fin… ﬁbre ² ½ ª",
    "",
    "   \n \t \n",
    "a: b\nlong header that is far too long to be taken as one because it never ends: x",
    " nbsp inside　wide ΐ ᾳ Ǆ Straße\nBEFUND - Knie: ok\nno header here",
    "étude décomposée: résultat; Å",
    "preamble text. Second\nHeader' One:one\nHEADER TWO: two: three",
    "\x1fedge\x1e sep \x1d",
    "日本語のテスト ひらがな カタカナ 한국어",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, text string")


def python_normal(text):
    t = unicodedata.normalize("NFKC", text).replace("\x00", " ")
    t = "\n".join(re.sub(r"[\t\v\f\r ]+", " ", line).strip() for line in t.splitlines())
    return re.sub(r"\n{2,}", "\n", t).strip()


def python_sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?;:])\s+|\n+", text) if s.strip()]


def python_sections(text):
    pattern = re.compile(r"(?im)^([\wÀ-žΑ-ωА-я' -]{2,40})\s*:\s*")
    found = list(pattern.finditer(text))
    if not found:
        return [("report", text)] if text else []
    head = text[: found[0].start()].strip()
    out = [("preamble", head)] if head else []
    for m, following in zip(found, [*found[1:], None]):
        out.append((m.group(1).casefold().strip(), text[m.end() : following.start() if following else len(text)].strip()))
    return out


def test_parsing_agrees_with_python(texts):
    for r in L.parse_reports(texts, "text").collect():
        normal = python_normal(SAMPLES[r.i])
        assert r.normalized_text == normal, r.i
        sections = python_sections(normal)
        assert [(s.name, s.text) for s in r.sections] == sections, r.i
        assert r.sentences == [s for _, body in sections for s in python_sentences(body)], r.i


def test_case_folding_agrees_with_python(spark, texts):
    composed = L.composed(texts, "text", "n").select("i", X.casefold(F.col("n")).alias("f"))
    for r in composed.collect():
        assert r.f == unicodedata.normalize("NFKC", SAMPLES[r.i]).casefold(), r.i


def test_plain_characters_need_no_python(spark):
    wide = "".join(chr(c) for c in range(1, 0x3000) if re.match(f"[{X.PLAIN}]", chr(c)))
    assert len(wide) > 400
    assert unicodedata.normalize("NFKC", wide) == wide
    row = spark.createDataFrame([(c,) for c in wide], "c string").select(
        "c", X.is_plain(F.col("c")).alias("p"), X.casefold_plain(F.col("c")).alias("f")
    )
    for r in row.collect():
        assert r.p and r.f == r.c.casefold(), hex(ord(r.c))


def test_languages(spark):
    rows = [
        ("en", "The ACL is intact and the joint is normal without effusion."),
        ("es", "La rodilla sin derrame. Hallazgos de la articulación."),
        ("el", "Δεν υπάρχει ρήξη του πρόσθιου χιαστού"),
        ("unknown", "ACL MCL MRI"),
        ("bg", "ставата на коляно и без излив"),
        ("ko", "무릎 관절"),
        ("unknown", "1234 !!"),
    ]
    got = L.with_language(spark.createDataFrame(rows, "want string, text string"), "text").collect()
    for r in got:
        assert r.detected.language == r.want, r
    by_text = {r.text: r.detected for r in got}
    assert by_text["ACL MCL MRI"].marker_hits == 0
    assert by_text["1234 !!"].script == "EMPTY"


def labels_of(spark, text, targets=("ACL", "Effusion", "Fracture"), lexicon=Y.KNEE):
    df = spark.createDataFrame([("s", text)], "StudyInstanceUID string, Report string")
    return {r.target: r for r in L.label_corpus(df, lexicon=lexicon, targets=list(targets)).collect()}


def test_weak_labels(spark):
    got = labels_of(spark, "ACL rupture is present. No fracture. Moderate joint effusion.")
    assert [got[t].weak_label for t in ("ACL", "Fracture", "Effusion")] == [1, 0, 1]
    assert got["Effusion"].evidence == ["Moderate joint effusion."]
    assert got["ACL"].weak_probability == 0.95 and got["ACL"].weak_confidence == 0.9
    assert labels_of(spark, "The ACL is intact and the knee is normal.")["ACL"].weak_label == 0
    maybe = labels_of(spark, "Possible fracture of the knee and the joint.")["Fracture"]
    assert (maybe.weak_status, maybe.weak_label) == ("uncertain", None)
    spanish = labels_of(spark, "Rodilla sin fractura. La articulación sin derrame.")
    assert spanish["Fracture"].weak_label == 0
    assert labels_of(spark, "The ACL was seen.")["ACL"].weak_status == "mentioned_without_status"
    assert labels_of(spark, "Nothing to add.")["ACL"].weak_status == "not_mentioned"
    with pytest.raises(KeyError):
        labels_of(spark, "x", targets=["Unknown"])


def test_terms_match_whole_words_and_long_contexts(spark):
    long = "no " + "x" * 200 + " fracture"
    assert labels_of(spark, long)["Fracture"].weak_label == 1
    near = "no " + "x" * 60 + " fracture"
    assert labels_of(spark, near)["Fracture"].weak_label == 0
    assert labels_of(spark, "fractures microfracture _fracture")["Fracture"].weak_status == "not_mentioned"
    after = "The knee and the fracture, fracture intact"
    assert labels_of(spark, after)["Fracture"].weak_label == 0


def test_folding_markers_is_an_option(spark):
    greek = "Χωρίς κάταγμα."
    assert labels_of(spark, greek)["Fracture"].weak_label == 1
    folded = Y.Lexicon(Y.TERMS, frozenset(Y.NEEDS_MARKER), Y.PATHOLOGY, Y.NEGATION, Y.UNCERTAINTY, fold_markers=True)
    assert labels_of(spark, greek, lexicon=folded)["Fracture"].weak_label == 0


def test_lexicon_tables(spark, monkeypatch):
    terms = spark.createDataFrame([("t", "word", True)], "target string, term string, needs_marker boolean")
    markers = spark.createDataFrame([("en", "negation", "no "), ("unknown", "pathology", "torn")], "language string, kind string, marker string")
    made = Y.lexicon_from_tables(terms, markers)
    assert made.targets == ["t"] and set(made.markers("pathology")["unknown"]) == {"torn"}
    monkeypatch.setattr(Y, "MAX_ENTRIES", 1)
    with pytest.raises(ContractError):
        Y.lexicon_from_tables(terms.union(terms), markers)


def test_default_terms():
    assert len(Y.TERMS) == 12
    assert set(Y.NEEDS_MARKER) <= set(Y.TERMS)


def test_a_later_filter_does_not_unfold_the_text_plan(spark, texts):
    df = texts.withColumnsRenamed({"i": "StudyInstanceUID", "text": "Report"})
    plan = L.label_corpus(df).where("language = 'en' AND weak_status = 'positive'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "CartesianProduct" not in text and "Exchange" not in text
