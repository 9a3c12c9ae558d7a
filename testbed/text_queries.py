"""Normalisation, sections, sentences, scripts, languages, lexicon evidence, weak labels, corpus audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark.functions import text as X
from cohort_spark.functions.lexicon import KNEE, Lexicon
from cohort_spark.operators import cohort as C
from cohort_spark.operators import labels as L
from cohort_spark.sources.tables import spread
from testbed.registry import query
from testbed.views import load as load_view
from testbed.views import with_views

def load(spark, sf_dir, name):
    """A view; documents come in one row group, so text work is dealt out to all cores."""
    df = load_view(spark, sf_dir, name)
    return spread(df) if name in {"documents", "reports", "knee_reports"} else df


# The tables hold invented prose without clinical words, so the lexicon uses words that occur.
LEXICON = Lexicon(
    terms={
        "article": ("the", "la", "der", "le"),
        "relation": ("of", "de", "und"),
        "phrase": ("in the", "it is", "is the", "on"),
    },
    needs_marker=frozenset({"relation"}),
    pathology={"en": ("tion", "ing "), "unknown": ("que",)},
    negation={"en": ("that ", "normal"), "es": ("es ",), "unknown": ("sin ",)},
    uncertainty={"en": ("was",), "fr": ("eau",), "unknown": ("this",)},
)

# The whole tables hold no character that NFKC changes, so the SQL side needs no composition.
def tidy_sql(text: str) -> str:
    return rf"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '\x00', ' ', 'g'),
  '\r\n|[\n\r\x0b\f\x1c-\x1e]', chr(10), 'g'), '[\t ]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


def sentences_sql(text: str) -> str:
    return rf"""
list_filter(list_transform(string_split_regex(regexp_replace({text}, '([.!?;:])\s+', '\1' || chr(10), 'g'), '\n+'),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


HEADER_SQL = r"(?im)^([\pL\pN_À-žΑ-ωА-я'' -]{2,40})\s*:\s*"


def parsed_sql(source: str) -> str:
    """CTEs that end in ``se`` with the sections and sentences of every row of ``source``."""
    return rf"""
nt AS (SELECT *, {tidy_sql("text")} AS norm FROM {source}),
hd AS (SELECT *, regexp_extract_all(norm, '{HEADER_SQL}', 1) AS heads, string_split_regex(norm, '{HEADER_SQL}') AS bodies FROM nt),
sc AS (SELECT *, CASE WHEN norm = '' THEN [] WHEN len(heads) = 0 THEN [struct_pack(name := 'report', text := norm)]
   ELSE list_concat(CASE WHEN trim(bodies[1]) <> '' THEN [struct_pack(name := 'preamble', text := trim(bodies[1]))] ELSE [] END,
        list_transform(heads, lambda h, i: struct_pack(name := trim(lower(h)), text := regexp_replace(bodies[i + 1], '^\s+|\s+$', '', 'g')))) END AS secs FROM hd),
se AS (SELECT *, flatten(list_transform(secs, lambda x: {sentences_sql("x.text")})) AS sents FROM sc)
""".strip()


@query(f"SELECT doc_id, md5({tidy_sql('text')}) AS digest, length({tidy_sql('text')}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query(
    with_views(
        "reports",
        "WITH " + parsed_sql("reports")
        + """ SELECT doc_id, CAST(i AS INT) AS place, secs[i + 1].name AS name, md5(secs[i + 1].text) AS digest
        FROM (SELECT doc_id, secs, unnest(range(len(secs))) AS i FROM se)""",
    )
)
def sections(spark, sf_dir):
    parsed = L.parse_reports(load(spark, sf_dir, "reports"), "text")
    return parsed.select("doc_id", F.posexplode("sections").alias("place", "s")).select(
        "doc_id", "place", "s.name", F.md5("s.text").alias("digest")
    )


@query(
    with_views(
        "reports",
        "WITH " + parsed_sql("reports")
        + " SELECT doc_id, len(sents) AS n, md5(array_to_string(sents, '|')) AS digest FROM se",
    )
)
def sentences(spark, sf_dir):
    parsed = L.parse_reports(load(spark, sf_dir, "reports"), "text")
    return parsed.select(
        "doc_id",
        F.size("sentences").cast("bigint").alias("n"),
        F.md5(F.array_join("sentences", "|")).alias("digest"),
    )


@query(
    r"""SELECT doc_id, 'LATIN' AS script, length(regexp_replace(text, '[^\p{Latin}]+', '', 'g')) AS letters
    FROM documents WHERE regexp_matches(text, '\p{Latin}')
    UNION ALL SELECT doc_id, 'OTHER', length(regexp_replace(text, '[^\pL]+|\p{Latin}', '', 'g')) FROM documents
    WHERE length(regexp_replace(text, '[^\pL]+|\p{Latin}', '', 'g')) > 0"""
)
def script_profile(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return L.script_profile(docs, "text", ["doc_id"]).withColumn("letters", F.col("letters").cast("bigint"))


def _values(markers):
    return ", ".join(
        "('{}', [{}])".format(k, ", ".join(f"'{w}'" for w in v)) for k, v in markers.items()
    )


def language_sql(source: str, text: str, key: str) -> str:
    """CTEs that end in ``lg(key, language, confidence, script, script_fraction, marker_hits)``."""
    return rf"""
mk(language, words) AS (VALUES {_values(X.LATIN_MARKERS)}),
tk AS (SELECT {key} AS k, list_distinct(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\pL\p{{No}}\p{{Nl}}]+')) AS toks,
   length(regexp_replace({text}, '[^\pL]+', '', 'g')) AS total, length(regexp_replace({text}, '[^\p{{Latin}}]+', '', 'g')) AS latin FROM {source}),
hs AS (SELECT k, total, latin, language, len(list_intersect(toks, words)) AS hits FROM tk, mk),
rr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hits DESC, language) AS rk,
   lead(hits) OVER (PARTITION BY k ORDER BY hits DESC, language) AS second FROM hs),
lg AS (SELECT k, CASE WHEN total > 0 AND hits >= 2 AND hits > second THEN language ELSE 'unknown' END AS language,
   CASE WHEN total > 0 AND hits >= 2 AND hits > second THEN least(0.99, 0.45 + 0.08 * hits + 0.07 * (hits - second)) * latin / total ELSE 0 END AS confidence,
   CASE WHEN total = 0 THEN 'EMPTY' ELSE 'LATIN' END AS script, CASE WHEN total = 0 THEN 0 ELSE latin / total END AS script_fraction,
   CASE WHEN total = 0 THEN 0 ELSE hits END AS marker_hits FROM rr WHERE rk = 1)
"""


@query(
    "WITH " + language_sql("documents", "text", "doc_id").strip()
    + """ SELECT k AS doc_id, language, round(confidence, 6) AS confidence, script,
    round(script_fraction, 6) AS script_fraction, CAST(marker_hits AS BIGINT) AS marker_hits FROM lg"""
)
def detect_language(spark, sf_dir):
    detected = L.with_language(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return detected.select("doc_id", "detected.*").withColumns(
        {
            "confidence": F.round("confidence", 6),
            "script_fraction": F.round("script_fraction", 6),
            "marker_hits": F.col("marker_hits").cast("bigint"),
        }
    )


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _cases(lexicon, kind):
    table = lexicon.markers(kind)
    words = lambda v: "[" + ", ".join(map(quoted, v)) + "]"
    arms = " ".join(f"WHEN '{k}' THEN {words(v)}" for k, v in table.items() if k != "unknown")
    return f"CASE language {arms} ELSE {words(table['unknown'])} END"


def evidence_sql(lexicon, source):
    terms = ", ".join(
        f"({quoted(target)}, {quoted(term.casefold())}, {str(target in lexicon.needs_marker).lower()})"
        for target, terms in lexicon.terms.items()
        for term in terms
    )
    cases = {k: _cases(lexicon, k) for k in ("negation", "uncertainty", "pathology")}
    return parsed_sql(source) + "," + language_sql("nt", "norm", "doc_id") + rf""",
ml AS (SELECT k, language, confidence, script, {cases["negation"]} AS neg, {cases["uncertainty"]} AS unc, {cases["pathology"]} AS pat FROM lg),
st AS (SELECT doc_id, i AS position, sents[i + 1] AS sentence, replace(replace(lower(sents[i + 1]), 'ß', 'ss'), 'ς', 'σ') AS folded
   FROM (SELECT doc_id, sents, unnest(range(len(sents))) AS i FROM se)),
tm(target, term, needs_marker) AS (VALUES {terms}),
oc AS (SELECT doc_id, position, sentence, folded, target, term, needs_marker, string_split(folded, term) AS pieces
   FROM st JOIN tm ON contains(folded, term)),
mt AS (SELECT *, unnest(range(1, len(pieces))) AS j FROM oc),
wd AS (SELECT * FROM mt WHERE (CASE WHEN pieces[j] = '' THEN j = 1 ELSE NOT regexp_matches(right(pieces[j], 1), '[\pL\pN_]') END)
   AND (CASE WHEN pieces[j + 1] = '' THEN j + 1 = len(pieces) ELSE NOT regexp_matches(left(pieces[j + 1], 1), '[\pL\pN_]') END)),
sp AS (SELECT *, CAST(list_sum(list_transform(pieces[1:j], lambda p: length(p))) AS BIGINT) + (j - 1) * length(term) AS start FROM wd),
cx AS (SELECT *, right(left(folded, start), 100) AS bef, substr(folded, start + length(term) + 1, 60) AS aft FROM sp),
ev AS (SELECT doc_id, target, term, position, sentence, CASE
   WHEN len(list_filter(neg, lambda m: contains(bef, m))) > 0
     OR len(list_filter(neg, lambda m: trim(m) IN ('intact', 'normal') AND contains(aft, trim(m)))) > 0 THEN 'negative'
   WHEN len(list_filter(unc, lambda m: contains(folded, m))) > 0 THEN 'uncertain'
   WHEN needs_marker AND len(list_filter(pat, lambda m: contains(folded, m))) = 0 THEN 'mention' ELSE 'positive' END AS status
   FROM cx JOIN ml ON doc_id = k)
"""


EVIDENCE_SQL = evidence_sql(LEXICON, "documents")


def matched(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    detected = L.with_language(L.parse_reports(docs, "text"), "normalized_text", is_composed=True)
    return L.with_matches(
        detected,
        LEXICON,
        sentences="sentences",
        language=F.col("detected.language"),
        text="normalized_text",
    )


@query(
    "WITH " + EVIDENCE_SQL.strip()
    + " SELECT doc_id, target, term, CAST(position AS INT) AS position, status, count(*) AS n FROM ev GROUP BY ALL"
)
def lexicon_matches(spark, sf_dir):
    found = L.lexicon_matches(matched(spark, sf_dir), ["doc_id"])
    return found.groupBy("doc_id", "target", "term", "position", "status").agg(F.count("*").alias("n"))


def labels_sql(lexicon, source):
    named = ", ".join(f"({quoted(t)})" for t in lexicon.targets)
    return evidence_sql(lexicon, source) + f""",
tg(target) AS (VALUES {named}),
fl AS (SELECT doc_id, target, bool_or(status = 'positive') AS p, bool_or(status = 'uncertain') AS u, bool_or(status = 'negative') AS n FROM ev GROUP BY 1, 2),
vd AS (SELECT d.doc_id, tg.target, CASE WHEN p THEN 'positive' WHEN u THEN 'uncertain' WHEN n THEN 'negative'
   WHEN p IS NOT NULL THEN 'mentioned_without_status' ELSE 'not_mentioned' END AS weak_status
   FROM {source} d CROSS JOIN tg LEFT JOIN fl ON d.doc_id = fl.doc_id AND tg.target = fl.target),
ef AS (SELECT v.doc_id, v.target, e.sentence, min(position) AS position FROM vd v JOIN ev e ON v.doc_id = e.doc_id AND v.target = e.target
   WHERE e.status = v.weak_status OR v.weak_status = 'mentioned_without_status' GROUP BY 1, 2, 3),
eg AS (SELECT doc_id, target, md5(string_agg(sentence, '|' ORDER BY position)) AS evidence FROM ef GROUP BY 1, 2),
wl AS (SELECT v.doc_id, v.target, weak_status, language,
   CASE weak_status WHEN 'positive' THEN 0.95 WHEN 'negative' THEN 0.05 ELSE 0.5 END::DOUBLE AS weak_probability,
   CASE weak_status WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS weak_label,
   CASE weak_status WHEN 'positive' THEN 0.9 WHEN 'uncertain' THEN 0.25 WHEN 'negative' THEN 0.85 WHEN 'mentioned_without_status' THEN 0.15 ELSE 0 END::DOUBLE AS weak_confidence,
   coalesce(evidence, md5('')) AS evidence
   FROM vd v JOIN lg ON v.doc_id = k LEFT JOIN eg ON v.doc_id = eg.doc_id AND v.target = eg.target)
"""


LABELS_SQL = labels_sql(LEXICON, "documents")


@query(
    "WITH " + LABELS_SQL.strip()
    + " SELECT doc_id, target, language, weak_status, weak_probability, weak_label, weak_confidence, evidence FROM wl"
)
def weak_labels(spark, sf_dir):
    labels = L.label_corpus(
        load(spark, sf_dir, "documents"), text="text", keep=["doc_id"], lexicon=LEXICON
    )
    return labels.select(
        "doc_id",
        "target",
        "language",
        "weak_status",
        "weak_probability",
        "weak_label",
        "weak_confidence",
        F.md5(F.array_join("evidence", "|")).alias("evidence"),
    )


@query(
    with_views(
        "knee_reports",
        "WITH " + labels_sql(KNEE, "knee_reports").strip()
        + " SELECT doc_id, target, language, weak_status, weak_probability, weak_label, weak_confidence, evidence FROM wl",
    )
)
def default_labels(spark, sf_dir):
    """The whole default lexicon, twelve targets, over texts with one of its terms each."""
    labels = L.label_corpus(load(spark, sf_dir, "knee_reports"), text="text", keep=["doc_id"])
    columns = ["doc_id", "target", "language", "weak_status", "weak_probability", "weak_label", "weak_confidence"]
    return labels.select(*columns, F.md5(F.array_join("evidence", "|")).alias("evidence"))


def labelled(spark, sf_dir):
    """Weak labels with gold: ``quality`` is the gold of ``article``, ``toxic`` of ``relation``."""
    weak = L.label_corpus(
        load(spark, sf_dir, "documents"), text="text", keep=["doc_id"], lexicon=LEXICON
    )
    gold = load(spark, sf_dir, "labels")
    known = F.when(F.col("target") == "article", F.col("quality")).when(
        F.col("target") == "relation", F.col("toxic")
    )
    return weak.join(gold, "doc_id", "left").withColumn("gold", known.cast("double"))


GOLD_SQL = LABELS_SQL + """,
gl AS (SELECT wl.*, CASE target WHEN 'article' THEN quality WHEN 'relation' THEN toxic END AS gold
   FROM wl LEFT JOIN labels l ON wl.doc_id = l.doc_id)
"""


@query(
    "WITH " + GOLD_SQL.strip()
    + """ SELECT doc_id, target, round(coalesce(gold, weak_probability), 6) AS probability, coalesce(gold, weak_label) AS label,
    CASE WHEN gold IS NOT NULL THEN 1.0 ELSE weak_confidence END::DOUBLE AS confidence,
    CASE WHEN gold IS NOT NULL THEN 'gold' ELSE 'rules_v1' END AS source FROM gl"""
)
def gold_override(spark, sf_dir):
    return C.gold_override(labelled(spark, sf_dir)).select(
        "doc_id", "target", F.round("probability", 6).alias("probability"), "label", "confidence", "source"
    )


@query(
    "WITH " + GOLD_SQL.strip() + """,
    cn AS (SELECT target, CASE WHEN gold IS NOT NULL THEN weak_probability END AS score, sum(CASE WHEN gold = 1 THEN 1 ELSE 0 END) AS p,
       sum(CASE WHEN gold = 0 THEN 1 ELSE 0 END) AS n FROM gl GROUP BY ALL),
    rn AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY target ORDER BY score NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cn),
    au AS (SELECT target AS t, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (below + n / 2.0))::DOUBLE / (sum(p) * sum(n))::DOUBLE END AS auc FROM rn GROUP BY 1)
    SELECT target, count(gold) AS gold_known, count(weak_label) AS weak_determinate, round(count(weak_label) / count(*), 6) AS weak_coverage,
    round(avg(CASE WHEN gold IS NOT NULL AND weak_label IS NOT NULL THEN CASE WHEN gold = weak_label THEN 1.0 ELSE 0.0 END END), 6) AS gold_determinate_accuracy,
    round(max(auc), 6) AS gold_auc FROM gl JOIN au ON target = t GROUP BY 1"""
)
def weak_label_audit(spark, sf_dir):
    audit = L.weak_label_audit(labelled(spark, sf_dir))
    return audit.withColumns(
        {c: F.round(c, 6) for c in ("weak_coverage", "gold_determinate_accuracy", "gold_auc")}
    )


@query("WITH " + LABELS_SQL.strip() + " SELECT target, weak_status, count(*) AS n FROM wl GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    labels = L.label_corpus(
        load(spark, sf_dir, "documents"), text="text", keep=["doc_id"], lexicon=LEXICON
    )
    return L.status_counts(labels)


@query(
    "WITH " + language_sql("documents", "text", "doc_id").strip()
    + " SELECT language, script, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM lg GROUP BY 1, 2"
)
def corpus_audit(spark, sf_dir):
    audit = L.corpus_languages(load(spark, sf_dir, "documents"), "text")
    return audit.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "SELECT count(*) AS n, " + ", ".join(
        f"round(quantile_cont(length(text), {p}), 6) AS {n}" for n, p in L.LENGTH_QUANTILES.items()
    ) + " FROM documents"
)
def length_quantiles(spark, sf_dir):
    quantiles = L.length_quantiles(load(spark, sf_dir, "documents"), "text")
    return quantiles.withColumns({c: F.round(c, 6) for c in L.LENGTH_QUANTILES})


@query(
    f"""WITH t AS (SELECT replace(lower({tidy_sql("text")}), 'ß', 'ss') AS folded FROM documents)
    SELECT sha256(folded) AS digest, count(*) AS n FROM t WHERE folded <> '' GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_texts(spark, sf_dir):
    return L.duplicate_texts(load(spark, sf_dir, "documents"), "text")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def fingerprint(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
