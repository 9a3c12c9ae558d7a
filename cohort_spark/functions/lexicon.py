"""Target terms and context markers as data, with the ones of the knee-report domain as default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cohort_spark.core import ContractError, require_columns

MAX_ENTRIES = 20_000

# --- Fixed values: markers by language -----------------------------------------------------------

PATHOLOGY = {
    "en": ("tear", "torn", "rupture", "sprain", "injury", "degeneration", "abnormal"),
    "es": ("rotura", "ruptura", "desgarro", "lesión", "esguince", "degeneración"),
    "fr": ("rupture", "lésion", "entorse", "dégénérescence", "anormal"),
    "de": ("riss", "ruptur", "läsion", "zerrung", "degeneration", "pathologisch"),
    "nl": ("scheur", "ruptuur", "letsel", "verrekking", "degeneratie"),
    "tr": ("yırtık", "yirtik", "rüptür", "ruptur", "yaralanma", "dejenerasyon"),
    "bg": ("разкъсване", "руптура", "увреда", "дегенерация"),
    "el": ("ρήξη", "κακωση", "κάκωση", "εκφύλιση"),
    "hr": ("ruptura", "lezija", "oštećenje", "ostecenje", "degeneracija"),
    "unknown": ("tear", "rupture", "ruptura", "riss", "lésion", "lezija"),
}
NEGATION = {
    "en": ("no ", "not ", "without ", "absence of ", "negative for ", "intact", "normal"),
    "es": ("no ", "sin ", "ausencia de ", "íntegro", "integro", "normal"),
    "fr": ("pas de ", "sans ", "absence de ", "intact", "normal"),
    "de": ("kein ", "keine ", "keinen ", "ohne ", "intakt", "unauffällig"),
    "nl": ("geen ", "zonder ", "intact", "normaal"),
    "tr": ("yok", "izlenmedi", "saptanmadı", "saptanmadi", "intakt", "normal"),
    "bg": ("няма", "без ", "не се установява", "интакт", "нормал"),
    "el": ("χωρίς", "δεν ", "απουσία", "ακέραι", "φυσιολογ"),
    "hr": ("nema", "bez ", "nije", "uredan", "intaktan", "normalan"),
    "unknown": ("no ", "sin ", "sans ", "kein ", "geen ", "yok", "bez ", "χωρίς"),
}
UNCERTAINTY = {
    "en": ("possible", "possibly", "probable", "suspicious", "cannot exclude", "may represent"),
    "es": ("posible", "probable", "sugestivo", "no se descarta", "podría"),
    "fr": ("possible", "probable", "suspect", "ne peut exclure", "pourrait"),
    "de": ("möglich", "wahrscheinlich", "verdacht", "nicht auszuschließen"),
    "nl": ("mogelijk", "waarschijnlijk", "verdacht", "niet uit te sluiten"),
    "tr": ("olası", "olasi", "muhtemel", "şüpheli", "dışlanamaz"),
    "bg": ("възмож", "вероят", "съмнение", "не може да се изключи"),
    "el": ("πιθαν", "ύποπτ", "δεν μπορεί να αποκλειστεί"),
    "hr": ("moguć", "vjerojat", "suspekt", "ne može se isključiti"),
    "unknown": ("possible", "probable", "suspicious", "verdacht", "posible"),
}

# --- Fixed values: terms by target ---------------------------------------------------------------

TERMS = {
    "ACL": (
        "acl", "anterior cruciate ligament", "ligamento cruzado anterior", "lca",
        "ligament croisé antérieur", "vorderes kreuzband", "vkb", "voorste kruisband",
        "ön çapraz bağ", "öçb", "предна кръстна връзка", "пкс", "πρόσθιος χιαστός", "πχσ",
        "prednji križni ligament", "prednji ukriženi ligament",
    ),
    "MCL": (
        "mcl", "medial collateral ligament", "ligamento colateral medial", "lcm",
        "ligament collatéral médial", "mediales kollateralband", "innenband",
        "mediale collaterale band", "medial kollateral bağ", "iç yan bağ",
        "медиална колатерална връзка", "έσω πλάγιος σύνδεσμος", "medijalni kolateralni ligament",
    ),
    "Medial Meniscus": (
        "medial meniscus", "menisco medial", "ménisque médial", "innenmeniskus",
        "mediale meniscus", "medial menisküs", "медиален менискус", "έσω μηνίσκος",
        "medijalni menisk",
    ),
    "Lateral Meniscus": (
        "lateral meniscus", "menisco lateral", "ménisque latéral", "außenmeniskus",
        "laterale meniscus", "lateral menisküs", "латерален менискус", "έξω μηνίσκος",
        "lateralni menisk",
    ),
    "Medial OA": (
        "medial compartment osteoarthritis", "medial compartment arthrosis",
        "medial compartment chondrosis", "medial gonarthrosis",
        "medial tibiofemoral osteoarthritis", "artrosis femorotibial medial",
        "arthrose fémoro-tibiale médiale", "mediale gonarthrose",
        "mediale compartimentsartrose", "medial kompartman osteoartrit",
        "медиална гонартроза", "οστεοαρθρίτιδα έσω διαμερίσματος", "medijalna gonartroza",
    ),
    "Lateral OA": (
        "lateral compartment osteoarthritis", "lateral compartment arthrosis",
        "lateral compartment chondrosis", "lateral gonarthrosis",
        "lateral tibiofemoral osteoarthritis", "artrosis femorotibial lateral",
        "arthrose fémoro-tibiale latérale", "laterale gonarthrose",
        "laterale compartimentsartrose", "lateral kompartman osteoartrit",
        "латерална гонартроза", "οστεοαρθρίτιδα έξω διαμερίσματος", "lateralna gonartroza",
    ),
    "PF OA": (
        "patellofemoral osteoarthritis", "patellofemoral arthrosis", "patellofemoral chondrosis",
        "retropatellar chondrosis", "artrosis femoropatelar", "arthrose fémoro-patellaire",
        "retropatellararthrose", "patellofemorale artrose", "patellofemoral osteoartrit",
        "пателофеморална артроза", "επιγονατιδομηριαία οστεοαρθρίτιδα",
        "patelofemoralna artroza",
    ),
    "Effusion": (
        "joint effusion", "knee effusion", "effusion", "derrame articular", "derrame",
        "épanchement articulaire", "épanchement", "gelenkerguss", "erguss",
        "gewrichtseffusie", "eklem efüzyonu", "efüzyon", "ставен излив", "αρθρική συλλογή",
        "izljev u zglobu",
    ),
    "Synovitis": (
        "synovitis", "sinovitis", "synovite", "synovialitis", "synoviitis", "sinovit",
        "синовит", "υμενίτιδα",
    ),
    "Baker's": (
        "baker cyst", "baker's cyst", "popliteal cyst", "quiste de baker", "kyste de baker",
        "baker-zyste", "bakerse cyste", "baker kisti", "киста на бейкър", "κύστη baker",
        "bakerova cista",
    ),
    "Contusion": (
        "bone contusion", "bone bruise", "osseous contusion", "contusión ósea",
        "contusion osseuse", "knochenkontusion", "botcontusie", "kemik kontüzyonu",
        "костна контузия", "οστική θλάση", "koštana kontuzija",
    ),
    "Fracture": (
        "fracture", "fractura", "fraktur", "fractuur", "kırık", "kirik", "фрактура",
        "счупване", "κάταγμα", "prijelom",
    ),
}
# Targets whose terms count only next to a pathology marker.
NEEDS_MARKER = ("ACL", "MCL", "Medial Meniscus", "Lateral Meniscus")


@dataclass(frozen=True)
class Lexicon:
    """Terms per target and markers per language; ``unknown`` markers apply to every language."""

    terms: Mapping[str, Sequence[str]]
    needs_marker: frozenset[str] = frozenset()
    pathology: Mapping[str, Sequence[str]] = field(default_factory=dict)
    negation: Mapping[str, Sequence[str]] = field(default_factory=dict)
    uncertainty: Mapping[str, Sequence[str]] = field(default_factory=dict)
    # Markers are compared as written by default, although the text is folded; this folds them too.
    fold_markers: bool = False

    @property
    def targets(self) -> list[str]:
        return list(self.terms)

    def restricted(self, targets: Sequence[str]) -> Lexicon:
        """The same lexicon for some targets; an unknown target is an error."""
        unknown = [t for t in targets if t not in self.terms]
        if unknown:
            raise KeyError("no terminology for: " + ", ".join(unknown))
        return Lexicon(
            {t: self.terms[t] for t in targets},
            frozenset(t for t in self.needs_marker if t in targets),
            self.pathology,
            self.negation,
            self.uncertainty,
            self.fold_markers,
        )

    def markers(self, kind: str) -> dict[str, tuple[str, ...]]:
        """Markers of a kind per language, the general ones appended to each."""
        table: Mapping[str, Sequence[str]] = getattr(self, kind)
        general = tuple(table.get("unknown", ()))
        both = {language: (*words, *general) for language, words in table.items()}
        both.setdefault("unknown", general)
        if self.fold_markers:
            both = {k: tuple(m.casefold() for m in words) for k, words in both.items()}
        return both


KNEE = Lexicon(TERMS, frozenset(NEEDS_MARKER), PATHOLOGY, NEGATION, UNCERTAINTY)


def lexicon_from_tables(terms: DataFrame, markers: DataFrame, *, fold_markers: bool = False) -> Lexicon:
    """A lexicon from ``target, term, needs_marker`` and ``language, kind, marker`` tables.

    Lexicons are configuration; a table beyond MAX_ENTRIES rows is refused rather than collected.
    """
    require_columns(terms, ["target", "term", "needs_marker"])
    require_columns(markers, ["language", "kind", "marker"])
    term_rows = terms.orderBy("target", "term").limit(MAX_ENTRIES + 1).collect()
    marker_rows = markers.orderBy("kind", "language", "marker").limit(MAX_ENTRIES + 1).collect()
    if max(len(term_rows), len(marker_rows)) > MAX_ENTRIES:
        raise ContractError(f"a lexicon may hold at most {MAX_ENTRIES} entries")
    by_target: dict[str, list[str]] = {}
    for r in term_rows:
        by_target.setdefault(r.target, []).append(r.term)
    tables: dict[str, dict[str, list[str]]] = {"pathology": {}, "negation": {}, "uncertainty": {}}
    for r in marker_rows:
        tables[r.kind].setdefault(r.language, []).append(r.marker)
    needing = frozenset(r.target for r in term_rows if r.needs_marker)
    return Lexicon(by_target, needing, **tables, fold_markers=fold_markers)
