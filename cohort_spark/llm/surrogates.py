"""Surrogates for personal data: keyed, of the same type, gender, script and format.

Entities are e-mail addresses, telephone numbers, IP addresses of both versions, card, account (IBAN),
social security and passport numbers, dates of birth, street addresses, and names after a title, a
greeting, a word that introduces them or a known given name; once a name is found, its parts are
replaced wherever the document writes them with a capital. Card numbers have 16 digits, or another
length with a right check digit and issuer; account numbers have right check digits. Telephone numbers have a plus sign or 00, the 3-3-4 digits of
North America (written together, too), a leading 0 and groups, or a word like "call" before them. An
entity's normal form (lower case, digits only, country and national number, one
name part) and a secret key give its surrogate, so every mention gets the same one (coreference) in
the format in which it is written. A check over all entities of the corpus keeps surrogates apart
from each other and from real entities: who collides draws again, until nobody does. Only entities
that drew again have to be looked up when documents are rewritten.

Dates of birth move by one keyed number of days, so different ones stay different; they are no
identifiers and may meet another real date. A kind whose format has fewer than twice as many values as
entities is refused before any drawing.

Name parts are replaced one by one, so "Mr Smith" and "Anna Smith" keep a common family name; a given
name keeps its gender through its ending, a name its script.

Defined cases: a null text stays null, a text without entities stays as it is; repeated rows are
rewritten alike; overlapping finds go to the earlier, then to the longer one; an empty table gives an empty
one. Columns pass through under any name; the added one is ``_pii_kinds`` and replaces one of that name.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator, Mapping
from datetime import date, timedelta

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.core import ContractError, durable
from cohort_spark.llm import bytes as B

KINDS = ("email", "phone", "ip", "ipv6", "card", "iban", "ssn", "passport", "birth", "street", "given", "family")
# Entities that drew again and are broadcast; more are joined to the documents.
BROADCAST_REDRAWN = 100_000
# From this draw on a surrogate may use a wider format, so that small ranges do not run out.
WIDEN = 12

# Titles by gender, and what names are made of by script.
_MALE = ("Mr", "Sir", "Lord", "Herr", "Señor", "Sr", "Monsieur", "Signor", "господин", "κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mlle", "Signora", "госпожа", "κυρία")
_EITHER = ("Dr", "Doctor", "Dra", "Prof", "Professor", "Rev", "Reverend", "доктор", "профессор")
_GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "Hans", "Pierre", "Carlos", "Juan", "Иван", "Пётр", "Γιώργος"),
    "f": ("Mary", "Anna", "Maria", "Emma", "Julia", "Marie", "Sofia", "Carmen", "Ольга", "Мария", "Ελένη"),
}
_SOUNDS = {
    "latin": (("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v"), ("a", "e", "i", "o", "u"), {"m": "en", "f": "ia", "": "er"}),
    "cyrillic": (("б", "в", "г", "д", "к", "л", "м", "н", "п", "р", "с", "т"), ("а", "е", "и", "о", "у"), {"m": "ан", "f": "ия", "": "ов"}),
    "greek": (("β", "γ", "δ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ"), ("α", "ε", "ι", "ο"), {"m": "ος", "f": "ία", "": "ης"}),
}
_GENDER = {t.lower(): g for g, titles in (("m", _MALE), ("f", _FEMALE), ("", _EITHER)) for t in titles}
_KNOWN = {name.lower(): g for g, names in _GIVEN.items() for name in names}

_DOMAIN = regex.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_NUMBERS = regex.compile(
    r"(?=[\d+(])(?:(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<phone>(?<![\w+])(?:\+[ ]?[2-9]|00[2-9](?=\d{0,2}[ ./-]))(?:(?:[ ./-]|[ ]?\(|\)[ ./-]?)?\d){6,14}(?!\w)"
    r"|(?<![\w+])(?:(?:\+\d{1,3}|1)[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{7}(?!\w)"
    r"|(?<![\w+.,/=-])[2-9]\d{9}(?![\w/=-]|[.,]\d)"
    r"|(?<![\w+.,/-])\(?0[1-9]\d{0,3}\)?(?P<gap>[ ./-])\d{2,8}(?:[ .-]\d{2,4}){0,4}(?![\w:]|[.,/-]\d))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])))"
)
# A number of any grouping after a word that announces one.
_CUED = regex.compile(
    r"(?i:\b(?:tel|telephone|phone|call|fax|mobile|cell|telefon|tél|téléphone|teléfono|тел)(?:[ ](?:no|nr|number))?[.:]*[ ]{0,2})"
    r"(?P<n>\+?\(?\d(?:[ ./()-]{0,2}\d){6,14})(?![\w:]|[.,/-]\d)"
)
_DATE = regex.compile(r"\d{1,2}([./ -])\d{1,2}\1\d{4}|\d{4}([./ -])\d{1,2}\2\d{1,2}")
# Calling codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PART = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:['’]\p{L}[\p{L}\p{M}]+)?"
_NAME = rf"{_PART}(?:-{_PART})*+(?![\p{{L}}\p{{M}}\d_])"
_PARTICLES = r"(?:(?:\p{Lu}\.|(?i:de|del|della|di|da|dos|du|des|la|las|los|le|van|von|der|den|zu|ter|ten|bin|ibn|al|el|y|st\.?))[ ])*+"
_TITLES = "|".join(sorted({w for t in _GENDER for w in (t, t.upper(), t.capitalize())}, key=lambda w: (-len(w), w)))
_TITLED = regex.compile(rf"\b({_TITLES})\b\.?[ ](?:(?:{_TITLES})\b\.?[ ])*+{_PARTICLES}({_NAME})(?:[ ]{_PARTICLES}({_NAME}))?")
_NAMED = regex.compile(rf"(?<![\p{{L}}\p{{M}}])({_PART})(?=[ ]{_PARTICLES}({_NAME}))")
_PIECE = regex.compile(_PART)
_BARE = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d_]){_PART}(?![\p{{L}}\p{{M}}\d_])")

# Words before names, dates of birth and passport numbers, and words in street names.
_GREETINGS = (
    "dear", "hi", "hello", "hallo", "hey", "cher", "chère", "bonjour", "querido", "querida", "estimado", "estimada", "hola", "liebe", "lieber",
    "my name is", "name:", "named", "signed", "regards", "sincerely", "yours", "ich heiße", "je m'appelle", "me llamo", "меня зовут", "с уважением", "με λένε",
)
_BORN = ("born", "birth", "dob", "geboren", "geburtsdatum", "né le", "née le", "naissance", "nacido", "nacida", "nacimiento")
_STREETS = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|Terrace|Crescent|St|Ave|Rd|Ln|Blvd"
_GREETED = regex.compile(
    rf"(?<![\p{{L}}\p{{M}}])(?i:{'|'.join(map(regex.escape, _GREETINGS))})[,:]?[ \n]{{1,2}}(?:(?:{_TITLES})\b\.?[ ])?({_NAME})(?:[ ]{_PARTICLES}({_NAME}))?"
)
# More people after a greeted one: "and", commas.
_JOINED = regex.compile(rf"(?:,|[ ]and|[ ]und|[ ]et|[ ]y|[ ]и|[ ]και|,?[ ]meet)[ ]({_NAME})[ ]{_PARTICLES}({_NAME})")
_BIRTH = regex.compile(rf"(?i:{'|'.join(map(regex.escape, _BORN))})[^\d\n]{{0,16}}(?P<d>\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})(?!\d)")
_PASSPORT = regex.compile(r"(?i:passport|reisepass|passeport|pasaporte)[^\d\n]{0,12}?(?<![A-Za-z0-9])(?P<p>[A-Z]{0,2}\d{6,9})(?![A-Za-z0-9])")
_STREET = regex.compile(
    rf"(?<![\p{{L}}\d])(?P<n>\d{{1,5}})[ ](?P<s>\p{{Lu}}[\p{{L}}'’-]+(?:[ ]\p{{Lu}}[\p{{L}}'’-]+){{0,2}}?)[ ](?:{_STREETS})\b"
    r"|(?<![\p{L}])(?P<s>\p{Lu}\p{L}{2,}?)(?:straße|strasse|gasse|weg|platz|allee)[ ](?P<n>\d{1,4})(?!\d)"
    r"|(?<![\p{L}\d])(?P<n>\d{1,4}),?[ ](?:rue|avenue|boulevard|place|chemin)[ ](?:(?:de|du|des|la|le|les)[ ]|l['’]|d['’])*(?P<s>\p{Lu}[\p{L}-]+)"
    r"|(?<![\p{L}])(?i:calle|avenida|plaza|paseo)[ ](?:(?:de|del|la|las|los|el)[ ])*(?P<s>\p{Lu}[\p{L}-]+)[ ,]+(?P<n>\d{1,4})(?!\d)"
)
_STREET_SHORT = (" St", " Ave", " Rd", " Ln")
_STREET_WORDS = (
    " street", " avenue", " road", " lane", " drive", " boulevard", " court", " square", " terrace", " crescent", " blvd", "straße", "strasse", "gasse ", "weg ", "platz ", "allee ",
    "rue ", "place ", "chemin ", "calle ", "avenida ", "plaza ", "paseo ",
)
_PASSPORTS = ("passport", "reisepass", "passeport", "pasaporte")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN = regex.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = regex.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")

Found = tuple[int, int, str, str]


def _script(text: str) -> str:
    return "cyrillic" if regex.search(r"\p{Cyrillic}", text) else "greek" if regex.search(r"\p{Greek}", text) else "latin"


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card_like(digits: str) -> bool:
    """Sixteen digits, or the right check digit with a length and start that an issuer uses."""
    if len(digits) == 16:
        return True
    start = {13: ("4",), 14: ("30", "36", "38"), 15: ("34", "37"), 18: ("62",), 19: ("4", "62")}.get(len(digits), ())
    return digits.startswith(start) and luhn(digits) if start else False


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number."""
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _account(said: str) -> str | None:
    plain = said.replace(" ", "")
    return plain if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4] else None


def _ipv6(said: str) -> str | None:
    try:
        address = ipaddress.IPv6Address(said)
    except ValueError:
        return None
    return None if address.is_unspecified or address.is_loopback or not regex.search("[0-9A-Fa-f]{2}", said) else address.compressed


def _day(said: str) -> date | None:
    parts = [int(x) for x in regex.split("[./-]", said)]
    if parts[0] > 31:
        year, month, day = parts
    else:
        day, month, year = parts
        if month > 12:
            day, month = month, day
    try:
        return date(year, month, day) if 1890 <= year <= 2100 else None
    except ValueError:
        return None


def _personal(text: str, lowered: str) -> Iterator[Found]:
    """Accounts, addresses of version 6, passports, dates of birth and streets; each is looked for where a sign of it is."""
    if text.count(":") > 1:
        for m in _IPV6.finditer(text):
            normal = _ipv6(m[0])
            if normal:
                yield m.start(), m.end(), "ipv6", normal
    for start in _IBAN_START.finditer(text):
        m = _IBAN.match(text, start.start())
        normal = _account(m[0]) if m else None
        if normal:
            yield m.start(), m.end(), "iban", normal
    for at in _places(text, lowered, _BORN):
        m = _BIRTH.match(text, at)
        day = _day(m["d"]) if m else None
        if day:
            yield m.start("d"), m.end("d"), "birth", day.isoformat()
    for at in _places(text, lowered, _PASSPORTS):
        m = _PASSPORT.match(text, at)
        if m:
            yield m.start("p"), m.end("p"), "passport", m["p"]
    for at in {*_places(text, lowered, _STREET_WORDS), *_places(text, text, _STREET_SHORT)}:
        for m in _STREET.finditer(text, max(0, at - 60), at + 60):
            low, high = min(m.start("n"), m.start("s")), max(m.end("n"), m.end("s"))
            yield low, high, "street", f"{m['n']}|{m['s'].lower()}"


def _places(text: str, lowered: str, words: tuple[str, ...]) -> Iterator[int]:
    """Where a word stands in the text; ``lowered`` may be of another length, then by a slower way."""
    if len(text) != len(lowered):
        yield from (m.start() for w in words for m in regex.finditer(regex.escape(w), text, regex.IGNORECASE))
        return
    for word in words:
        at = lowered.find(word)
        while at >= 0:
            yield at
            at = lowered.find(word, at + 1)


def _emails(text: str) -> Iterator[Found]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and at - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end(), "email", text[start : domain.end()].lower()
        at = text.find("@", at + 1)


def _numbers(text: str) -> Iterator[Found]:
    for m in _NUMBERS.finditer(text):
        kind, said = m.lastgroup, m[0]
        if kind == "ip":
            if all(int(x) < 256 for x in said.split(".")):
                yield m.start(), m.end(), kind, said
        elif kind == "phone":
            normal = phone(said)
            if normal:
                yield m.start(), m.end(), kind, normal
        else:
            digits = "".join(c for c in said if c.isdigit())
            if kind == "ssn" or card_like(digits):
                yield m.start(), m.end(), kind, digits


def phone(said: str) -> str | None:
    """Country code and national number of a telephone number; no code when none is known."""
    digits = "".join(c for c in said if c.isdigit())
    if said.startswith("+") or (said.startswith("00") and len(digits) > 10):
        digits = digits[2:] if said.startswith("00") else digits
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])
        national = digits[len(code) :]
        if "(0)" in said and national.startswith("0"):
            national = national[1:]
        return f"{code}|{national}" if 7 <= len(digits) <= 15 and len(national) > 3 else None
    if len(digits) == 10 and digits[0] != "0":
        return f"1|{digits}"
    if len(digits) == 11 and digits[0] == "1":
        return f"1|{digits[1:]}"
    if _DATE.match(said) or not 7 <= len(digits) <= 15 or (digits[0] == "0" and len(digits) < 9):
        return None
    return f"|{digits}"


def _announced(text: str, taken: list[Found]) -> Iterator[Found]:
    for m in _CUED.finditer(text):
        start, end = m.span("n")
        normal = phone(m["n"])
        if normal and not any(a < end and start < b for a, b, _, _ in taken):
            yield start, end, "phone", normal


def _parts(kind: str, said: str, start: int, gender: str) -> Iterator[Found]:
    """A name's parts, which hyphens join."""
    for m in _PIECE.finditer(said):
        plain = m[0].lower().replace("’", "'")
        normal = f"{_KNOWN.get(plain, '') or gender}|{plain}" if kind == "given" else plain
        yield start + m.start(), start + m.end(), kind, normal


def _names(text: str, lowered: str) -> list[Found]:
    found: list[Found] = []
    for m in _TITLED.finditer(text):
        gender = _GENDER[m[1].lower()]
        if m[3]:
            found += _parts("given", m[2], m.start(2), gender)
        found += _parts("family", m[3] or m[2], m.start(3) if m[3] else m.start(2), "")
    for m in _NAMED.finditer(text):
        if m[1].lower() in _KNOWN:
            found += _parts("given", m[1], m.start(1), "")
            found += _parts("family", m[2], m.start(2), "")
    for at in _places(text, lowered, _GREETINGS):
        if at and text[at - 1].isalpha() or (m := _GREETED.match(text, at)) is None:
            continue
        people = [m]
        while (more := _JOINED.match(text, people[-1].end())) is not None:
            people.append(more)
        for p in people:
            if p[2]:
                found += _parts("given", p[1], p.start(1), "")
                found += _parts("family", p[2], p.start(2), "")
            elif p is m and p[1].lower() not in _GENDER:
                found += _parts("given", p[1], p.start(1), "")
    if not found:
        return found
    # The same parts on their own: family names first, then given names.
    whose = {n.split("|")[-1]: (k, n) for _, _, k, n in sorted(found, key=lambda f: (f[2] == "family", f[0]))}
    taken = {(a, b) for a, b, _, _ in found}
    for m in _BARE.finditer(text):
        plain = m[0].lower().replace("’", "'")
        if plain in whose and m.span() not in taken:
            found.append((*m.span(), *whose[plain]))
    return found


def entities(text: str | None) -> list[Found]:
    """Start, end (code points), kind and normal form of the entities of a text, without overlaps."""
    if not text:
        return []
    found: list[Found] = []
    if "@" in text:
        found += _emails(text)
    lowered = text.lower()
    found += _personal(text, lowered)
    found += [n for n in _numbers(text) if not any(a < n[1] and n[0] < b for a, b, _, _ in found)]
    found += _announced(text, found)
    found += _names(text, lowered)
    out: list[Found] = []
    for f in sorted(set(found), key=lambda f: (f[0], -f[1], f[2])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


class _Draw:
    """A stream of numbers from key, kind, normal form and draw."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.name, self.block, self.rest = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 4:
            self.rest = hmac.new(self.key, self.name + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.rest = int.from_bytes(self.rest[:4], "big"), self.rest[4:]
        return value % n

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits, the rest as it is."""
        letters = "abcdefghijklmnopqrstuvwxyz"
        return "".join(letters[self.below(26)] if c.isalpha() else str(self.below(10)) if c.isdigit() else c for c in text)


def surrogate(key: bytes, kind: str, normal: str, draw: int) -> str:
    """The normal form of the surrogate."""
    say = _Draw(key, kind, normal, str(draw))
    if kind == "email":
        local, domain = normal.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        new_host = _Draw(key, "domain", domain).like(host)
        grown = say.like("abc") if draw >= WIDEN else ""
        return f"{say.like(local)}{grown}@{new_host}.{top}"
    if kind == "ip":
        octets = normal.split(".")
        if draw >= WIDEN:
            return ".".join(str(1 + say.below(254)) for _ in octets)
        ranges = {1: (1, 10), 2: (10, 100), 3: (100, 255)}
        return ".".join(str(ranges[len(o)][0] + say.below(ranges[len(o)][1] - ranges[len(o)][0])) for o in octets)
    if kind == "phone":
        country, digits = normal.split("|")
        first = "0" + str(1 + say.below(9)) if digits[0] == "0" else str(2 + say.below(8))
        return f"{country}|{first}{say.like(digits[len(first):])}"
    if kind in ("ssn", "passport"):
        new = say.like(normal)
        return new.upper() if kind == "passport" else new
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(normal).exploded.split(":")
        # Empty groups stay, so the address is written alike; the first one stays, its network is no person's.
        drawn = [g if not i or g == "0000" else f"{1 + say.below(65535):04x}" for i, g in enumerate(groups)]
        return ipaddress.IPv6Address(":".join(drawn)).compressed
    if kind == "iban":
        account = say.like(normal[4:].lower()).upper()
        return normal[:2] + iban_check(normal[:2], account) + account
    if kind == "birth":
        return (date.fromisoformat(normal) + timedelta(days=40 + _Draw(key, "days").below(2000))).isoformat()
    if kind == "street":
        number, name = normal.split("|")
        return f"{max(1, int('1' + say.like(number)) % 10 ** len(number))}|{surrogate(key, 'family', name, draw)}"
    if kind == "card":
        body = normal[0] + say.like(normal[1:-1])
        check = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (check if luhn(normal) else str((int(check) + 1 + say.below(9)) % 10))
    gender, name = normal.split("|") if kind == "given" else ("", normal)
    first, second, endings = _SOUNDS[_script(name)]
    syllables = 1 + say.below(2) + (draw >= WIDEN) + draw // (2 * WIDEN) + (kind == "family")
    body = "".join(first[say.below(len(first))] + second[say.below(len(second))] for _ in range(syllables))
    new = body + first[say.below(len(first))] + endings[gender]
    return f"{gender}|{new}" if kind == "given" else new


def written(kind: str, said: str, new: str) -> str:
    """The surrogate in the format of a mention."""
    if kind in ("phone", "card", "ssn"):
        # A telephone number's code and what is dialled before the national number stay.
        digits = new.split("|")[-1]
        stay = [c for c in said if c.isdigit()]
        supply = iter([*stay[: len(stay) - len(digits)], *digits])
        return "".join(next(supply) if c.isdigit() else c for c in said)
    if kind in ("ip", "passport"):
        return new
    if kind == "ipv6":
        return new.upper() if regex.search("[A-F]", said) else new
    if kind == "iban":
        supply = iter(new)
        return "".join(c if c == " " else next(supply) for c in said)
    if kind == "birth":
        return _dated(said, date.fromisoformat(new))
    if kind == "street":
        number, name = new.split("|")
        digits = regex.search(r"\d+", said)
        word = regex.search(r"\p{Lu}.*\p{L}", said)
        parts = sorted([(digits.span(), number), (word.span(), name[:1].upper() + name[1:])])
        (a, b), (c, d) = parts[0][0], parts[1][0]
        return said[:a] + parts[0][1] + said[b:c] + parts[1][1] + said[d:]
    new = new.split("|")[-1]
    if said.isupper():
        return new.upper()
    if kind in ("given", "family"):
        return new[:1].upper() + new[1:]
    return "".join(n.upper() if i < len(said) and said[i].isupper() else n for i, n in enumerate(new))


def _dated(said: str, day: date) -> str:
    """The date in the order and width of a mention."""
    parts = regex.split("([./-])", said)
    numbers = [int(x) for x in parts[::2]]
    if numbers[0] > 31:
        values = (day.year, day.month, day.day)
    else:
        values = (day.month, day.day, day.year) if numbers[1] > 12 else (day.day, day.month, day.year)
    return "".join(parts[i] if i % 2 else str(values[i // 2]).zfill(len(parts[i])) for i in range(len(parts)))


def rewrite(text: str | None, key: bytes, redrawn: Mapping[tuple[str, str], int]) -> tuple[str | None, list[Found]]:
    """The text with all entities replaced, and what was found."""
    found = entities(text)
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, normal in found:
        new = surrogate(key, kind, normal, redrawn.get((kind, normal), 0))
        out += [text[at:start], written(kind, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), found


def all_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, normal`` of every entity of the corpus, once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, text):
                here = sorted({(k, n) for t in piece.column(text).to_pylist() for _, _, k, n in entities(t)})
                yield pa.RecordBatch.from_pydict(
                    {"kind": pa.array([k for k, _ in here], pa.string()), "normal": pa.array([n for _, n in here], pa.string())}
                )

    return durable(docs.select(text).mapInArrow(collect, "kind string, normal string").distinct())


def _drawn(named: DataFrame, key: bytes) -> DataFrame:
    """``kind, normal, draw`` with the surrogate of that draw."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["kind", "normal", "draw"]).to_pydict()
            new = [surrogate(key, *row) for row in zip(*rows.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rows], pa.array(new, pa.string())], names=[*rows, "new"])

    return named.select("kind", "normal", "draw").mapInArrow(give, "kind string, normal string, draw int, new string")


def format_of(kind: Column, normal: Column) -> Column:
    """What the surrogate shares with the entity of a kind with few values: digits as 0, small letters as a."""
    shape = F.regexp_replace(F.regexp_replace(normal, "[0-9]", "0"), "[A-Za-z]", "a")
    return (
        F.when(kind == "phone", F.concat(F.substring_index(normal, "|", 1), F.lit("|"), F.regexp_replace(F.substring_index(normal, "|", -1), "[0-9]", "0")))
        .when(kind == "card", F.concat(F.left(normal, F.lit(1)), shape))
        .when(kind == "iban", F.concat(F.left(normal, F.lit(2)), F.substring(shape, 5, 99)))
        .when(kind.isin("ssn", "passport"), shape)
    )


def enough_values(known: DataFrame) -> None:
    """Raise when a format has fewer than twice as many values as entities; drawing could not end."""
    shape = format_of(F.col("kind"), F.col("normal")).alias("shape")
    counted = known.select("kind", shape).where("shape IS NOT NULL").groupBy("kind", "shape").agg(F.count("*").alias("n"))
    body = F.substring_index("shape", "|", -1)
    digits, letters = (F.length(body) - F.length(F.replace(body, F.lit(c), F.lit(""))) for c in "0a")
    # A telephone number's first digit and a card's first and check digit are not free.
    fixed = F.when(F.col("kind") == "phone", 1).when(F.col("kind") == "card", 2).otherwise(0)
    values = F.pow(F.lit(10.0), F.greatest(digits - fixed, F.lit(0))) * F.pow(F.lit(26.0), letters)
    full = counted.where(2 * F.col("n") > values).take(5)
    if full:
        raise ContractError("too many entities for their format: " + "; ".join(f"{r.kind} {r['shape']}: {r.n}" for r in full))


def assign(known: DataFrame, key: bytes) -> DataFrame:
    """``kind, normal, draw, new``: distinct surrogates, none of them a real entity (but for dates of birth)."""
    enough_values(known)
    real = known.select(F.col("kind").alias("r_kind"), F.col("normal").alias("r_normal"))
    now = durable(_drawn(known.withColumn("draw", F.lit(0)), key))
    while True:
        owner = now.groupBy(F.col("kind").alias("o_kind"), F.col("new").alias("o_new")).agg(F.min(F.struct("draw", "normal")).alias("o"))
        same = (F.col("kind") == F.col("o_kind")) & (F.col("new") == F.col("o_new"))
        judged = now.join(owner, same).join(
            real.withColumn("is_real", F.lit(True)), (F.col("kind") == F.col("r_kind")) & (F.col("new") == F.col("r_normal")), "left"
        )
        bad = (F.col("kind") != "birth") & (F.coalesce("is_real", F.lit(False)) | (F.col("o.normal") != F.col("normal")))
        judged = durable(judged.select("kind", "normal", "draw", "new", bad.alias("bad")))
        if judged.where("bad").isEmpty():
            return judged.drop("bad")
        again = _drawn(judged.where("bad").withColumn("draw", F.col("draw") + 1), key)
        now = durable(judged.where("NOT bad").drop("bad").unionByName(again))


def replace(docs: DataFrame, key: bytes, *, text: str = "text", broadcast: int = BROADCAST_REDRAWN) -> DataFrame:
    """Documents with surrogates in ``text`` and ``_pii_kinds``, the kinds of the entities found."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    redrawn = durable(assign(all_entities(rows), key).where("draw > 0").select("kind", "normal", "draw"))
    few = redrawn.limit(broadcast + 1).count() <= broadcast
    table = {(r["kind"], r["normal"]): r["draw"] for r in redrawn.collect()} if few else {}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    source = rows if few else _with_redrawn(rows, redrawn)
    schema = T.StructType(
        [rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]
    )

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                own = [None] * len(piece) if few else piece.column("redrawn").to_pylist()
                texts, kinds = [], []
                for t, mine in zip(piece.column("text").to_pylist(), own, strict=True):
                    draws = shared.value if mine is None else {(m["kind"], m["normal"]): m["draw"] for m in mine}
                    new, found = rewrite(t, key, draws)
                    texts.append(new)
                    kinds.append([f[2] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=schema.names
                )

    changed = source.mapInArrow(change, schema)
    kept = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "_pii_kinds"]
    return changed.select(*kept, F.col("kinds").alias("_pii_kinds"))


def _with_redrawn(rows: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Rows with ``redrawn``: those of their entities that drew again."""
    keyed = rows.withColumn("at", F.xxhash64("text"))

    def mention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [
                (i, k, n) for i, t in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for k, n in {(f[2], f[3]) for f in entities(t)}
            ]
            cells = list(zip(*named, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.string()), pa.array(cells[2], pa.string())],
                names=["of", "kind", "normal"],
            )

    mentions = keyed.select("at", "text").mapInArrow(mention, "of bigint, kind string, normal string").distinct()
    own = mentions.join(redrawn, ["kind", "normal"]).groupBy("of").agg(F.collect_list(F.struct("kind", "normal", "draw")).alias("redrawn"))
    joined = keyed.join(own, F.col("at") == F.col("of"), "left")
    empty = F.array().cast("array<struct<kind:string,normal:string,draw:int>>")
    return joined.select("row", "text", F.coalesce("redrawn", empty).alias("redrawn"))
