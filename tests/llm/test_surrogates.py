from __future__ import annotations

import re

import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.core import ContractError
from cohort_spark.llm import surrogates as S
from cohort_spark.llm.registry import QUERIES

KEY = b"k"


@pytest.mark.parametrize(("text", "want"), [
    ("mail John.Doe+x@Mail.Example.com now", [("email", "John.Doe+x@Mail.Example.com")]),
    ("call +1 (743) 555-3824 or 212-555-0199.", [("phone", "+1 (743) 555-3824"), ("phone", "212-555-0199")]),
    ("from 8.196.197.208. not 300.1.1.1 nor 1.2.3.4.5", [("ip", "8.196.197.208")]),
    ("card 4565410125667261, 4111 1111 1111 1111; id 12345", [("card", "4565410125667261"), ("card", "4111 1111 1111 1111")]),
    ("ssn 078-05-1120", [("ssn", "078-05-1120")]),
    ("Mrs. Anna Müller met Mr Smith", [("given", "Anna"), ("family", "Müller"), ("family", "Smith")]),
    ("госпожа Ольга Петрова", [("given", "Ольга"), ("family", "Петрова")]),
    ("plain words, a@b, @ and 12.5", []), ("", []),
])
def test_entities(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in S.entities(text)] == want


def test_format_script_gender_and_coreference():
    text = "Mrs Anna Müller, +1 (743) 555-3824, 4111111111111111, 10.20.30.140, a.b7@X.org. MRS? Mr Müller; A.B7@x.org; госпожа Ольга Петрова"
    new, found = S.rewrite(text, KEY, {})
    parts = {text[a:b]: None for a, b, _, _ in found}
    assert not any(p in new for p in parts)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    assert re.search(r"\d{2}\.\d{2}\.\d{2}\.\d{3}", new)
    assert S.luhn(re.search(r"\b4\d{15}\b", new)[0])
    family = re.search(r"Mrs (\w+ia) (\w+),", new)
    assert f"Mr {family[2]};" in new
    mails = re.findall(r"\S+@\w+\.org", new)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[1][0].isupper()
    assert re.search(r"госпожа [А-Яа-я]+ия [А-Яа-я]+", new)
    assert S.rewrite(text, KEY, {})[0] == new != S.rewrite(text, b"other", {})[0]
    assert not S.luhn(S.surrogate(KEY, "card", "4111111111111112", 0))


@pytest.mark.parametrize("text", [
    "+44 20 7946 0958", "+49 30 1234567", "+33 1 23 45 67 89", "+44 (0)20 7946 0958", "0044 20 7946 0958", "4155551234", "+14155551234",
    "020 7946 0958", "01 23 45 67 89", "1-415-555-1234",
])
def test_whole_phone_numbers(text):
    assert [(k, a, b) for a, b, k, _ in S.entities(f"x {text}, y")] == [("phone", 2, 2 + len(text))]
    new, found = S.rewrite(f"x {text}, y", KEY, {})
    assert text not in new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"x {text}, y")
    assert S.entities(new)[0][2:] == ("phone", S.surrogate(KEY, *found[0][2:], 0))


def test_one_phone_number_has_one_form():
    said = "+1 (415) 555-1234; +1 415-555-1234; 415-555-1234; 4155551234; 1-415-555-1234"
    assert {f[3] for f in S.entities(said)} == {"1|4155551234"} and len(S.entities(said)) == 5
    assert len({f[3] for f in S.entities("+44 20 7946 0958; 0044 20 7946 0958; +44 (0)20 7946 0958")}) == 1
    assert S.entities("on 01.02.2024 or 2024-01-15, 01-02-2024 10:30; id 12345; 1700000000; call 2024-01-15; 3.2155551234") == []
    assert [f[2] for f in S.entities("call 555-1234; ssn 078-05-1120")] == ["phone", "ssn"]


@pytest.mark.parametrize(("text", "want"), [
    ("Mr McDonald left", ["McDonald"]), ("Dr O'Brien's", ["O'Brien"]), ("MR SMITH", ["SMITH"]), ("Ms Smith-Jones", ["Smith", "Jones"]),
    ("Prof. Dr. Hans van der Berg", ["Hans", "Berg"]), ("Mrs de la Cruz", ["Cruz"]), ("Professor J. Smith", ["Smith"]),
    ("Mr Smith said. Later Smith left with SMITH, not smith or Smithson; Mary Jones, then Mary", ["Smith", "Smith", "SMITH", "Mary", "Jones", "Mary"]),
    ("Mrs\nplain Smith", []),
])
def test_whole_names(text, want):
    assert [text[a:b] for a, b, _, _ in S.entities(text)] == want


def test_later_mentions_keep_coreference():
    new, _ = S.rewrite("Mr McDonald came; later McDonald and MCDONALD left", KEY, {})
    first = re.search(r"Mr (\w+)", new)[1]
    assert new == f"Mr {first} came; later {first} and {first.upper()} left"


def test_collisions_draw_again(spark, monkeypatch):
    # Nine values for one digit in four places: 150 addresses collide often.
    rows = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)] + [("family", f"name{c}") for c in "abcdefgh" * 10]
    known = spark.createDataFrame(rows, "kind string, normal string").distinct()
    got = S.assign(known, KEY).collect()
    assert len(got) == known.count() == len({(r.kind, r.new) for r in got})
    real = {(r[0], r[1]) for r in rows}
    assert not any((r.kind, r.new) in real for r in got)
    assert any(r.draw for r in got)
    docs = spark.createDataFrame([(i, f"x {n} y {n}", "c") for i, (k, n) in enumerate(rows) if k == "ip"] + [(900, None, None)], "doc_id bigint, text string, kind string")
    few, many = S.replace(docs, KEY).collect(), S.replace(docs, KEY, broadcast=0).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))
    texts = [r.text for r in few if r.text]
    assert len(set(texts)) == 81 and all(re.fullmatch(r"x (\S+) y \1", t) for t in texts)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.com"), (3, "a@b.com"), (3, "a@b.com"), (4, "1" * 5000 + "@" * 50)], "doc_id bigint, text string")
    rows = S.replace(docs, KEY).collect()
    assert [r.text for r in rows[:2]] == [None, ""] and rows[5].text == docs.collect()[5].text
    assert rows[2].text == rows[3].text == rows[4].text != "a@b.com"
    assert S.replace(docs.limit(0), KEY).count() == 0


def test_query_leaves_no_entity_of_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_pii_surrogates"](spark, sf).collect()
    assert len(rows) == len(before)
    real = {(k, n) for t in before.values() for _, _, k, n in S.entities(t)}
    assert len(real) > 40
    first: dict = {}
    for r in rows:
        old, new = S.entities(before[r.doc_id]), S.entities(r.text)
        assert [f[2] for f in old] == [f[2] for f in new]
        assert not {(k, n) for _, _, k, n in new} & real
        for a, b in zip(old, new, strict=True):
            assert first.setdefault((a[2], a[3]), b[3]) == b[3]
        if not old:
            assert r.text == before[r.doc_id]
    assert len(set(first.values())) == len(first)


@pytest.mark.parametrize(("text", "want"), [
    ("IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432.", [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]),
    ("from 2001:db8::8a2e:370:7334, 2001:0DB8:85A3:0000:0000:8A2E:0370:7335", [("ipv6", "2001:db8::8a2e:370:7334"), ("ipv6", "2001:0DB8:85A3:0000:0000:8A2E:0370:7335")]),
    ("born on 31.12.1980; date of birth: 1975-02-03; DOB 12/25/1999", [("birth", "31.12.1980"), ("birth", "1975-02-03"), ("birth", "12/25/1999")]),
    ("passport no. C01234567 and Passport: 123456789", [("passport", "C01234567"), ("passport", "123456789")]),
    ("at 221 Baker Street, Hauptstraße 12, 5 rue de Rivoli, calle Mayor 7", [("street", "221 Baker"), ("street", "Hauptstraße 12"), ("street", "5 rue de Rivoli"), ("street", "Mayor 7")]),
    ("Dear Sarah Connor, meet Wei Zhang and Priya Patel", [("given", "Sarah"), ("family", "Connor"), ("given", "Wei"), ("family", "Zhang"), ("given", "Priya"), ("family", "Patel")]),
    ("меня зовут Анна Петрова; με λένε Νίκος Παππάς", [("given", "Анна"), ("family", "Петрова"), ("given", "Νίκος"), ("family", "Παππάς")]),
    ("a@b1.b2.b3.b4.b5.b6.b7.b8.b9.example.com", [("email", "a@b1.b2.b3.b4.b5.b6.b7.b8.b9.example.com")]),
    ("378282246310005 3782 4222222222222", [("card", "378282246310005"), ("card", "4222222222222")]),
    ("9780306406157 1700000000000 20240131123456 378282246310006", []),
    ("at 10:30:45, a::b, DE88370400440532013000, 12 monkeys, 1999-12-31, the dear old house", []),
])
def test_more_kinds(text, want):
    found = S.entities(text)
    assert [(k, text[a:b]) for a, b, k, _ in found] == want
    new, _ = S.rewrite(text, KEY, {})
    assert not any(part in new for _, part in want if len(part) > 6)


def test_formats_and_check_digits_stay():
    new, _ = S.rewrite("DE89 3704 0044 0532 0130 00", KEY, {})
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", new) and S._account(new) and "3704" not in new
    new, _ = S.rewrite("born 31.12.1980, DOB 1980-12-31, born 12/31/1980", KEY, {})
    day = re.findall(r"\d[\d./-]+\d", new)
    assert {S._day(d) for d in day} == {S._day(day[0])} and S._day(day[0]) != S._day("31.12.1980")
    assert [re.sub(r"\d", "0", d) for d in day] == ["00.00.0000", "0000-00-00", "00/00/0000"]
    new, _ = S.rewrite("2001:0DB8:85A3::8A2E:0370:7334", KEY, {})
    assert S._ipv6(new) and new.startswith("2001:") and new == new.upper()
    new, _ = S.rewrite("at 221 Baker Street", KEY, {})
    assert re.fullmatch(r"at \d{1,3} \p{Lu}\w+ Street".replace(r"\p{Lu}", "[A-Z]"), new) and "Baker" not in new


def test_full_formats_are_refused(spark):
    known = spark.createDataFrame([("phone", f"299|{n}") for n in range(2000, 8000)], "kind string, normal string")
    with pytest.raises(ContractError, match="phone 299"):
        S.assign(known, KEY)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org", "x", 5, "r", "q")], "doc_id bigint, text string, _pii_kinds string, row int, at string, redrawn string")
    for size in (100, 0):
        out = S.replace(docs, KEY, broadcast=size).first()
        assert (out["row"], out["at"], out["redrawn"], out["_pii_kinds"]) == (5, "r", "q", ["email"]) and "a.b@" not in out["text"]
