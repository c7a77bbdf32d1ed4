import random
import re
from datetime import date

import pytest

from pageloom.llm import feistel, queries
from tests.llm import cases


@pytest.mark.parametrize("size", [1, 2, 3, 10, 100, 1000, 4097])
def test_permutation(size):
    got = [feistel.permute(i, size, b"k", b"t") for i in range(size)]
    assert sorted(got) == list(range(size))
    assert [feistel.permute(g, size, b"k", b"t", back=True) for g in got] == list(range(size))
    if size >= 100:
        assert got != [feistel.permute(i, size, b"other", b"t") for i in range(size)]


def test_permutation_keeps_validity():
    even = lambda n: n % 2 == 0
    assert sorted(feistel.permute(i, 1000, b"k", b"", even) for i in range(0, 1000, 2)) == list(range(0, 1000, 2))


CASES = [
    ("card", "4041894974608795"), ("card", "4041 8949 7460 8795"), ("card", "4041-8949-7460-8795"), ("card", "378282246310005"),
    ("ip", "42.144.35.254"), ("phone", "+1 (208) 555-3235"), ("phone", "(208) 555-3235"), ("phone", "208-555-3235"),
    ("phone", "+49 30 901820"), ("ssn", "536-22-8726"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ("date", "1987-06-05"), ("date", "05.06.1987"), ("date", "12/31/1999"), ("date", "31/12/1999"), ("date", "1999/12/31"),
    ("email", "bosbt.42@mail8.example.com"), ("email", "A.B-c+d@x.co"),
]


@pytest.mark.parametrize(("kind", "value"), CASES)
def test_values_keep_their_format(kind, value):
    for before, after in (("", ""), ("call ", "."), ("(", ")"), ("x: ", ", then")):
        text, counts = feistel.replace_all(f"{before}{value}{after}")
        assert counts == {k: int(k == kind) for k in feistel.KINDS}
        other = text[len(before) : len(text) - len(after)]
        assert other != value
        if kind != "ip":
            assert re.sub(r"\d", "9", re.sub("[a-z]", "a", other)) == re.sub(r"\d", "9", re.sub("[a-z]", "a", value)) or kind == "email"
        again, more = feistel.replace_all(text, back=True)
        assert again == f"{before}{value}{after}" and more == counts


MIXED = [
    ("DE89 3704 0044 0532 0130 00 4111 1111 1111 1111", "iban card"), ("DE89 3704 0044 0532 0130 00 1987-06-05", "iban date"),
    ("DE89 3704 0044 0532 0130 00 208-555-3235", "iban phone"), ("call 555-123-4567 12345@x.com", "phone email"),
    ("BE68 5390 0754 7034 FROM", "iban"), ("BE68 5390 0754 7034 4111 1111 1111 1111", "iban card"), ("BE68 5390 0754 7034 FROM 536-22-8726", "iban ssn"),
    ("AB12 CDEF GHIJ DE89 3704 0044 0532 0130 00", "iban"), ("2021-03-04T10:15:00Z", "date"), ("at 2021-03-04T10:15:00.123456+01:00 or 2021/3/4t10", "date date"),
    ("536-22-8726 2021-03-04T10:15", "ssn date"),
]


@pytest.mark.parametrize(("text", "kinds"), MIXED)
def test_values_beside_others(text, kinds):
    other, counts = feistel.replace_all(text)
    assert counts == {k: kinds.split().count(k) for k in feistel.KINDS}
    assert len(other) == len(text) and feistel.replace_all(other, back=True) == (text, counts)
    for value in ("4111 1111 1111 1111", "1987-06-05", "208-555-3235", "555-123-4567", "12345@", "536-22-8726", "2021-03-04", "2021/3/4", "0754 7034", "0532 0130"):
        assert value not in other


@pytest.mark.parametrize("text", ["555-123-4567T10", "4111111111111111T10", "2021-03-04Tuesday"])
def test_only_a_date_goes_on_with_a_time(text):
    assert feistel.replace_all(text)[0] == text


def test_spelling_does_not_break_links():
    plain = feistel.replace_all("4041894974608795")[0]
    assert feistel.replace_all("4041 8949 7460 8795")[0].replace(" ", "") == plain
    assert feistel.luhn_digit(plain[:-1]) == plain[-1]


@pytest.mark.parametrize(
    "text",
    ["version 1.2.3 of 12", "4041894974608796", "1234567890123456", "999.1.1.1", "2021-13-45", "000-12-3456 x", "password=e3b3ed3cc8548923d6",
     "da83477b57ac2654884f485", "pi is 3.14159265358979", "a@b", "GB82WEST12345698765433", "year 2020 and 2021"],
)
def test_other_numbers_stay(text):
    assert feistel.replace_all(text) == (text, dict.fromkeys(feistel.KINDS, 0))


def test_dates_are_dates():
    choose = random.Random(2)
    for _ in range(300):
        day = date.fromordinal(choose.randrange(date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()))
        for form in (f"{day:%Y-%m-%d}", f"{day:%d.%m.%Y}", f"{day:%m/%d/%Y}", f"{day.year}-{day.month}-{day.day}"):
            text, counts = feistel.replace_all(form)
            assert counts["date"] == 1 and feistel.replace_all(text, back=True)[0] == form


def test_documents(spark, sf):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_feistel"](spark, sf).collect()}
    docs = cases.documents(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all((rows[d["doc_id"]]["text"], rows[d["doc_id"]]["n_card"]) == ((p := feistel.replace_all(d["text"]))[0], p[1]["card"]) for d in docs)
    found = re.compile(r"[\w.]+@[\w.]+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)|\d+\.\d+\.\d+\.\d+")
    values = {v for d in docs for v in found.findall(d["text"])}
    values = {v for v in values if not v.isdigit() or feistel.luhn_digit(v[:-1]) == v[-1]}
    assert values and not any(v in r["text"] for r in rows.values() for v in values)


def test_hard_documents(spark):
    docs = cases.hard_documents(spark)
    out = feistel.pseudonymize(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert feistel.pseudonymize(cases.empty_documents(spark)).count() == 0
