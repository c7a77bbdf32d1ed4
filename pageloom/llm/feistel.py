"""Operator 8: format-preserving pseudonyms for personal data.

Found and validated are: e-mail addresses, card numbers (Luhn), IBANs (mod 97), US social
security numbers, phone numbers, IPv4 addresses and dates. The digits (of an
address, letters and digits) are one number of a domain whose size follows from the
format; a keyed Feistel network permutes the domain, walking on until the result is
valid again, and the check digits are computed anew. A value thus becomes another
one of its format, and equal values, however they are spaced, become equal ones
in every document. The keyed permutation can be undone with the key.

Null texts stay null, empty ones empty; text around the values is not touched.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache

from pyspark.sql import DataFrame

from pageloom.llm.common import add_columns, hold

KEY = b"pageloom-pseudonyms"  # give a key of your own; this one is only good for tests
ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")


def permute(value: int, size: int, key: bytes, tweak: bytes, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
    """A keyed permutation of ``range(size)`` that maps valid values to valid ones.

    An unbalanced domain is walked: results outside it are permuted again.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def round_value(i: int, right: int) -> int:
        message = tweak + bytes([i]) + right.to_bytes((half + 7) // 8, "big") + size.to_bytes(64, "big")
        return int.from_bytes(hmac.digest(key, message, "sha256"), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ round_value(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ round_value(i, right)
        value = left << half | right
        if value < size and valid(value):
            return value


def luhn_digit(digits: str) -> str:
    """The check digit behind these digits."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        double = int(digit) * 2 if i % 2 == 0 else int(digit)
        total += double - 9 if double > 9 else double
    return str(-total % 10)


def _refill(shape: str, characters: str, kind: str = r"\d") -> str:
    """The shape with its characters of a kind replaced one after the other."""
    source = iter(characters)
    return re.sub(kind, lambda _: next(source), shape)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1 or digits[0] not in "23456":
        return None
    head, body = digits[:1], digits[1:-1]
    other = f"{permute(int(body), 10 ** len(body), key, b'card' + head.encode(), back=back):0{len(body)}d}"
    return _refill(text, head + other + luhn_digit(head + other))


# The lengths of the IBAN registry.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG DJ",
        25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _valid_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]


def _iban(text: str, key: bytes, back: bool) -> str | None:
    """The new IBAN at the start of the text, which may go on with words that look like more of its groups.

    It ends where it has its country's length, else at the last group that makes it valid.
    """
    ends = [*[m.start() for m in re.finditer(" ", text)], len(text)]
    length = IBAN_LENGTHS.get(text[:2])
    ends.sort(key=lambda end: (len(text[:end].replace(" ", "")) == length, end), reverse=True)
    text = next((text[:end] for end in ends if _valid_iban(text[:end].replace(" ", ""))), "")
    if not text:
        return None
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    places = [c for c in body if c.isdigit()]
    if not places:
        return None
    number = permute(int("".join(places)), 10 ** len(places), key, b"iban" + country.encode(), back=back)
    other = _refill(body, f"{number:0{len(places)}d}")
    return _refill(text, country + _iban_check(country, other) + other, r"[A-Z0-9]")


def _valid_ssn(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group != 0 and serial != 0


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    number = int(re.sub(r"\D", "", text))
    if not _valid_ssn(number):
        return None
    return _refill(text, f"{permute(number, 10**9, key, b'ssn', _valid_ssn, back):09d}")


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    # Country code: of +1 and +7 one digit, else two; without + none.
    head = digits[: (1 if digits[0] in "17" else 2)] if text.lstrip("(").startswith("+") else ""
    body = digits[len(head) :]
    low = 10 ** (len(body) - 1) * 2  # no subscriber or area starts with 0 or 1
    valid = (lambda n: n >= low) if body[0] > "1" else (lambda n: n < low)
    number = permute(int(body), 10 ** len(body), key, b"phone" + head.encode(), valid, back)
    return _refill(text, f"{head}{number:0{len(body)}d}")


def _valid_ip(n: int) -> bool:
    first = n >> 24
    return 0 < first < 224 and first not in (10, 127)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(part) for part in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    number = int.from_bytes(bytes(parts), "big")
    valid = _valid_ip if _valid_ip(number) else (lambda n: not _valid_ip(n))
    return ".".join(map(str, permute(number, 2**32, key, b"ip", valid, back).to_bytes(4, "big")))


FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Year first; else day first with dots, and with slashes or hyphens month first where that is a date.

    The result is read in the same order again: days up to 12 stay days up to 12 where the order is open.
    """
    match = re.fullmatch(r"(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})", text)
    a, sign, b, c = match.groups()

    def day_of(y: str, m: str, d: str) -> int | None:
        try:
            number = (date(int(y), int(m), int(d)) - FIRST_DAY).days
        except ValueError:
            return None
        return number if 0 <= number < DAYS else None

    if len(a) == 4:
        order, number = "ymd", day_of(a, b, c)
    elif len(c) != 4:
        return None
    elif sign != "." and day_of(c, a, b) is not None:
        order, number = "mdy", day_of(c, a, b)
    else:
        order, number = "dmy", day_of(c, b, a)
    if number is None:
        return None
    loose = order == "dmy" and sign != "."  # only days over 12 are read this way
    width = {"ymd": (4, len(b), len(c)), "mdy": (len(a), len(b), 4), "dmy": (len(a), len(b), 4)}[order]

    def fields(n: int) -> list[int]:
        when = FIRST_DAY + timedelta(n)
        return {"ymd": [when.year, when.month, when.day], "mdy": [when.month, when.day, when.year], "dmy": [when.day, when.month, when.year]}[order]

    def valid(n: int) -> bool:
        parts = fields(n)
        if loose and parts[0] <= 12:
            return False
        return all(len(str(p)) <= w or w == 4 for p, w in zip(parts, width, strict=True)) and all(
            w != 1 or p < 10 for p, w in zip(parts, width, strict=True)
        )

    tweak = b"date" + bytes(width) + order.encode() + bytes([loose])
    parts = fields(permute(number, DAYS, key, tweak, valid, back))
    return sign.join(f"{p:0{w}d}" for p, w in zip(parts, width, strict=True))


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, _, domain = text.rpartition("@")
    host, _, top = domain.rpartition(".")
    if not name or not host or len(text) > 254 or ".." in text or name[0] == ".":
        return None
    text, ending = f"{name}@{host}", f".{top}"
    radix = [10 if c.isdigit() else 26 for c in text if c.isascii() and c.isalnum()]
    if not radix:
        return None
    number = size = 0
    size, number = 1, 0
    for c in text:
        if c.isascii() and c.isalnum():
            r = 10 if c.isdigit() else 26
            number, size = number * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
    # The key sees where letters and digits stand, so that the domain is that of the format.
    tweak = b"email" + bytes(r for r in radix)
    number = permute(number, size, key, tweak, back=back)
    out = []
    for r in reversed(radix):
        number, part = divmod(number, r)
        out.append(str(part) if r == 10 else chr(97 + part))
    source = iter(reversed(out))
    put = lambda c: (lambda n: n.upper() if c.isupper() else n)(next(source)) if c.isascii() and c.isalnum() else c
    return "".join(map(put, text)) + ending


# The forms that are looked at. A candidate must not touch other word characters.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
TIME = r"(?:(?<=[-/.]\d[-/.]\d)|(?<=[-/.]\d\d[-/.]\d)|(?<=[-/.]\d[-/.]\d\d)|(?<=[-/.]\d\d[-/.]\d\d))(?=[Tt]\d\d)"  # what may stand behind a date
NUMBER = rf"(?<![\w.])(?:\+|\(\+?)?\d[\d ().\-/]{{4,}}\d(?:(?!\w)|{TIME})"  # a stretch that may hold several values
FORMS = (
    ("ip", r"\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"),
    ("date", r"\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}"),
    ("ssn", r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"),
    ("card", r"\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{4}(?:(?P=s3)\d{1,3})?|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5}|\d{13,19}"),
    (
        "phone",
        r"\(?\+1\)?[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}"
        r"|\(?\+(?!1\d?\b)\d{1,3}\)?[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,4}(?:[ .\-/]?\d{2,4}){1,4}"
        r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?:1[ .\-])?\d{3}(?P<s5>[ .\-])\d{3}(?P=s5)\d{4}",
    ),
)
_EMAIL, _IBAN, _NUMBER = re.compile(EMAIL), re.compile(IBAN), re.compile(NUMBER)
_VALUE = re.compile("|".join(f"(?<![\\w.])(?P<{kind}>{form})(?!\\w)" for kind, form in FORMS))


@lru_cache(maxsize=100_000)
def _value(kind: str, text: str, key: bytes, back: bool) -> str | None:
    return {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}[kind](text, key, back)


def replace_all(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had."""
    counts = dict.fromkeys(KINDS, 0)

    def put(kind: str, value: str) -> str | None:
        other = _value(kind, value, key, back)
        if other is not None:
            counts[kind] += 1
        return other

    def number(match: re.Match) -> str:
        return _VALUE.sub(lambda m: put(m.lastgroup or "", m[0]) or m[0], match[0])

    done = []
    last = 0
    # What one kind has made is not looked at by the next: spans are fixed on the original text.
    spans: list[tuple[int, int, str]] = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            if (other := put("email", m[0])) is not None:
                spans.append((m.start(), m.end(), other))
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        if (other := put("iban", m[0])) is not None:
            at = m.start() + len(other)
            spans.append((m.start(), at, other))
    # Numbers are looked for in what these leave.
    rest, free = [], 0
    for a, b, _ in sorted(spans):
        if a >= free:
            rest += [text[free:a], "_" * (b - a)]
            free = b
    for m in _NUMBER.finditer("".join([*rest, text[free:]])):
        spans.append((m.start(), m.end(), number(m)))
    for a, b, other in sorted(spans):
        if a >= last:
            done += [text[last:a], other]
            last = b
    return "".join([*done, text[last:]]), counts


def pseudonymize(documents: DataFrame, key: bytes = KEY, text: str = "text", back: bool = False) -> DataFrame:
    """The documents with pseudonyms in their texts, and ``n_<kind>`` counts."""

    def start():
        hold("pseudonyms")

        def work(texts):
            found = [(None, dict.fromkeys(KINDS, 0)) if t is None else replace_all(t, key, back) for t in texts]
            return [[f[0] for f in found], *[[f[1][kind] for f in found] for kind in KINDS]]

        return work

    columns = documents.columns
    counts = ", ".join(f"n_{kind} int" for kind in KINDS)
    done = add_columns(documents, [text], f"_new string, {counts}", start)
    kept = [c if c != text else "_new" for c in columns if c not in {f"n_{kind}" for kind in KINDS}]
    return done.select(*kept, *[f"n_{kind}" for kind in KINDS]).withColumnRenamed("_new", text)
