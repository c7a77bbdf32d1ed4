"""Columns derived from the path of a mirrored page.

A mirror lies under ``<base><category>/<domain>/<rest>``. ``base`` is always a
parameter: it has to be spelled as it is in the paths, final slash included.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.config import (
    BLOCKED_DOMAINS,
    KNOWN_CATEGORIES,
    SKIP_NAME_PARTS,
    SKIP_PATH_PARTS,
    UNKNOWN_CATEGORY,
    ScanRules,
)
from pageloom.functions.strings import bind, constant

# Fixed value: where a mirrored path is recognised whatever its base.
_DOCS_PATH = r"(?d)/docs/[^/]+/([^/]+)/(.*)$"
_PAGE_SUFFIX = r"(?:\.html|\.md)\z"


def _any_of(texts: Iterable[str]) -> str:
    """Regex for any of the texts, taken literally: one constant pattern tests them all."""
    return "|".join(rf"\Q{text}\E" for text in texts)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def detect_category(path: Column, known: tuple = KNOWN_CATEGORIES) -> Column:
    """The first known category, in the order of ``known``, that is a directory of the path."""
    names = constant(known, "array<string>")
    return bind(
        F.split(F.lower(path), "/"),
        lambda parts: F.coalesce(
            F.get(F.filter(names, lambda name: F.array_contains(parts, name)), F.lit(0)),
            F.lit(UNKNOWN_CATEGORY),
        ),
    )


def path_to_url(path: Column, base: str) -> Column:
    """Web address of a mirrored page; paths outside ``base`` stay as they are."""
    below = F.substring(path, len(base) + 1, 2**31 - 1)

    def address(parts: Column) -> Column:
        rest = F.regexp_replace(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), _PAGE_SUFFIX, "")
        url = F.concat(F.lit("https://"), F.get(parts, F.lit(1)), F.lit("/"), rest)
        return F.when(F.startswith(path, F.lit(base)), F.coalesce(url, path)).otherwise(path)

    return bind(F.split(below, "/", 3), address)


def url_from_docs_path(path: Column) -> Column:
    """Web address of a path that contains ``/docs/<category>/<domain>/<rest>`` anywhere."""
    domain = F.regexp_extract(path, _DOCS_PATH, 1)
    rest = F.regexp_replace(F.regexp_extract(path, _DOCS_PATH, 2), _PAGE_SUFFIX, "")
    url = F.concat(F.lit("https://"), domain, F.lit("/"), rest)
    return F.when(domain != "", url).otherwise(path)


def effective_url(url: Column, path: Column) -> Column:
    """The stored address, or one derived from the path where none is stored."""
    return F.coalesce(F.nullif(url, F.lit("")), url_from_docs_path(path))


def extract_domain(path: Column, base: str) -> Column:
    """The domain directory below the first occurrence of ``base``; '' without one."""
    start = F.instr(path, F.lit(base))
    below = F.substr(path, start + len(base))
    return F.when(start > 0, F.split_part(below, F.lit("/"), F.lit(2))).otherwise("")


def allowed_domain(path: Column, base: str, blocked: tuple = BLOCKED_DOMAINS) -> Column:
    """False if the domain ends with a blocked entry; ``*.x`` blocks what ends with ``.x``."""
    endings = [*blocked, *(entry[1:] for entry in blocked if entry.startswith("*."))]
    domain = extract_domain(path, base)
    if not endings:
        return F.lit(True)
    if "" in endings:
        return domain == ""
    return ~F.rlike(domain, F.lit(rf"(?:{_any_of(endings)})\z"))


def skipped_file(
    path: Column, name_parts: tuple = SKIP_NAME_PARTS, path_parts: tuple = SKIP_PATH_PARTS
) -> Column:
    """True for index, search and error pages, known by parts of their name or path."""
    tests = [
        F.rlike(text, F.lit(_any_of(parts)))
        for text, parts in ((F.lower(file_name(path)), name_parts), (F.lower(path), path_parts))
        if parts
    ]
    return reduce(or_, tests, F.lit(False))


def scanned_file(path: Column, suffixes: tuple) -> Column:
    """True for names with a scanned suffix and for names without any dot."""
    ends = rf"(?:{_any_of(suffixes)})\z|" if suffixes else ""
    return F.rlike(F.lower(file_name(path)), F.lit(rf"{ends}\A[^.]*\z"))


def scan_filter(path: Column, rules: ScanRules) -> Column:
    """All tests a path must pass before its content is read."""
    return (
        scanned_file(path, rules.suffixes)
        & ~skipped_file(path, rules.skip_name_parts, rules.skip_path_parts)
        & allowed_domain(path, rules.base, rules.blocked_domains)
    )
